"""SimHash fingerprints and near-duplicate groups through a Gray-order hierarchical index."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import local_roots, ranges, runs, short_batches, slices
from tidemark.llm.graph import components
from tidemark.session import materialise

#: Words in a shingle and bits that linked fingerprints may differ in.
SHINGLE_WORDS = 3
MAX_BITS = 3
#: Prefix nodes with more fingerprints than this are split by a further masked pattern.
NODE_ROWS = 4096
#: Bits of the shared pattern at each split: 64 = 4 * 16, the remaining 48 = 4 * 12, then 36 = 4 * 9.
PATTERN_BITS = (16, 12, 9)
#: Children of an index node, and node pairs expanded at a time.
FAN = 8
PAIRS_AT_ONCE = 1_000_000


def fingerprint_of(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash over XXH64 (seed 42) of word shingles; 0 without words.

    A-Z is lowered, words are split at ASCII white space, a text of fewer words is one shingle, repeats
    count, and a bit is 1 if more than half of the hashes have it.
    """
    parts = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(joined, 42)
    ends = list(accumulate(map(len, parts), lambda at, size: at + 1 + size))
    starts = [0, *[e + 1 for e in ends[:-words]]]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts, ends[words - 1 :])], dtype=np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 16384):
        bits = np.unpackbits(hashes[at : at + 16384].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and fingerprint (a signed long) of every row; whole texts, a null text counts as empty."""

    def mapped(batches) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            prints = np.array([fingerprint_of(t, words) for t in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["doc_id", "fingerprint"])

    short_batches(docs.sparkSession)
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        mapped, "doc_id long, fingerprint long"
    )


def gray_rank(prints: np.ndarray) -> np.ndarray:
    """Position of each 64-bit pattern in the reflected Gray order."""
    rank = prints.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def close_pairs(node: np.ndarray, prints: np.ndarray, max_bits: int = MAX_BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of the same prefix node that differ in `max_bits` bits or fewer.

    Rows must be sorted by node, then Gray rank. Eight neighbours in that order share a parent, eight
    parents a grandparent, and so on up to the prefix node; a parent keeps the bits its rows agree on (mask and
    pattern). Descending from the top, two nodes are compared on the bits both agree on, and the pair is
    left, with everything below it, when those alone differ in too many places.
    """
    starts, lengths = runs(node)
    masks, patterns = [np.full(len(prints), ~np.uint64(0))], [prints]
    firsts: list[np.ndarray] = [np.zeros(0, np.int64)]  # firsts[l]: first child, at level l - 1, of each node of level l
    kids: list[np.ndarray] = [np.zeros(0, np.int64)]
    begin, count = starts, lengths
    while len(count) and count.max() > 1:
        above = -(-count // FAN)
        heads = np.repeat(begin, above) + (ranges(np.zeros_like(above), above)) * FAN
        size = np.minimum(FAN, np.repeat(begin + count, above) - heads)
        both = np.bitwise_and.reduceat(patterns[-1] & masks[-1], heads)
        zero = np.bitwise_and.reduceat(~patterns[-1] & masks[-1], heads)
        masks.append(both | zero)
        patterns.append(both)
        firsts.append(heads)
        kids.append(size)
        begin, count = np.r_[0, np.cumsum(above)[:-1]], above
    top = len(masks) - 1
    if top == 0:
        return
    roots = np.arange(len(starts))
    stack = [(top, roots, roots)]
    while stack:
        level, a, b = stack.pop()
        if level == 0:
            yield a, b
            continue
        weight = kids[level][a] * kids[level][b]
        if weight.sum() > PAIRS_AT_ONCE and len(a) > 1:
            half = len(a) // 2
            stack += [(level, a[:half], b[:half]), (level, a[half:], b[half:])]
            continue
        at = ranges(np.zeros_like(weight), weight)
        wide = np.repeat(kids[level][b], weight)
        i, j = np.repeat(firsts[level][a], weight) + at // wide, np.repeat(firsts[level][b], weight) + at % wide
        same = np.repeat(a == b, weight)
        keep = ~same | ((i < j) if level == 1 else (i <= j))
        i, j = i[keep], j[keep]
        apart = np.bitwise_count((patterns[level - 1][i] ^ patterns[level - 1][j]) & masks[level - 1][i] & masks[level - 1][j])
        near = apart <= max_bits
        if near.any():
            stack.append((level - 1, i[near], j[near]))


def _links_within_nodes(max_bits: int):
    def linked(node: np.ndarray, prints: np.ndarray, ids: np.ndarray) -> pd.DataFrame:
        order = np.lexsort((gray_rank(prints), node))
        node, prints, ids = node[order], prints[order], ids[order]
        root = np.arange(len(ids))
        for a, b in close_pairs(node, prints, max_bits):
            root = local_roots_from(root, a, b)
        moved = np.flatnonzero(root != np.arange(len(ids)))
        return pd.DataFrame({"a": ids[moved], "b": ids[root[moved]]})

    def mapped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        rows = 0
        for part in batches:
            if len(part) == 0:
                continue
            held.append(part)
            rows += len(part)
            if rows < 4 * NODE_ROWS:
                continue
            whole = pd.concat(held)
            done = whole["node"] != part["node"].iloc[-1]  # the last node may go on in the next batch
            if done.any():
                yield linked(*_arrays(whole[done]))
            held = [whole[~done]]
            rows = len(held[0])
        if held:
            yield linked(*_arrays(pd.concat(held)))

    return mapped


def local_roots_from(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return local_roots(len(root), np.r_[np.arange(len(root)), a], np.r_[root, b])


def _arrays(part: pd.DataFrame):
    return part["node"].to_numpy(np.int64), part["print"].to_numpy(np.int64).view(np.uint64), part["id"].to_numpy(np.int64)


def _split(rows: DataFrame, bits: int, left: int) -> DataFrame:
    """Four rows for each: under the pattern of each quarter of its remaining bits."""
    quarter = F.explode(F.sequence(F.lit(0), F.lit(3))).alias("_q")
    rows = rows.select("*", quarter)
    at = F.col("_q") * bits

    def shifted(value: Column, by: Column) -> Column:
        return F.call_function("shiftrightunsigned", value, by)

    value = shifted(F.col("rest"), at).bitwiseAND(F.lit((1 << bits) - 1))
    low = F.col("rest").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), at) - 1)
    # a shift by 64 would be a shift by 0: the top quarter has nothing above it
    high = F.when(at + bits < left, F.call_function("shiftleft", shifted(F.col("rest"), at + bits), at)).otherwise(F.lit(0).cast("long"))
    node = (F.col("node") * 4 + F.col("_q")) * (1 << bits) + value
    return rows.select("id", "print", node.alias("node"), high.bitwiseOR(low).alias("rest"))


def near_links(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links (a, b) that join every two distinct fingerprints differing in `max_bits` or fewer, up to reachability.

    `prints` has id and print, one row per fingerprint. Two patterns at most three bits apart agree on
    one of four quarters, so each is filed under the pattern of each quarter: the top nodes of the index.
    A node with too many rows is split again by the quarters of its remaining bits, which loses nothing for the
    same reason. Rows of a node meet in one task, in Gray order, and are joined by `close_pairs`; a
    node's links are reduced to one per row.
    """
    if max_bits > 3:
        raise ValueError("quarters find differences of up to 3 bits")
    rows = prints.select("id", "print", F.lit(0).cast("long").alias("node"), F.col("print").alias("rest"))
    ready, left = [], 64
    for level, bits in enumerate(PATTERN_BITS):
        rows = _split(rows, bits, left)
        left -= bits
        if level == len(PATTERN_BITS) - 1:
            ready.append(rows)
            break
        full = materialise(rows.groupBy("node").count().where(F.col("count") > NODE_ROWS).select("node"))
        if full.isEmpty():
            ready.append(rows)
            break
        ready.append(rows.join(full, "node", "left_anti"))
        rows = rows.join(full, "node", "left_semi")
    found = [
        part.select("node", "print", "id").repartition("node").sortWithinPartitions("node")
        .mapInPandas(_links_within_nodes(max_bits), "a long, b long")
        for part in ready
    ]
    links = found[0]
    for more in found[1:]:
        links = links.union(more)
    return links


def simhash_groups(
    docs: DataFrame, words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS, id_column: str = "doc_id", text: str = "text"
) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable) of every row.

    Rows of equal fingerprint are one node, named by its smallest doc_id, so copies cost one row each.
    A null or blank text has fingerprint zero and is linked like any other. A row without an id links
    nothing; its component is that of the rows that share its fingerprint, or null. Repeated rows are all
    returned. An empty table gives an empty table. Other columns are not read.
    """
    rows = materialise(fingerprints(docs, words, id_column, text))
    nodes = materialise(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("first")))
    named = nodes.where(F.col("first").isNotNull()).select(F.col("first").alias("id"), F.col("fingerprint").alias("print"))
    linked = components(near_links(named, max_bits), "a", "b")
    groups = materialise(
        nodes.join(linked, nodes["first"] == linked["node"], "left").select(
            "fingerprint", F.coalesce("component", "first").alias("component_id")
        )
    )
    return rows.join(groups, "fingerprint").select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )
