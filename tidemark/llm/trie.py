"""Prefix trie of conversations: padded turn-id matrices, sorted in shards that are ranges of the turn order."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import runs
from tidemark.session import materialise, shuffle_width

#: Turns a shard should hold, and turns (columns) of a matrix at a time.
SHARD_TURNS = 400_000
BAND = 16
#: Decimal ids joined before they leave a shard, where the conversations that end at a node span several shards.
CHUNK_IDS = 1 << 15
#: Bytes of a turn's identity.
ID_BYTES = 16
EMPTY_SHA = hashlib.sha256(b"").hexdigest()

NODE_SCHEMA = (
    "shard int, kind int, depth int, key binary, parent_key binary, conv_id long, parent_conv_id long, n_convs long, words long, "
    "n_children long, n_leaves long, saved_tokens long, ends_sha256 string, ends string, seq int, branch int"
)
#: Kinds of rows that a shard returns: a finished node, a node of its border, a piece of a border node's list of ends.
WHOLE, BORDER, ENDS = 0, 1, 2
#: Where a border node stands: on a shard's first path, on its last, or above their fork.
FIRST, LAST, TRUNK = 0, 1, 2
ARROW = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}


def words_in(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))


def turn_sequences(rows: DataFrame, conversation: str = "conv_id", near: Column | None = None) -> DataFrame:
    """conv_id, `path` (16 bytes a turn, from hashes of role and text) and `words` (a count per turn), turns in order.

    Turns are ordered by number, null first; equal numbers by role and then by hash. Null roles and texts are empty. Rows
    without a conversation id are left out. Texts are not shuffled, only their hashes. A conversation's hashes are held
    in one task. `near` names rows that the caller joins next by that value: they are dealt by it at once.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    turns = rows.where(F.col(conversation).isNotNull()).select(
        F.col(conversation).cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"), role.alias("role"),
        # a length before the text keeps ("a", "bc") and ("ab", "c") apart
        F.concat(*[F.unhex(F.lpad(F.hex(F.xxhash64(F.lit(s), F.length(role), role, text)), 16, "0")) for s in (5, 7)]).alias("id"),
        words_in(text).cast("int").alias("words"),
    )
    if near is None:
        grouped = turns.groupBy("conv_id")
    else:
        grouped = turns.withColumn("near", near).repartition("near").groupBy("near", "conv_id")
    # a null turn number sorts first in a struct
    return grouped.agg(F.sort_array(F.collect_list(F.struct("turn", "role", "id", "words"))).alias("t")).select(
        *([] if near is None else ["near"]), "conv_id",
        F.array_join(F.transform("t.id", F.hex), "").alias("_hex"), F.col("t.words").alias("words"),
    ).withColumn("path", F.unhex("_hex")).drop("_hex")


def spliced(rows: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """Sequences in which the first h turns of conversation c are those of the last conversation whose id is a multiple of `every`.

    h is the unsigned crc32 of the decimal id modulo `most`; a conversation that is not there gives no turns.
    """
    sequences = turn_sequences(rows, near=F.expr(f"conv_id - conv_id % {every}"))
    h = F.crc32(F.col("conv_id").cast("string")) % most
    first = sequences.where(F.col("conv_id") == F.col("near")).select(
        "near", F.substring("path", 1, ID_BYTES * (most - 1)).alias("_path"), F.slice("words", 1, most - 1).alias("_words")
    )
    own = sequences.withColumn("_h", h.cast("int"))
    return own.join(first, "near", "left").select(
        "conv_id",
        F.concat(
            F.expr(f"substring(coalesce(_path, X''), 1, _h * {ID_BYTES})"), F.expr(f"substring(path, _h * {ID_BYTES} + 1)")
        ).alias("path"),
        F.concat(
            F.slice(F.coalesce("_words", F.array().cast("array<int>")), F.lit(1), F.col("_h")),
            F.slice("words", F.col("_h") + 1, F.greatest(F.size("words"), F.lit(1))),
        ).alias("words"),
    )


def _chain(path: bytes, depth: int) -> list[bytes]:
    """Keys of the nodes along a path, from the root to `depth`."""
    state, keys = hashlib.blake2b(digest_size=16), []
    for d in range(depth + 1):
        if d:
            state.update(path[(d - 1) * ID_BYTES : d * ID_BYTES])
        keys.append(struct.pack(">i", d) + state.digest())
    return keys


def _turn_codes(path: np.ndarray) -> np.ndarray:
    """Dense ids of turns, in the order of their bytes, from 1; 0 pads."""
    pairs = path.view(">u8").reshape(-1, 2).astype(np.uint64)
    order = np.lexsort((pairs[:, 1], pairs[:, 0]))
    changed = np.ones(len(order), bool)
    if len(order):
        changed[1:] = (pairs[order[1:]] != pairs[order[:-1]]).any(1)
    codes = np.empty(len(order), np.int64)
    codes[order] = np.cumsum(changed)
    return codes


def shard_levels(conv: np.ndarray, lengths: np.ndarray, codes: np.ndarray, words: np.ndarray, band: int = BAND) -> list[dict]:
    """The nodes of a shard by depth. Rows are put in order band by band: a lexsort by the node reached and the band's columns.

    A change of a column anywhere up to a depth, accumulated by OR, starts a node there. Rows that have ended leave before the next
    band, so padding never exceeds a band. Each level holds, for its nodes in order,
    `parent` (index in the level above), counts, smallest ids, words of the last turn and the ids that end there.
    """
    offsets = np.r_[0, np.cumsum(lengths)][:-1]
    rows = np.argsort(conv, kind="stable")
    group = np.zeros(len(rows), np.int64)
    ended = rows[lengths[rows] == 0]
    levels = [{
        "parent": np.zeros(1, np.int64), "n": np.array([len(rows)]), "least": conv[rows[:1]],
        "words": np.zeros(1, np.int64), "ends": conv[ended], "end_of": np.zeros(len(ended), np.int64),
    }]
    at, longest = 0, int(lengths.max(initial=0))
    while at < longest:
        live = lengths[rows] > at
        rows, group = rows[live], group[live]
        width = min(band, int(lengths[rows].max()) - at)
        column = at + np.arange(width)
        inside = column[None, :] < lengths[rows][:, None]
        place = np.where(inside, offsets[rows][:, None] + column[None, :], 0)
        matrix = np.where(inside, codes[place], 0)
        order = np.lexsort((conv[rows], *matrix.T[::-1], group))
        rows, group, matrix = rows[order], group[order], matrix[order]
        changed = np.ones((len(rows), width), bool)
        changed[1:] = matrix[1:] != matrix[:-1]
        changed[1:, 0] |= group[1:] != group[:-1]
        changed = np.logical_or.accumulate(changed, axis=1)
        above = group
        for j in range(width):
            there = np.flatnonzero(matrix[:, j])
            begins = changed[there, j]
            start = np.flatnonzero(begins)
            node = np.full(len(rows), -1)
            node[there] = np.cumsum(begins) - 1
            first, ids = there[start], conv[rows[there]]
            last = there[lengths[rows[there]] == at + j + 1]
            levels.append({
                "parent": above[first], "n": np.diff(np.r_[start, len(there)]), "least": np.minimum.reduceat(ids, start),
                "words": words[offsets[rows[first]] + at + j].astype(np.int64), "ends": conv[rows[last]], "end_of": node[last],
            })
            above = node
        group, at = above, at + width
    return levels


def _summed(values: np.ndarray, parent: np.ndarray, size: int) -> np.ndarray:
    """Sums of the children's values by parent; children of a node stand together."""
    out = np.zeros(size, np.int64)
    first, _ = runs(parent)
    if len(first):
        out[parent[first]] = np.add.reduceat(values, first)
    return out


def _ends_hash(ids: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, ids.tolist())).encode()).hexdigest() if len(ids) else EMPTY_SHA


def shard_nodes(shard: int, conv: np.ndarray, paths: list[bytes], words: np.ndarray) -> Iterator[pd.DataFrame]:
    """Rows of NODE_SCHEMA for one shard: all that lies within it is finished, its first and last path are border nodes.

    A node that other shards hold too has the shard's first or last row below it, as shards are ranges of the order.
    """
    lengths = np.array([len(p) // ID_BYTES for p in paths], np.int64)
    levels = shard_levels(conv, lengths, _turn_codes(np.frombuffer(b"".join(paths), np.uint8)), words)
    places = range(len(paths))
    first, last = min(places, key=lambda i: (paths[i], conv[i])), max(places, key=lambda i: (paths[i], conv[i]))
    keys = {branch: _chain(paths[i], int(lengths[i])) for branch, i in ((FIRST, first), (LAST, last))}

    def border_of(depth: int) -> dict[int, int]:
        """Index of the level's border nodes, with the branch they are on."""
        size, found = len(levels[depth]["n"]), {}
        if lengths[first] >= depth:
            found[0] = FIRST
        if lengths[last] >= depth:
            found[size - 1] = TRUNK if found.get(size - 1) == FIRST else LAST
        return found

    def key_of(depth: int, branch: int) -> bytes:
        return keys[FIRST if branch == TRUNK else branch][depth]

    below = None  # children, leaves and saved tokens that the level below adds to each node of this one
    for depth in range(len(levels) - 1, -1, -1):
        level, border = levels[depth], border_of(depth)
        size = len(level["n"])
        children, leaves, saved = below if below is not None else (np.zeros(size, np.int64),) * 3
        inner = np.ones(size, bool)
        inner[list(border)] = False
        leaves = np.where(inner & (children == 0), 1, leaves)
        saved = np.where(inner, saved + (level["n"] - 1) * level["words"], saved)
        frame = pd.DataFrame({
            "shard": shard, "kind": WHOLE, "depth": depth, "key": None, "parent_key": None, "conv_id": level["least"],
            "parent_conv_id": pd.array([pd.NA] * size, "Int64"), "n_convs": level["n"], "words": level["words"], "n_children": children,
            "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": EMPTY_SHA, "ends": None, "seq": 0, "branch": 0,
        })
        above = border_of(depth - 1) if depth else {}
        if depth:
            frame["parent_conv_id"] = levels[depth - 1]["least"][level["parent"]]
            for node, branch in above.items():  # the smallest member of a border node is not known yet
                of_border = level["parent"] == node
                frame.loc[of_border, "parent_key"] = key_of(depth - 1, branch)
        for node, branch in border.items():
            frame.at[node, "kind"], frame.at[node, "branch"], frame.at[node, "key"] = BORDER, branch, key_of(depth, branch)
        pieces = []
        hashes = frame["ends_sha256"].to_numpy(object, copy=True)
        for start, length in zip(*runs(level["end_of"])):
            node, ids = level["end_of"][start], level["ends"][start : start + length]
            if node not in border:
                hashes[node] = _ends_hash(ids)
                continue
            key = key_of(depth, border[node])
            for seq, at in enumerate(range(0, length, CHUNK_IDS)):
                joined = ",".join(map(str, ids[at : at + CHUNK_IDS].tolist()))
                pieces.append((shard, ENDS, depth, key, joined, seq))
        frame["ends_sha256"] = hashes
        yield frame
        if pieces:
            yield pd.DataFrame(pieces, columns=["shard", "kind", "depth", "key", "ends", "seq"])
        if depth:
            size = len(levels[depth - 1]["n"])
            below = tuple(_summed(np.where(inner, v, 0), level["parent"], size) for v in (np.ones(len(inner), np.int64), leaves, saved))


def _in_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = list(batches)
    if not held:
        return
    table = pa.Table.from_batches(held).combine_chunks()
    if not len(table):
        return
    schema = pa.schema([(name, ARROW[kind]) for name, kind in (c.split(" ") for c in NODE_SCHEMA.split(", "))])
    words = table["words"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    waiting, size = [], 0
    for frame in shard_nodes(table["shard"][0].as_py(), table["conv_id"].to_numpy(), table["path"].to_pylist(), words):
        waiting.append(pa.Table.from_pandas(frame.reindex(columns=schema.names), schema=schema, preserve_index=False))
        size += len(frame)
        if size > 20_000:
            yield from pa.concat_tables(waiting).combine_chunks().to_batches()
            waiting, size = [], 0
    if waiting:
        yield from pa.concat_tables(waiting).combine_chunks().to_batches()


def _hash_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One hash per key over pieces that come sorted; a list of ends is never held whole."""
    key, state = None, None
    for batch in batches:
        done = []
        for k, piece in zip(batch["key"].to_pylist(), batch["ends"].to_pylist()):
            if k != key:
                if key is not None:
                    done.append((key, state.hexdigest()))
                key, state = k, hashlib.sha256()
            else:
                state.update(b",")
            state.update(piece.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), (pa.binary(), pa.string()))], names=["key", "ends_sha256"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], names=["key", "ends_sha256"])


def prefix_trie(sequences: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row per node of the trie of turn sequences (`turn_sequences` or `spliced` make them; one row per conversation).

    Conversations are dealt by range of (path, conversation), so one first turn, or one whole conversation, that a third of the
    rows share is spread over many shards. A shard sorts its padded matrix of turn ids, marks where nodes start and adds up each depth.
    Only nodes on a shard's first and last path can be in other shards: these few rows are summed by key, each counted once by the first
    shard that has it, and summed again along the two paths of each shard. The ids that end at such a node leave a shard joined
    and sorted, and are hashed in a stream.

    Returns conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves, saved_tokens (over the
    subtree: (n_convs - 1) times the words of the last turn) and ends_sha256 (ids of the conversations that end here, ascending, joined by
    commas). A conversation without turns ends at the root. Equal conversations with different ids are members of the same
    nodes. An empty table gives an empty table.
    """
    spark = sequences.sparkSession
    stored = materialise(sequences.select("conv_id", "path", "words"))
    turns = stored.agg(F.sum(F.size("words") + 1)).first()[0] or 0
    width = max(1, min(shuffle_width(spark), turns // 2000), -(-turns // shard_turns))
    ranged = stored.repartitionByRange(width, "path", "conv_id").withColumn("shard", F.spark_partition_id())
    nodes = materialise(ranged.mapInArrow(_in_shards, NODE_SCHEMA))

    border = nodes.where(F.col("kind") == BORDER)
    merged = border.groupBy("key").agg(
        F.min("depth").alias("depth"), F.min("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"),
        F.min("words").alias("words"), F.sum("n_children").alias("_inner"), F.min("shard").alias("owner"),
    )
    kids = merged.where(F.col("parent_key").isNotNull()).groupBy(F.col("parent_key").alias("key")).agg(F.count(F.lit(1)).alias("_border"))
    known = materialise(
        merged.join(kids, "key", "left").withColumn("n_children", F.col("_inner") + F.coalesce("_border", F.lit(0)))
        .withColumn("_leaf", (F.col("n_children") == 0).cast("long")).withColumn("_saved", (F.col("n_convs") - 1) * F.col("words"))
        .select("key", "depth", "parent_key", "conv_id", "n_convs", "n_children", "owner", "_leaf", "_saved")
    )
    mine = F.col("shard") == F.col("owner")
    parts = border.select("shard", "key", "depth", "branch", "n_leaves", "saved_tokens").join(known.select("key", "owner", "_leaf", "_saved"), "key")
    everything = Window.partitionBy("shard").orderBy(F.desc("depth"))
    own = Window.partitionBy("shard", "branch").orderBy(F.desc("depth"))
    sums = {}
    for name, one in (("n_leaves", "_leaf"), ("saved_tokens", "_saved")):
        value = F.col(name) + F.when(mine, F.col(one)).otherwise(0)
        # the trunk stands above both branches, so all that is deeper lies below it
        sums[name] = F.when(F.col("branch") == TRUNK, F.sum(value).over(everything)).otherwise(F.sum(value).over(own))
    totals = parts.select("key", *[v.alias(k) for k, v in sums.items()]).groupBy("key").agg(*[F.sum(k).alias(k) for k in sums])
    ends = (
        nodes.where(F.col("kind") == ENDS).select("key", "shard", "seq", "ends").repartition("key").sortWithinPartitions("key", "shard", "seq")
        .select("key", "ends").mapInArrow(_hash_pieces, "key binary, ends_sha256 string")
    )
    parents = known.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("_parent"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    shared = (
        known.join(totals, "key").join(ends, "key", "left").join(parents, "parent_key", "left")
        .withColumn("parent_conv_id", F.col("_parent")).withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY_SHA))).select(*columns)
    )
    at_border = border.select("shard", "key").join(known.select("key", F.col("conv_id").alias("_parent")), "key").withColumnRenamed("key", "parent_key")
    whole = (
        nodes.where(F.col("kind") == WHOLE).join(materialise(at_border), ["shard", "parent_key"], "left")
        .withColumn("parent_conv_id", F.coalesce("_parent", "parent_conv_id")).select(*columns)
    )
    return whole.unionByName(shared).withColumn("depth", F.col("depth").cast("long"))
