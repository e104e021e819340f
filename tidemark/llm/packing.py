"""Packing documents into training sequences by lexical retrieval over sharded BM25 indexes."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import partial
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm.common import drop_unused, gathered, ranges, runs, short_batches, slices
from tidemark.llm.graph import best_groups
from tidemark.session import discard, materialise

WINDOW = 4096
END_ID = 2
#: Tokens of a shard: what one task indexes and packs.
SHARD_TOKENS = 1_000_000
#: BM25 parameters.
K1, B = 1.2, 0.75
#: Heaviest terms that stand for a document while neighbours are sought, and the rarest of them, whose postings are searched.
SKETCH_TERMS, LOOKUPS = 24, 8
#: Places a posting is compared with, and rounds in which groups of neighbours join.
NEAR, ROUNDS = 8, 3
#: Postings whose neighbourhoods are compared at a time.
PAIRED_POSTINGS = 1024
#: Bytes of text whose words are looked up together.
BATCH_BYTES = 12_000_000
#: Words of lower-case letters that the tokenizer's normal forms leave alone, and a place it always splits at.
LETTERS = "^[a-zß-öø-ÿ]+$"
LETTER_THEN_SIGN = r"([a-z])([!-&(-/:-@\[-`{-~])"


def _byte_signs() -> dict[int, int]:
    """Byte-level vocabularies write printable Latin-1 bytes as themselves and the others as U+0100, U+0101, ... in turn."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return {byte: 256 + at for at, byte in enumerate(b for b in range(256) if b not in printable)}


BYTE_SIGNS = _byte_signs()


class WordIds:
    """Token ids of texts, word by word.

    The tokenizer splits at white space, between letters and signs, and merges inside words only, and it lowers
    letters; so ids of a text are the ids of its words in turn. Each different word of a batch is merged once; the
    rest is array operations. Words that are lower-case letters throughout need no further treatment
    and go to the merges directly, all others through the whole tokenizer, and so do texts that
    may spell a special token.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core
        self.tokenizer = Tokenizer.from_file(path)
        self.merges = self.tokenizer.model

    def _vocabulary(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and number of the ids of each word, and all ids."""
        simple = pc.match_substring_regex(words, pattern=LETTERS).to_numpy(zero_copy_only=False)
        found: list[list[int]] = [[]] * len(words)
        whole = words.to_pylist()
        merges = self.merges.tokenize
        for at in np.flatnonzero(simple).tolist():
            word = whole[at]
            if not word.isascii():  # the vocabulary writes other bytes as Latin-1 signs, with gaps filled from U+0100 on
                word = word.encode().decode("latin-1").translate(BYTE_SIGNS)
            found[at] = [t.id for t in merges(word)]
        odd = np.flatnonzero(~simple).tolist()
        for at, made in zip(odd, self.tokenizer.encode_batch_fast([whole[i] for i in odd], add_special_tokens=False)):
            found[at] = made.ids
        counts = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), np.uint32, int(counts.sum()))
        return np.cumsum(counts) - counts, counts, flat

    def of(self, texts: pa.Array) -> list[np.ndarray]:
        texts = pc.fill_null(texts, "")
        special = pc.match_substring(texts, "<|")
        plain = pc.if_else(special, "", texts)
        words = pc.replace_substring_regex(pc.ascii_lower(plain), pattern="[\t\n\r]", replacement=" ")
        words = pc.replace_substring_regex(words, pattern=LETTER_THEN_SIGN, replacement=r"\1 \2")
        split = pc.split_pattern(words, " ")
        coded = pc.list_flatten(split).dictionary_encode()
        starts, counts, flat = self._vocabulary(coded.dictionary)
        at = coded.indices.to_numpy()
        ends = np.r_[0, np.cumsum(counts[at])][np.cumsum(pc.list_value_length(split).to_numpy())]
        made = np.split(flat[ranges(starts[at], counts[at])], ends[:-1])
        for i in np.flatnonzero(special.to_numpy(zero_copy_only=False)).tolist():
            made[i] = np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, np.uint32)
        return made


def token_table(docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n, ids of every row; the end id comes last."""

    def mapped(batches) -> Iterator[pa.RecordBatch]:
        words = WordIds(tokenizer)
        for part in gathered(batches, BATCH_BYTES):
            made = [np.append(x, np.uint32(END_ID)).astype("<u4") for x in words.of(part.column(1).chunk(0))]
            yield pa.RecordBatch.from_arrays(
                [part.column(0).chunk(0), pa.array([len(x) for x in made], pa.int64()), pa.array([_packed(x) for x in made], pa.binary())], ["doc_id", "n", "ids"]
            )

    short_batches(docs.sparkSession)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(mapped, "doc_id long, n long, ids binary")


def _packed(ids: np.ndarray) -> bytes:
    """Two bytes an id where all fit, four otherwise; the first byte says which."""
    return b"\x02" + ids.astype("<u2").tobytes() if ids.max() < 65536 else b"\x04" + ids.tobytes()


def _unpacked(stored: bytes) -> np.ndarray:
    return np.frombuffer(stored, "<u2" if stored[0] == 2 else "<u4", offset=1).astype("<u4")


def _frequencies(batches) -> Iterator[pa.RecordBatch]:
    """Documents by term, one row per task and term."""
    seen = np.zeros(0, np.int64)
    for batch in slices(batches):
        for stored in batch.column(0).to_pylist():
            terms = np.unique(_unpacked(stored))
            if terms[-1] >= len(seen):
                seen = np.r_[seen, np.zeros(int(terms[-1]) + 1 - len(seen), np.int64)]
            seen[terms] += 1
    there = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(there, pa.int64()), pa.array(seen[there], pa.int64())], ["term", "documents"])


class Bm25:
    """An inverted index over the documents of one shard; idf and mean length are those of the whole corpus."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float) -> None:
        n = len(docs)
        pairs = np.concatenate([d.astype(np.int64) * n + at for at, d in enumerate(docs)])
        pairs, tf = np.unique(pairs, return_counts=True)
        term, self.doc = np.divmod(pairs, n)
        length = np.array([len(d) for d in docs])[self.doc]
        self.weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))
        self.n = n
        starts, sizes = runs(term)
        self.start, self.size = np.zeros(len(idf), np.int64), np.zeros(len(idf), np.int64)
        self.start[term[starts]], self.size[term[starts]] = starts, sizes
        order = np.argsort(self.doc, kind="stable")
        self.terms = np.split(term[order], np.cumsum(np.bincount(self.doc, minlength=n))[:-1])

    def scores(self, doc: int) -> np.ndarray:
        terms = self.terms[doc]
        at = ranges(self.start[terms], self.size[terms])
        return np.bincount(self.doc[at], weights=self.weight[at], minlength=self.n)


def pack_shard(docs: list[np.ndarray], idf: np.ndarray, mean: float, window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece.

    An unused document opens a sequence as seed; its best unused neighbours by BM25 follow until the
    sequence is full. The document that crosses the border is cut there, and its rest opens the next
    sequence as seed. The last sequence is cut into powers of two, so that none is padded.
    """
    index = Bm25(docs, idf, mean)
    unused = np.ones(len(docs), bool)
    pieces: list[tuple[int, int, int, int, int]] = []
    sequence = offset = 0

    def put(doc: int) -> bool:
        """Lay a document down; true if a sequence was completed with it."""
        nonlocal sequence, offset
        unused[doc] = False
        at, crossed = 0, False
        while at < len(docs[doc]):
            length = min(len(docs[doc]) - at, window - offset)
            pieces.append((doc, at, length, sequence, offset))
            at, offset = at + length, offset + length
            if offset == window:
                sequence, offset, crossed = sequence + 1, 0, True
        return crossed

    following, seed = 0, None
    while True:
        if offset == 0 or seed is None:
            while following < len(docs) and not unused[following]:
                following += 1
            if following == len(docs):
                break
            seed = following
            put(seed)
            if offset == 0:
                continue
        open_docs = np.flatnonzero(unused)
        if len(open_docs) == 0:
            break
        best = open_docs[np.argsort(-index.scores(seed)[open_docs], kind="stable")]
        for neighbour in best.tolist():
            if put(neighbour):
                seed = neighbour
                break
        else:
            break
    return _tail_cut(pieces, sequence, offset)


def _tail_cut(pieces, sequence, used):
    """Cut what lies in the last, unfilled sequence into sequences whose lengths are powers of two."""
    whole = [p for p in pieces if p[3] != sequence]
    sizes = [1 << b for b in range(used.bit_length() - 1, -1, -1) if used >> b & 1]
    edges = np.cumsum([0, *sizes])
    for doc, start, length, _, offset in (p for p in pieces if p[3] == sequence):
        while length:
            part = int(np.searchsorted(edges, offset, side="right")) - 1
            fits = min(length, int(edges[part + 1]) - offset)
            whole.append((doc, start, fits, sequence + part, offset - int(edges[part])))
            start, length, offset = start + fits, length - fits, offset + fits
    return whole


def _postings(idf: np.ndarray, mean: float, frequency: np.ndarray):
    """The inverted index: a row for each of the LOOKUPS rarest terms of a document's sketch.

    near and next are the two smallest hashes, seeded by the term, of the other terms of the sketch: in their order
    documents of one term that share more of it lie side by side, so a hot term is searched without comparing all its documents.
    """

    kind = _id_kind(idf)

    def mapped(batches) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: list[list[np.ndarray]] = [[], [], [], []]
            sketches: list[bytes] = []
            for row, stored in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = _unpacked(stored)
                terms, tf = np.unique(ids, return_counts=True)
                shared = frequency[terms] > 1
                terms, tf = terms[shared].astype(np.int64), tf[shared]
                weight = idf[terms] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(ids) / mean))
                top = np.argsort(-weight, kind="stable")[:SKETCH_TERMS]
                terms, weight = terms[top], weight[top]
                if not len(terms):
                    continue
                sketch = np.full(SKETCH_TERMS, np.iinfo(np.dtype(kind)).max, kind), np.zeros(SKETCH_TERMS, "<f2")
                sketch[0][: len(terms)], sketch[1][: len(terms)] = terms, weight
                rare = terms[np.argsort(frequency[terms], kind="stable")[:LOOKUPS]]
                mixed = (terms[None, :].astype(np.uint64) + np.uint64(1)) * (rare[:, None].astype(np.uint64) * np.uint64(2) + np.uint64(0x9E3779B97F4A7C15))
                mixed = ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(1)
                mixed[terms[None, :] == rare[:, None]] = 2**63 - 1
                mixed = np.sort(np.c_[mixed, np.full((len(rare), 1), 2**63 - 1, np.uint64)], axis=1).astype(np.int64)
                for held, made in zip(out, (rare, mixed[:, 0], mixed[:, 1], np.full(len(rare), row, np.int64))):
                    held.append(made)
                sketches += [sketch[0].tobytes() + sketch[1].tobytes()] * len(rare)
            if sketches:
                columns = [pa.array(np.concatenate(x), pa.int64()) for x in out]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(sketches, pa.binary())], ["term", "near", "next", "row", "sketch"])

    return mapped


def _id_kind(idf: np.ndarray) -> str:
    """Two bytes a term of a sketch where the vocabulary leaves their last value free, four otherwise; that value stands for none."""
    return "<u2" if len(idf) <= np.iinfo(np.uint16).max else "<u4"


def _common_weight(ids: np.ndarray, weight: np.ndarray, other_ids: np.ndarray, other_weight: np.ndarray) -> np.ndarray:
    """The BM25 weight, both ways, of the terms that sketches have in common: ids by column, weights by row and zero where there is no term."""
    mine, theirs = np.zeros(ids.shape, bool), np.empty(ids.shape, bool)
    for at, other in enumerate(other_ids):
        same = ids == other
        mine |= same
        same.any(0, out=theirs[at])
    return (np.ascontiguousarray(mine.T) * weight).sum(1) + (np.ascontiguousarray(theirs.T) * other_weight).sum(1)


def _pairs(kind: str, batches) -> Iterator[pa.RecordBatch]:
    """Of postings in order, the best two documents before each and the best after it: a, b and the BM25 weight both ways of common terms."""
    term, row = np.zeros(0, np.int64), np.zeros(0, np.int64)
    ids, weight = np.zeros((SKETCH_TERMS, 0), kind), np.zeros((0, SKETCH_TERMS), np.float32)
    width = np.dtype(kind).itemsize * SKETCH_TERMS
    for batch in slices(batches, PAIRED_POSTINGS):
        old = len(term)
        raw = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
        term, row = np.r_[term, batch.column(0).to_numpy()], np.r_[row, batch.column(3).to_numpy()]
        ids = np.c_[ids, np.ascontiguousarray(raw[:, :width]).view(kind).T]
        weight = np.r_[weight, np.ascontiguousarray(raw[:, width:]).view("<f2").astype(np.float32)]
        score = np.zeros((len(term), NEAR))
        for back in range(1, min(NEAR, len(term) - 1) + 1):
            at = np.arange(max(old, back), len(term))
            at = at[term[at] == term[at - back]]
            score[at, back - 1] = _common_weight(ids.take(at, 1), weight[at], ids.take(at - back, 1), weight[at - back])
        ahead = np.zeros_like(score)  # the same scores, seen from the document before
        for back in range(1, min(NEAR, len(term) - 1) + 1):
            ahead[:-back, back - 1] = score[back:, back - 1]
        best = np.argsort(-score, axis=1, kind="stable")[:, :2]
        nearest = ahead.argmax(1)  # the nearest of the best that follow in reach
        i = np.r_[np.repeat(np.arange(old, len(term)), 2), np.arange(len(term)) + nearest + 1]
        b = np.r_[best[old:].ravel(), nearest]
        kept = np.r_[score[np.arange(old, len(term))[:, None], best[old:]].ravel() > 0, ahead.max(1) > 0]
        i, b = np.divmod(np.unique(i[kept] * NEAR + b[kept]), NEAR)
        if len(i):
            x, y = row[i], row[i - b - 1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(score[i, b], pa.float64())], ["a", "b", "score"]
            )
        term, row, ids, weight = term[-NEAR:], row[-NEAR:], ids[:, -NEAR:], weight[-NEAR:]


def _groups(edges: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame | None, list[str]]:
    """(row, g1, g2, ...): in each round every group joins the group of its best neighbour, so g1 are the closest.

    Stored tables are deleted as soon as the next ones stand, `edges` too.
    """
    labels, names = None, []
    for at in range(1, rounds + 1):
        both = edges.union(edges.select("b", "a", "score"))
        tie = F.xxhash64(F.least("a", "b"), F.greatest("a", "b"))
        links = both.groupBy("a").agg(F.max(F.struct("score", tie.alias("tie"), "b")).alias("best")).select("a", F.col("best.b").alias("b"))
        links = materialise(links)
        joined = materialise(best_groups(links))
        discard(links)
        before = names[-1] if names else "row"
        names = [*names, f"g{at}"]
        if labels is None:
            labels = joined.select(F.col("node").alias("row"), F.col("component").alias("g1"))
        else:
            old, labels = labels, labels.join(joined.withColumnRenamed("node", before), before, "left").withColumn(names[-1], F.coalesce("component", before)).drop("component")
        labels = materialise(labels)
        if at > 1:
            discard(old)
        moved = edges
        for end in ("a", "b"):
            moved = moved.join(joined.withColumnRenamed("node", end), end).drop(end).withColumnRenamed("component", end)
        moved = materialise(moved.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("score").alias("score")))
        discard(edges)
        discard(joined)
        edges = moved
        if edges.isEmpty():
            break
    discard(edges)
    return labels, names


def _edges(tokens: DataFrame, idf: np.ndarray, mean: float, frequency: np.ndarray) -> DataFrame:
    """(a, b, score): documents and their best neighbours. The postings are deleted once they have met."""
    postings = materialise(tokens.select("row", "ids").mapInArrow(_postings(idf, mean, frequency), "term long, near long, next long, row long, sketch binary"))
    order = ["term", "near", "next", "row"]
    met = partial(_pairs, _id_kind(idf))
    found = postings.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(met, "a long, b long, score double")
    edges = materialise(found.where("a <> b").groupBy("a", "b").agg(F.max("score").alias("score")))
    discard(postings)
    return edges


def _shards(tokens: DataFrame, idf: np.ndarray, mean: float, frequency: np.ndarray, shard_tokens: int) -> DataFrame:
    """(row, shard): documents in the order of their groups, cut every `shard_tokens` tokens."""
    edges = _edges(tokens, idf, mean, frequency)
    drop_unused(tokens.sparkSession)  # the shuffle of the postings
    labels, names = _groups(edges)
    order = [*reversed(names), "row"]
    placed = tokens.select("row", "n").join(labels, "row", "left").select("row", "n", *[F.coalesce(g, "row").alias(g) for g in names])
    unordered = materialise(placed)
    discard(labels)
    placed = materialise(unordered.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    discard(unordered)
    before, total = [], 0
    for row in placed.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect():  # one row per range
        before.append((row["part"], total))
        total += row["n"]
    ordered, placed = placed, placed.join(F.broadcast(tokens.sparkSession.createDataFrame(before, "part int, before long")), "part")
    upto = F.col("before") + F.sum("n").over(Window.partitionBy("part").orderBy(*order)) - F.col("n")
    shards = materialise(placed.select("row", F.floor(upto / F.lit(shard_tokens)).cast("long").alias("shard")))
    discard(ordered)
    return shards


def _packed_shards(idf: np.ndarray, mean: float, window: int):
    def pack(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values(["doc_id", "ids"], kind="stable", na_position="last")
        docs = [_unpacked(x) for x in shard["ids"]]
        doc, start, length, sequence, offset = (np.array(x, np.int64) for x in zip(*pack_shard(docs, idf, mean, window)))
        return pd.DataFrame({
            "doc_id": shard["doc_id"].iloc[doc].to_numpy(),
            "start": start, "length": length,
            "ids_crc32": [zlib.crc32(docs[d][s : s + n].tobytes()) for d, s, n in zip(doc, start, length)],
            "doc_tokens": np.array([len(d) for d in docs])[doc],
            "sequence_id": (int(shard["shard"].iloc[0]) << 32) + sequence, "offset": offset,
        })

    return pack


def retrieval_packing(
    docs: DataFrame, tokenizer: str, window: int = WINDOW, shard_tokens: int = SHARD_TOKENS, id_column: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Pieces of all documents in sequences of `window` tokens that keep lexically close documents together.

    Terms are token ids, so document frequencies are one number per id of the vocabulary; they and the mean
    length are counted over all documents and sent to every task. The neighbours of a document are sought in the whole
    corpus first: postings of its rarest heavy terms are compared in order (`_postings`, `_pairs`), groups of best
    neighbours join in rounds, and documents in the order of their groups are cut into shards of about `shard_tokens`
    tokens. Each shard then has its own index and packs its own documents. Every id, the end id of each document
    included, lies in exactly one piece, and no sequence needs padding: all are full but for one per shard, which
    is cut into sequences of a power of two.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id (shard * 2**32 + number), offset. A
    null or empty text is the end id alone. Rows without an id are packed like others; repeated rows
    each. An empty table gives an empty table. Other columns are not read.
    """
    tokens = materialise(token_table(docs, tokenizer, id_column, text).withColumn("row", F.monotonically_increasing_id()))
    count, total = tokens.agg(F.count(F.lit(1)), F.sum("n")).first()
    size = Tokenizer.from_file(tokenizer).get_vocab_size(with_added_tokens=True)
    found = tokens.select("ids").mapInArrow(_frequencies, "term long, documents long").groupBy("term").agg(F.sum("documents").alias("documents")).collect()
    frequency = np.zeros(max(size, END_ID + 1), np.float64)
    for row in found:
        frequency[row["term"]] = row["documents"]
    idf = np.log(1 + ((count or 0) - frequency + 0.5) / (frequency + 0.5))
    mean = (total or 0) / max(1, count or 0)
    if (total or 0) <= shard_tokens:
        dealt = tokens.withColumn("shard", F.lit(0).cast("long"))
    else:
        dealt = tokens.join(_shards(tokens, idf, mean, frequency, shard_tokens).hint("shuffle_hash"), "row")
        drop_unused(docs.sparkSession)
    return dealt.select("doc_id", "ids", "shard").groupBy("shard").applyInPandas(
        _packed_shards(idf, mean, window),
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long",
    )
