"""Removal of long passages that an earlier document holds, by suffix automata of reference shards.

A shard is the set of passages that share an anchor, so only texts that can share a window meet, and a
shard's automaton covers a bounded number of reference passages however large the corpus is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import drop_unused, short_batches, slices
from tidemark.session import materialise

#: Words of a window; words of an anchor.
WINDOW_WORDS = 50
ANCHOR_WORDS = 8
#: Reference passages per automaton, and passages streamed against one copy of it.
REFERENCE_PASSAGES = 64
STREAM_ROWS = 1024
#: Windows of a passage, by their distance to the anchor, that are first compared by their common words.
GROUP_WINDOWS = 8
#: Entries of the word-hash cache of a task.
CACHE_WORDS = 200_000

_MULTIPLIER = 0x9E3779B97F4A7C15
#: Window starts handled at a time, and the bits that hold a place among them.
_STRETCH, _PLACES = 1 << 20, (1 << 24) - 1
_MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


class WordHashes(dict):
    """XXH64 of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word, 7)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > CACHE_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def _rolled(values: np.ndarray, width: int) -> np.ndarray:
    """A polynomial hash of every stretch of `width` values."""
    size = len(values) - width + 1
    out = np.zeros(size, np.uint64)
    for at in range(width):
        out = out * np.uint64(_MULTIPLIER) + values[at : at + size]
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_MIX[0])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_MIX[1])
    return x ^ (x >> np.uint64(31))


def _powers(count: int, held: list[np.ndarray] = []) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse; the longest tables so far are kept."""
    if not held or len(held[0]) < count:
        held[:] = []
        for base in (_MULTIPLIER, pow(_MULTIPLIER, -1, 2**64)):
            table = np.full(max(count, 4096), base, np.uint64)
            table[0] = 1
            held.append(np.cumprod(table, dtype=np.uint64))
    return held[0][:count], held[1]


def anchors_of(hashes: np.ndarray, window: int = WINDOW_WORDS, anchor: int = ANCHOR_WORDS) -> tuple[np.ndarray, ...]:
    """Anchor hash, first and last window start, place and passage hash of each anchor of a text.

    A window's anchor is the leftmost of its smallest word-run hashes: it depends on the window's words
    alone, so equal windows have equal anchors at the same place. Windows of one anchor lie side by side;
    the words they cover are the anchor's passage.
    """
    n = len(hashes) - window + 1
    if n <= 0:
        nothing = np.zeros(0, np.int64)
        return nothing.view(np.uint64), nothing, nothing, nothing, nothing.view(np.uint64)
    grams = _mixed(_rolled(hashes, anchor))
    span = window - anchor + 1
    place = np.empty(n, np.int64)
    for begin in range(0, n, _STRETCH):
        until = min(n, begin + _STRETCH)
        part = grams[begin : until + span - 1]
        # hash above, place below: the minimum of a stretch is its leftmost smallest gram
        low = (part & ~np.uint64(_PLACES)) | np.arange(len(part), dtype=np.uint64)
        width = 1
        while width * 2 <= span:  # sliding minimum by doubling
            low, width = np.minimum(low[:-width], low[width:]), width * 2
        size = until - begin
        least = np.minimum(low[:size], low[span - width : span - width + size])
        place[begin:until] = begin + (least & np.uint64(_PLACES)).astype(np.int64)
    starts = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    ends = np.r_[starts[1:], n] - 1
    powers, back = _powers(len(hashes))
    whole = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(_mixed(hashes) * powers, dtype=np.uint64, out=whole[1:])
    # words a..b: a difference of sums of word * M**position, brought to position 0
    passage = (whole[ends + window] - whole[starts]) * back[starts] + (ends - starts).astype(np.uint64)
    return grams[place[starts]], starts, ends, place[starts], _mixed(passage)


class SuffixAutomaton:
    """All substrings of the word sequences added so far."""

    def __init__(self) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link = [-1]
        self.size = [0]

    def _state(self, size: int, moves: dict[bytes, int], link: int) -> int:
        self.next.append(moves)
        self.size.append(size)
        self.link.append(link)
        return len(self.size) - 1

    def _split(self, state: int, word: bytes, target: int) -> int:
        """The state for exactly `size[state] + 1` words by which `target` is reached."""
        if self.size[target] == self.size[state] + 1:
            return target
        copy = self._state(self.size[state] + 1, dict(self.next[target]), self.link[target])
        self.link[target] = copy
        while state >= 0 and self.next[state].get(word) == target:
            self.next[state][word] = copy
            state = self.link[state]
        return copy

    def add(self, words: list[bytes]) -> None:
        last = 0
        for word in words:
            target = self.next[last].get(word)
            if target is not None:
                last = self._split(last, word, target)
                continue
            made = self._state(self.size[last] + 1, {}, 0)
            state = last
            while state >= 0 and word not in self.next[state]:
                self.next[state][word] = made
                state = self.link[state]
            if state >= 0:
                self.link[made] = self._split(state, word, self.next[state][word])
            last = made

    def matched(self, words: list[bytes]) -> list[int]:
        """For each position the length of the longest known sequence that ends there."""
        moves, link, size = self.next, self.link, self.size
        state, length, out = 0, 0, []
        for word in words:
            while state and word not in moves[state]:
                state = link[state]
                length = size[state]
            target = moves[state].get(word)
            if target is None:
                length = 0
            else:
                state, length = target, length + 1
            out.append(length)
        return out


def _key():
    """Rows are told apart by doc_id and a hash of the text, should an id repeat."""
    return F.xxhash64("text").alias("text_key")


OCCURRENCES = "anchor long, passage long, doc_id long, text_key long, firsts array<int>, span int, place int"


def _occurrences(window: int):
    """One row per text, anchor and passage: where the passage's windows start, how many more follow, where the anchor is."""

    def of_text(words: list[bytes], hashes: WordHashes):
        anchor, first, last, place, passage = anchors_of(hashes.of(words), window)
        order = np.lexsort((first, passage, anchor))
        anchor, first, last, place, passage = (x[order] for x in (anchor, first, last, place, passage))
        heads = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (passage[1:] != passage[:-1])])
        return anchor[heads], passage[heads], first, np.diff(np.r_[heads, len(first)]), (last - first)[heads], (place - first)[heads]

    def mapped(batches) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in slices(batches):
            made = []
            ids, keys = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            for row, text in enumerate(batch.column(2).to_pylist()):
                words = text.encode("utf-8", "surrogatepass").split()
                if len(words) >= window:
                    anchor, passage, *rest = of_text(words, hashes)
                    made.append((anchor.view(np.int64), passage.view(np.int64), np.full(len(anchor), ids[row], np.int64), np.full(len(anchor), keys[row], np.int64), *rest))
            if made:
                anchor, passage, doc, key, first, count, span, place = (np.concatenate(x) for x in zip(*made))
                firsts = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(count)], pa.int32()), pa.array(first, pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor), pa.array(passage), pa.array(doc), pa.array(key), firsts, pa.array(span, pa.int32()), pa.array(place, pa.int32())],
                    ["anchor", "passage", "doc_id", "text_key", "firsts", "span", "place"],
                )

    return mapped


PASSAGES = "anchor long, passage long, doc_id long, classes long, place int, words binary"


def _passages(window: int):
    def mapped(batches) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
        for batch in slices(batches):
            rows = []
            for doc, text, wanted in zip(*(batch.column(i).to_pylist() for i in range(3))):
                words = text.encode("utf-8", "surrogatepass").split()
                for w in wanted:
                    part = b" ".join(words[w["first"] : w["first"] + w["span"] + window])
                    rows.append((w["anchor"], w["passage"], doc, w["classes"], w["place"], part))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["anchor", "passage", "doc_id", "classes", "place", "words"]
            )

    return mapped


def _halves(digest: int) -> tuple[int, int]:
    return (digest >> 64) - 2**63, (digest & (2**64 - 1)) - 2**63


def _spans(hit: list[bool]) -> list[tuple[int, int]]:
    out, begin = [], None
    for at, is_hit in enumerate([*hit, False]):
        if is_hit and begin is None:
            begin = at
        elif not is_hit and begin is not None:
            out.append((begin, at - 1))
            begin = None
    return out


def _streamed(window: int):
    """Passages in the order of shard, reference before stream, doc_id: matched, then added if they are reference."""

    def mapped(batches) -> Iterator[pa.RecordBatch]:
        shard, automaton, waiting, waiting_doc = None, SuffixAutomaton(), [], None
        for batch in slices(batches):
            out: list[tuple] = []
            for anchor, part, kind, doc, passage, place, text in zip(*(batch.column(i).to_pylist() for i in range(7))):
                if (anchor, part) != shard:
                    shard, automaton, waiting, waiting_doc = (anchor, part), SuffixAutomaton(), [], None
                words = text.split(b" ")
                if doc != waiting_doc:
                    # passages of one document do not count against each other; stream rows of the last reference
                    # document come before those of others, so its passages wait for them too
                    for held in waiting:
                        automaton.add(held)
                    waiting, waiting_doc = [], doc
                lengths = automaton.matched(words)
                if not kind and lengths[-1] < len(words):
                    waiting.append(words)
                if part and not kind:
                    continue  # told by part 0
                hit = [length >= window for length in lengths[window - 1 :]]
                out += [(anchor, passage, a, b, None, None) for a, b in _spans(hit)]
                if kind:  # not among the reference passages: its other windows are compared by hash, first in groups
                    for a, b in _spans([not h for h in hit]):
                        while a <= b:  # windows whose distance to the anchor is alike share a core of words
                            group = (place - a) // GROUP_WINDOWS
                            near, far = group * GROUP_WINDOWS, group * GROUP_WINDOWS + GROUP_WINDOWS - 1
                            until = min(b, place - near)
                            core = words[place - near : place - far + window]
                            out.append((anchor, passage, a, until, *_halves(xxhash.xxh128_intdigest(b"%d " % group + b" ".join(core)))))
                            a = until + 1
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], t) for i, t in enumerate(types)], ["anchor", "passage", "begin", "end", "high", "low"]
            )

    return mapped


def _windows(window: int):
    """Every window in the open ranges of a passage, by hash."""

    def mapped(batches) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
        for batch in slices(batches):
            out = []
            for anchor, passage, doc, text, ranges in zip(*(batch.column(i).to_pylist() for i in range(5))):
                words = text.split(b" ")
                for r in ranges:
                    for at in range(r["begin"], r["end"] + 1):
                        out.append((anchor, passage, doc, at, *_halves(xxhash.xxh128_intdigest(b" ".join(words[at : at + window])))))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], t) for i, t in enumerate(types)], ["anchor", "passage", "doc_id", "begin", "high", "low"]
            )

    return mapped


def _cleaned(window: int):
    def mapped(batches) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            counts, removed, digests, texts = [], [], [], []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words = (text or "").encode("utf-8", "surrogatepass").split()
                kept = words
                if spans:
                    gone = np.zeros(len(words) + 1, np.int64)
                    for s in spans:
                        at = np.array(s["firsts"])
                        np.add.at(gone, at + s["a"], 1)
                        np.add.at(gone, at + s["b"] + window, -1)
                    keep = np.cumsum(gone[:-1]) == 0
                    kept = [w for w, k in zip(words, keep) if k]
                counts.append(len(words))
                removed.append(len(words) - len(kept))
                joined = b" ".join(kept)
                digests.append(hashlib.sha256(joined).hexdigest())
                texts.append(joined.decode("utf-8", "surrogatepass") if len(kept) < len(words) else text)
            made = [pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())]
            if batch.num_columns > 3:
                made += [pa.array(texts, pa.string()), batch.column(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text", "row"][: 1 + len(made)])

    return mapped


def repeated_windows(docs: DataFrame, window: int = WINDOW_WORDS) -> DataFrame:
    """(doc_id, text_key, spans): for each text the stretches of windows to remove, from firsts + a to firsts + b.

    1. Each text is cut into anchors (`anchors_of`), a row for about every 22 words. Anchors of one document only are dropped.
    2. Equal passages of an anchor form a class, held by its smallest doc_id; every other document of the
       class repeats all of its windows. Copies thus cost a row per anchor.
    3. The classes of an anchor are a shard. In the order of doc_id each is matched against the suffix
       automaton of those before it, and added. Matches of `window` words or more are spans to remove.
    4. A shard of more than REFERENCE_PASSAGES classes takes the first of them as reference; the rest streams
       against copies of that automaton in many tasks. Windows that no reference holds are settled by hash: those at a
       like distance from the anchor share a core of words, most cores occur once and settle their windows, and for the
       others the smallest doc_id per window hash decides. No class is left out.
    """
    known = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    keyed = known.select("doc_id", _key(), "text")
    with Held() as held:
        found = materialise(keyed.mapInArrow(_occurrences(window), OCCURRENCES))
        shared = held(
            found.groupBy("anchor").agg(F.min("doc_id").alias("_a"), F.max("doc_id").alias("_b")).where("_a < _b").select("anchor")
        )
        hits = materialise(found.join(shared.hint("shuffle_hash"), "anchor", "left_semi"))
        first = F.min(F.struct("doc_id", "text_key", F.col("firsts")[0].alias("first"), "span", "place")).alias("held")
        classes = held(hits.groupBy("anchor", "passage").agg(first).select("anchor", "passage", "held.*"))
        many = held(classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("classes")).where("classes > 1"))
        wanted = classes.join(many.hint("shuffle_hash"), "anchor").groupBy("doc_id", "text_key").agg(
            F.collect_list(F.struct("anchor", "passage", "first", "span", "place", "classes")).alias("wanted")
        )
        # a hash join on the short side: texts are shuffled, but not sorted
        told = _matched(keyed.join(wanted.hint("shuffle_hash"), ["doc_id", "text_key"]), window, held)
        named = _join(hits, classes.select("anchor", "passage", F.col("doc_id").alias("_holder")))
        whole = named.where("doc_id > _holder").select("doc_id", "text_key", "firsts", F.lit(0).alias("a"), F.col("span").alias("b"))
        # the smallest document of a class may repeat windows of other classes, at each of its places
        part = _join(named.where("doc_id = _holder"), told).select(
            "doc_id", "text_key", "firsts", F.col("begin").alias("a"), F.col("end").alias("b")
        )
        spans = whole.union(part).groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("firsts", "a", "b")).alias("spans"))
        return materialise(spans)


class Held:
    """Small tables kept on the executors' disks while one result is made; a lost part is computed again."""

    def __enter__(self) -> Held:
        self.tables: list[DataFrame] = []
        return self

    def __call__(self, df: DataFrame) -> DataFrame:
        self.tables.append(df.persist(StorageLevel.DISK_ONLY))
        return self.tables[-1]

    def __exit__(self, *_) -> None:
        for df in self.tables:
            df.unpersist()


def _join(rows: DataFrame, other: DataFrame, how: str = "inner") -> DataFrame:
    """Join on (anchor, passage). The passage hash alone decides where rows meet: a hash join on one number is the cheapest."""
    right = other.withColumnRenamed("anchor", "_anchor").withColumnRenamed("passage", "_passage").hint("shuffle_hash")
    same = (F.col("passage") == F.col("_passage")) & (F.col("anchor").bitwiseXOR(F.col("_anchor")) == 0)
    joined = rows.join(right, same, how)
    return joined.drop("_anchor", "_passage") if how != "left_semi" else joined


def _matched(passages: DataFrame, window: int, held: Held) -> DataFrame:
    """(anchor, passage, begin, end): stretches of windows of a class that a smaller document holds."""
    texts = materialise(passages.select("doc_id", "text", "wanted").mapInArrow(_passages(window), PASSAGES))
    large = texts.where(F.col("classes") > REFERENCE_PASSAGES)
    place = Window.partitionBy("anchor").orderBy("doc_id", "passage")
    first = (
        large.select("anchor", "passage", "doc_id").withColumn("_n", F.row_number().over(place))
        .where(F.col("_n") <= REFERENCE_PASSAGES).select("anchor", "passage", F.lit(True).alias("_reference"))
    )
    parted = _join(large, held(first), "left").withColumn("parts", F.ceil(F.col("classes") / STREAM_ROWS).cast("int"))
    row = ["doc_id", "passage", "place", "words"]
    small = texts.where(F.col("classes") <= REFERENCE_PASSAGES).select("anchor", F.lit(0).alias("part"), F.lit(0).alias("kind"), *row)
    reference = parted.where("_reference").select(
        "anchor", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), *row
    )
    stream = parted.where(F.col("_reference").isNull()).select(
        "anchor", F.pmod(F.xxhash64("passage"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("kind"), *row
    )
    told = held(
        small.union(reference).union(stream)
        .repartition("anchor", "part").sortWithinPartitions("anchor", "part", "kind", "doc_id", "passage")
        .mapInArrow(_streamed(window), "anchor long, passage long, begin int, end int, high long, low long")
    )
    spans = ["anchor", "passage", "begin", "end"]
    known = told.where(F.col("high").isNull()).select(*spans)
    left = told.where(F.col("high").isNotNull())
    if left.isEmpty():
        return known
    open_groups = _join(left, large.select("anchor", "passage", "doc_id"))
    cores = open_groups.groupBy("anchor", "high", "low").agg(F.min("doc_id").alias("_a"), F.max("doc_id").alias("_b")).where("_a < _b")
    alive = open_groups.join(cores, ["anchor", "high", "low"], "left_semi").groupBy("anchor", "passage").agg(
        F.collect_list(F.struct("begin", "end")).alias("ranges")
    )
    windows = held(
        _join(large.select("anchor", "passage", "doc_id", "words"), alive).select("anchor", "passage", "doc_id", "words", "ranges")
        .mapInArrow(_windows(window), "anchor long, passage long, doc_id long, begin int, high long, low long")
    )
    holders = windows.groupBy("anchor", "high", "low").agg(F.min("doc_id").alias("_holder"))
    settled = windows.join(holders, ["anchor", "high", "low"]).where("doc_id > _holder").withColumn("end", F.col("begin"))
    return known.union(settled.select(*spans))


def remove_repeats(docs: DataFrame, window: int = WINDOW_WORDS, id_column: str = "doc_id", text: str = "text", whole_rows: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row: words in repeated windows are removed.

    A word goes if a window of `window` words covers it whose sequence also starts in a row of smaller
    doc_id. Windows are judged on the input. Words are split at ASCII white space and the kept ones joined by one space.
    With `whole_rows` two columns follow: kept_text (a text that loses nothing is unchanged) and row, a struct of
    the other columns of `docs`.

    A null text has no words; texts shorter than a window lose nothing. Rows of equal doc_id never remove
    each other's words. A row without an id neither loses nor removes words. Repeated rows are all
    returned. An empty table gives an empty table.
    """
    short_batches(docs.sparkSession)
    schema = T.StructType().add("doc_id", "long").add("n_words", "long").add("n_removed", "long").add("kept_sha256", "string")
    extra = []
    if whole_rows:
        others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]).alias("row")
        extra = ["row"]
        docs = docs.select(F.col(id_column), F.col(text), others)
        schema = schema.add("kept_text", "string").add("row", docs.schema["row"].dataType)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), *extra)
    spans = repeated_windows(rows.select("doc_id", "text"), window)
    drop_unused(docs.sparkSession)
    joined = rows.withColumn("text_key", F.xxhash64("text")).join(spans.hint("shuffle_hash"), ["doc_id", "text_key"], "left")
    return joined.select("doc_id", "text", "spans", *extra).mapInArrow(_cleaned(window), schema)
