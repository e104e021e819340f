"""How the sources of a language differ in their words: count-level bitmaps of terms, ANDed and counted."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import slices
from tidemark.session import materialise

#: Documents a kept term is in at least, shares are parts of this many, and term rows a group reports.
LEAST_DOCS = 3
SCALE = 1_000_000_000
TOP_TERMS = 200
#: Terms a task counts before it hands on what it has.
HELD_TERMS = 300_000
#: Terms of a bitmap block, by the size class (bits of the total count) of its terms: frequent terms have as many counts as
#: terms, rare ones a handful.
BLOCK_TERMS = ((6, 4096), (10, 1024), (64, 128))
#: Sources whose bitmaps meet in one task.
SOURCES_MET = 64

# bytes that end a term become blanks; of the letters only A-Z change. Bytes above 0x7F belong to terms
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))

GROUP = ["lang", "source"]


def _filled(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def _count_terms(held: int):
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])

    def handed(counts: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in counts.items():
            terms = pa.array(list(n), pa.binary()).cast(pa.string())
            size = len(terms)
            columns = [pa.repeat(pa.scalar(v, pa.string()), size) for v in (lang, source)]
            columns += [terms, pa.array(list(n.values()), pa.int64()), pa.array([docs[t] for t in n], pa.int64())]
            table = pa.Table.from_arrays(columns, schema=schema)
            yield from table.to_batches(max_chunksize=20_000)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple, tuple[Counter, Counter]] = {}
        size = 0
        for batch in slices(batches):
            names = list(zip(batch["lang"].to_pylist(), batch["source"].to_pylist()))
            for name, text in zip(names, batch["text"].cast(pa.binary())):
                terms = (text.as_py() or b"").translate(_FOLD).split()
                if name not in counts:
                    counts[name] = (Counter(), Counter())
                n, docs = counts[name]
                before = len(n)
                n.update(terms)
                docs.update(set(terms))
                size += len(n) - before
                if size > held:
                    yield from handed(counts)
                    counts, size = {}, 0
        yield from handed(counts)

    return count


def term_counts(docs: DataFrame, held: int = HELD_TERMS) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (rows that hold it). Tasks hand on sums, never single occurrences.

    The sums are dealt by language and term as they come, so that no second hash table beside a task's own holds them, and a window
    over language and term needs no other shuffle.
    """
    rows = docs.select(_filled("lang").alias("lang"), _filled("source").alias("source"), _filled("text").alias("text"))
    found = rows.mapInArrow(_count_terms(held), "lang string, source string, term string, n long, docs long")
    return found.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, whole: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / whole), exact for counts beyond the range of a product of longs."""
    top = (count.cast("decimal(20,0)") + 1) * F.lit(SCALE).cast("decimal(10,0)")
    return F.lit(1) + F.call_function("div", top, whole.cast("decimal(20,0)"))


def gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _block_bitmaps(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Bitsets of a block's terms by source and count. Ids are the places of the block's terms in byte order."""
    terms, ids = np.unique(rows["term"].to_numpy(object), return_inverse=True)
    width = -(-len(terms) // 64)
    out = []
    for (source, n), places in pd.Series(ids).groupby([rows["source"].to_numpy(), rows["n"].to_numpy()]):
        flags = np.zeros(width * 64, np.uint8)
        flags[places.to_numpy()] = 1
        out.append((source, int(n), np.packbits(flags, bitorder="little").tobytes()))
    made = pd.DataFrame(out, columns=["source", "n", "bits"])
    for name, value in zip(("lang", "size_class", "bucket"), key):
        made[name] = value
    made["terms"] = len(terms)
    return made


def count_bitmaps(kept: DataFrame) -> DataFrame:
    """lang, size_class, bucket, terms, source, n, bits: for each block of a language's terms, which terms a source has n times.

    `kept` holds lang, source, term, n and total (the term's count in the language). Terms of like frequency share a block, so a block
    has few counts where it has many terms. A block's rows are bounded by its terms times the sources.
    """
    classed = kept.withColumn("size_class", F.length(F.bin("total")).cast("int"))
    limit = F.lit(BLOCK_TERMS[-1][1])
    for bits, size in reversed(BLOCK_TERMS[:-1]):
        limit = F.when(F.col("size_class") <= bits, size).otherwise(limit)
    sizes = classed.select("lang", "term", "size_class").distinct().groupBy("lang", "size_class").agg(F.count(F.lit(1)).alias("_terms"))
    sizes = materialise(sizes.withColumn("_buckets", F.ceil(F.col("_terms") / limit).cast("int")).drop("_terms"))
    dealt = classed.join(sizes, ["lang", "size_class"]).withColumn("bucket", F.pmod(F.xxhash64("term"), F.col("_buckets")).cast("int"))
    return dealt.select("lang", "size_class", "bucket", "source", "term", "n").groupBy("lang", "size_class", "bucket").applyInPandas(
        _block_bitmaps, "lang string, size_class int, bucket int, terms long, source string, n long, bits binary"
    )


def _levels(rows: pd.DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Shares and bitsets of every source in a block; the count 0 has the complement of all others."""
    terms = int(rows["terms"].iloc[0])
    width = -(-terms // 64)
    full = np.zeros(width * 64, np.uint8)
    full[:terms] = 1
    full = np.packbits(full, bitorder="little").view(np.uint64)
    levels = {}
    for source, part in rows.groupby("source"):
        whole = int(part["whole"].iloc[0])
        held = part[part["n"] > 0]
        bits = np.frombuffer(b"".join(held["bits"]), np.uint64).reshape(-1, width)
        none = full & ~np.bitwise_or.reduce(bits, axis=0) if len(bits) else full
        counts = [0, *held["n"].tolist()]
        shares = np.array([1 + SCALE * (c + 1) // whole for c in counts], np.int64)
        levels[source] = shares, np.vstack([none[None, :], bits])
    return levels


def _gaps(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    apart = p[:, None] - q[None, :]
    return apart * apart // q[None, :]


def _pair_sums(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Values of all pairs of sources over one block: joint cells by AND and popcount, times the gap of their shares."""
    levels = _levels(rows)
    side = rows.groupby("source")["met"].first().to_dict()
    low, high = key[-2], key[-1]
    names = sorted(levels)
    out = []
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            if low != high and side[a] == side[b]:
                continue
            (p, ours), (q, theirs) = levels[a], levels[b]
            joint = np.empty((len(p), len(q)), np.int64)
            for level, bits in enumerate(ours):
                joint[level] = np.bitwise_count(bits[None, :] & theirs).sum(1, dtype=np.int64)
            out.append((a, b, int((joint * _gaps(p, q)).sum())))
            out.append((b, a, int((joint.T * _gaps(q, p)).sum())))
    made = pd.DataFrame(out, columns=["source", "item", "value"])
    made.insert(0, "lang", key[0])
    return made


def pair_values(bitmaps: DataFrame, groups: DataFrame, met: int = SOURCES_MET) -> DataFrame:
    """lang, source, item (another source of the language) and value, summed over all blocks.

    Every group meets every block: where it has none of a block's terms, all of them are at count 0. Sources are dealt into lots of
    about `met`, and a task takes one block and two lots.
    """
    lots = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / met).cast("int").alias("_lots"))
    dealt = materialise(
        groups.join(lots, "lang").withColumn("met", F.pmod(F.xxhash64("source"), F.col("_lots")).cast("int")).select("lang", "source", "whole", "met", "_lots")
    )
    block = ["lang", "size_class", "bucket"]
    blocks = bitmaps.select(*block, "terms").distinct()
    none = blocks.join(dealt, "lang").select(*block, "terms", "source", F.lit(0).cast("long").alias("n"), F.lit(None).cast("binary").alias("bits"), "whole", "met", "_lots")
    some = bitmaps.join(dealt, ["lang", "source"]).select(*none.columns)
    celled = (
        some.unionByName(none).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_lots") - 1)))
        .withColumn("low", F.least("met", "_other")).withColumn("high", F.greatest("met", "_other"))
    )
    found = celled.drop("_lots", "_other").groupBy(*block, "low", "high").applyInPandas(_pair_sums, "lang string, source string, item string, value long")
    sums = found.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").where("source <> item")
    return pairs.join(sums, ["lang", "source", "item"], "left").withColumn("value", F.coalesce("value", F.lit(0).cast("long")))


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS, met: int = SOURCES_MET, held: int = HELD_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source of a language is from the others, and by which terms from the language.

    Terms are runs of letters A-Z and of characters beyond ASCII; only A-Z are lower-cased. A language keeps the terms that at least
    `least_docs` of its documents (rows) hold. A group of language and source gives a kept term the smoothed share p of
    `share`. Part `pair` has every other source of the language, with the sum of (p - q)^2 / q over all kept terms, each
    floored, q being the other's share; part `term` the `top` terms the group has that stand furthest above the language's own share.

    Null text, language and source are empty strings; a group without terms has shares all the same, and a language without kept
    terms has pairs of value 0. Repeated rows are documents of their own. Ties go to the smaller item in UTF-8. An
    empty table gives an empty table. Other columns are not read.
    """
    counts = term_counts(docs, held)
    by_term = Window.partitionBy("lang", "term")  # a row per source
    kept = materialise(
        counts.withColumn("_docs", F.sum("docs").over(by_term)).withColumn("total", F.sum("n").over(by_term))
        .where(F.col("_docs") >= least_docs).select("lang", "source", "term", "n", "total")
    )
    size = kept.groupBy("lang", "term").agg(F.max("total").alias("total")).groupBy("lang").agg(F.count(F.lit(1)).alias("_v"), F.sum("total").alias("_n"))
    wholes = kept.groupBy(*GROUP).agg(F.sum("n").alias("_own"))
    everyone = docs.select(_filled("lang").alias("lang"), _filled("source").alias("source")).distinct()
    groups = materialise(
        everyone.join(wholes, GROUP, "left").join(size, "lang", "left").select(
            *GROUP, (F.coalesce("_own", F.lit(0)) + F.coalesce("_v", F.lit(0))).alias("whole"), (F.coalesce("_n", F.lit(0)) + F.coalesce("_v", F.lit(0))).alias("lang_whole")
        )
    )
    pairs = materialise(pair_values(materialise(count_bitmaps(kept)), groups, met))
    p, q = share(F.col("n"), F.col("whole")), share(F.col("total"), F.col("lang_whole"))
    rated = kept.join(groups, GROUP).select(*GROUP, F.col("term").alias("item"), p.alias("_p"), q.alias("_q")).where("_p > _q")
    terms = rated.select(*GROUP, "item", gap(F.col("_p"), F.col("_q")).alias("value"))
    best = Window.partitionBy(*GROUP).orderBy(F.desc("value"), "item")
    # only the best of each partition are shuffled, as the limit on the row number is applied before
    ranked = terms.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    paired = pairs.withColumn("rank", F.row_number().over(best))
    columns = [*GROUP, "part", "item", "value", "rank"]
    return paired.withColumn("part", F.lit("pair")).select(*columns).unionByName(ranked.withColumn("part", F.lit("term")).select(*columns))
