"""Proportional stratified interleaving of documents into shards. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import materialise, shuffle_width

#: Bytes added to each text for the record around it.
RECORD_BYTES = 16


def ranked(rows: DataFrame, order: list[str], out: str) -> DataFrame:
    """Add `out`: the zero-based place of each row in the stated order over the whole table.

    Rows are dealt by range and sorted there; the place within a range comes from the increasing id, and what lies in the ranges before is
    added to it. `order` should be unique, so that equal rows, however many, are spread over ranges. One row per range is broadcast.
    """
    ranges = rows.repartitionByRange(shuffle_width(rows.sparkSession), *order).sortWithinPartitions(*order)
    # the upper bits of the id are the range, the lower ones the place in it
    placed = materialise(ranges.withColumn("_id", F.monotonically_increasing_id()).withColumn("_range", F.shiftright("_id", 33)))
    counts = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows"))
    before = F.sum("_rows").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("_range", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(offsets), "_range").withColumn(out, F.col("_before") + inside).drop("_id", "_range", "_before")


def _draw(seed: int, *parts: Column) -> Column:
    """A repeatable random text of a row, the same in every engine that has md5."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def interleaved_shards(
    docs: DataFrame, shards: int = 40, seed: int = 17, id_column: str = "doc_id", text: str = "text", source: str = "source"
) -> DataFrame:
    """Shard and slot of every row, such that each shard repeats the mixture of sources.

    Rows of a source are put in a seeded random order and ranked; sorted by fractional rank
    ((rank + 0.5) / rows of the source) all sources advance at the same pace, and cutting that order into
    equal stretches gives shards whose row counts, in total and per source, differ by at most one
    (per source: two). Both rankings are range shuffles over narrow rows; no source is held in one task, and rows that are
    equal in all that is ranked are told apart by a number of their own.

    Nulls: a null text has no bytes, a null source is a source of its own, null ids sort first among
    equal draws. Repeated rows are separate rows. An empty table gives an empty table. Other columns
    are not read. Returns id, size, text_crc32, law, shard, slot (gapless from 0), grown_shard (null:
    the law is `rows`, under which a further shard moves rows everywhere).
    """
    if shards < 1:
        raise ValueError("shards must be 1 or more")
    rows = materialise(  # written, so that a row keeps its number
        docs.select(
            F.col(id_column).cast("long").alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + RECORD_BYTES).cast("long").alias("size"),
            F.coalesce(F.crc32(F.col(text).cast("string")), F.lit(0).cast("long")).alias("text_crc32"),
            F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("")).alias("_stratum"),
        ).withColumn("_draw", _draw(seed, F.col("doc_id"), F.col("text_crc32"))).withColumn("_number", F.monotonically_increasing_id())
    )
    listed = materialise(ranked(rows, ["_stratum", "_draw", "doc_id", "text_crc32", "size", "_number"], "_at"))
    strata = materialise(listed.groupBy("_stratum").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows")))
    paced = listed.join(strata, "_stratum").withColumn(
        "_pace", (F.col("_at") - F.col("_first") + F.lit(0.5)) / F.col("_rows")
    )
    placed = ranked(paced.select("doc_id", "size", "text_crc32", "_pace", "_stratum", "_at"), ["_pace", "_stratum", "_at"], "_place")
    total = strata.agg(F.sum("_rows").alias("n")).scalar()
    return (
        placed.withColumn("_total", total)
        .withColumn("_shard", F.expr(f"_place * {shards} div _total"))
        .withColumn("_begin", F.expr(f"(_shard * _total + {shards - 1}) div {shards}"))
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("rows").alias("law"),
            F.col("_shard").cast("int").alias("shard"),
            (F.col("_place") - F.col("_begin")).alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
