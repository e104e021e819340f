"""Landed news feed to sentiment counts per ticker and day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.labels import label_counts, normalise_label


def utc_instant(clock: str) -> Column:
    """Instant of a zone-free UTC clock time, whatever the session's time zone is."""
    return F.timestamp_micros(F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {clock})"))


def utc_day(moment: str) -> Column:
    return F.date_from_unix_date(F.floor(F.unix_seconds(moment) / 86400).cast("int"))


def stream_counts(feed: DataFrame, time: str, key: str, ident: str, label: str, late: str = "1 day") -> DataFrame:
    """Counts per UTC day; repeated ids are dropped, rows behind the watermark too."""
    flagged = feed.withColumns(label_counts(normalise_label(F.col(label))))
    return (
        flagged.withWatermark(time, late)
        .dropDuplicatesWithinWatermark([ident])
        .groupBy(F.window(time, "1 day").alias("window"), key)
        .agg(*[F.sum(c).cast("bigint").alias(c) for c in ("positive", "negative", "total")])
        .select(
            utc_day("window.start").alias("enterdate"), F.col(key), "positive", "negative", "total"
        )
    )


def run_available(counts: DataFrame, out: str, checkpoint: str) -> None:
    """Process what has landed, appending closed days to a table, then stop."""
    (
        counts.writeStream.outputMode("append")
        .format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )


def read_feed(spark: SparkSession, folder: str, schema: T.StructType, pattern: str) -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def land_and_count(
    spark: SparkSession, folder: str, schema: T.StructType, pattern: str, prepare, time: str, key: str, ident: str,
    label: str, out: str, checkpoint: str,
) -> DataFrame:
    """Run the feed over the files that landed since the last run with this checkpoint; return the table at `out`.

    A run that finds nothing new adds nothing.
    """
    counts = stream_counts(prepare(read_feed(spark, folder, schema, pattern)), time, key, ident, label)
    run_available(counts, out, checkpoint)
    return spark.read.schema(counts.schema).parquet(out)
