"""CSV, sharded and paged JSON inputs; partitioned outputs. Schemas are always stated."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.order import values_at


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("multiLine", False).csv(path)


def read_shards(spark: SparkSession, folder: str, pattern: str, schema: T.StructType | str) -> DataFrame:
    """All files of a folder whose name matches, stacked in one scan."""
    return (
        spark.read.schema(schema).option("header", True).option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", True).csv(folder)
    )


def existing(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """Those of the listed paths that exist, asked of the file system that holds them."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    found = []
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        if place.getFileSystem(conf).exists(place):
            found.append(path)
    return found


def read_listed(spark: SparkSession, paths: Sequence[str], schema: T.StructType | str) -> DataFrame:
    """Stack the listed CSV files that exist, with the file name of every row."""
    present = existing(spark, paths)
    if not present:
        raise FileNotFoundError("none of the listed files exists")
    return read_csv(spark, present, schema).withColumn("source_file", F.col("_metadata.file_name"))


def read_pages(
    spark: SparkSession, path: str, record: T.StructType | str, one_page_per_file: bool = True
) -> DataFrame:
    """JSON pages, each a document with a `content` array, to one row per record.

    Landed pages are one document per file, or one per line, which can also be split inside a file.
    """
    inner = record if isinstance(record, T.StructType) else T.StructType.fromDDL(record)
    page = T.StructType([T.StructField("page", T.LongType()), T.StructField("content", T.ArrayType(inner))])
    return (
        spark.read.schema(page).option("multiLine", one_page_per_file).json(path)
        .select("page", F.explode("content").alias("record"))
        .select("page", "record.*")
    )


def stream_pages(spark: SparkSession, folder: str, record: T.StructType | str, files_at_once: int = 100) -> DataFrame:
    """The records of `read_pages` as a stream over a folder in which pages (one document per line) keep landing.

    The source notes in the query's checkpoint which files it has read, so a restart goes on after them; a page that lands
    is read once. Files are opened by Spark, so they may lie in any store it can read.
    """
    inner = record if isinstance(record, T.StructType) else T.StructType.fromDDL(record)
    page = T.StructType([T.StructField("page", T.LongType()), T.StructField("content", T.ArrayType(inner))])
    return (
        spark.readStream.schema(page).option("maxFilesPerTrigger", files_at_once).json(folder)
        .select("page", F.explode("content").alias("record"))
        .select("page", "record.*")
    )


def land_pages(records: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Append what has landed since the last run with this checkpoint to the table at `out`, and return the table."""
    writer = records.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    writer.trigger(availableNow=True).start().awaitTermination()
    return records.sparkSession.read.schema(records.schema).parquet(out)


def store_bucketed(df: DataFrame, path: str, key: str, order: Sequence[str], buckets: int) -> DataFrame:
    """Write a table dealt into buckets by `key` and sorted within them, and return it: windows and joins by the key need no shuffle.

    One file per bucket. The table's name is known to this session; its files lie at `path`.
    """
    name = f"bucketed_{uuid.uuid4().hex}"
    df.repartition(buckets, key).write.format("parquet").bucketBy(buckets, key).sortBy(key, *order).option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ()) -> None:
    """Replace the table at `path`; no index column is written."""
    writer = df.write.mode("overwrite").partitionBy(*partition_by)
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(fmt).save(path)


def with_shard(df: DataFrame, key: str, shards: int, out: str = "shard") -> DataFrame:
    """Equal contiguous shards numbered from 1 by a unique numeric key; the last takes the remainder.

    Only the keys at the shard borders are looked up. The rows themselves stay where they are.
    """
    rows = df.count()
    length = rows // shards
    if length == 0:
        return df.withColumn(out, F.lit(shards))
    borders = values_at(df.select(key), key, [i * length + 1 for i in range(1, shards)], rows)
    shard = F.lit(1)
    for border in borders:
        shard = shard + (F.col(key) >= F.lit(border)).cast("int")
    return df.withColumn(out, shard)
