"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int | str = "*", app: str = "tidemark") -> SparkSession:
    """A session for tests and benchmarks; on a cluster the launcher supplies its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only in local mode."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not re.fullmatch(r"local(\[.*\])?", context.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="tidemark-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
    return spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()


def _scratch_root(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tidemark-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder for an intermediate table."""
    return f"{_scratch_root(spark)}/{uuid.uuid4().hex}/{name}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete the intermediate tables this application wrote."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(_scratch_root(spark))
    root.getFileSystem(spark._jsc.hadoopConfiguration()).delete(root, True)


def materialise(df: DataFrame) -> DataFrame:
    """Write `df` once to the shared folder and go on from there.

    Every later reader sees the same rows, a lost executor costs no recomputation, and unlike a
    checkpoint the last stage runs only once and readers can pick columns.
    """
    path = scratch_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Delete a table that `materialise` wrote and nothing will read again; one from elsewhere is left alone."""
    jvm = table.sparkSession._jvm
    root = f"{jvm.org.apache.hadoop.fs.Path(_scratch_root(table.sparkSession)).toUri().getPath()}/"
    for folder in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        if path.toUri().getPath().startswith(root):
            path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def packed_row(stats: DataFrame) -> Column:
    """A one-row table as one struct scalar, to be added once to another table."""
    return stats.select(F.struct(*stats.columns).alias("row")).scalar()


def one_row(stats: DataFrame) -> dict[str, Column]:
    """The columns of a one-row table as scalars for an expression that uses each once or twice."""
    row = packed_row(stats)
    return {c: row.getField(c) for c in stats.columns}


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
