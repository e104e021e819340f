"""Row and column shaping."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def profile(df: DataFrame) -> DataFrame:
    """Type and non-null count of every column, from one aggregate over the table."""
    counts = df.agg(*[F.count(c).alias(c) for c in df.columns], F.count(F.lit(1)).alias("_rows"))
    rows = [
        F.struct(
            F.lit(f.name).alias("column"),
            F.lit(f.dataType.simpleString()).alias("type"),
            F.col(f.name).alias("non_null"),
            F.col("_rows").alias("rows"),
        )
        for f in df.schema.fields
    ]
    return counts.select(F.inline(F.array(*rows)))


def preview(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows in the stated order."""
    return df.orderBy(*order).limit(n)


def slice_columns(df: DataFrame, start: int, stop: int) -> DataFrame:
    """Columns by position, the end excluded."""
    return df.select(*df.columns[start:stop])


def upper_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.upper() for c in df.columns])


def as_text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Turn ids into strings so they are treated as categories."""
    return df.withColumns({c: F.col(c).cast("string") for c in columns})


def drop_missing(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.dropna(how="any", subset=list(columns) if columns else None)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the first in the stated order.

    Written as an aggregate, so a key with very many rows is reduced before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    ranked = [c for c in order if c not in keys] + [c for c in rest if c not in order]
    first = df.groupBy(*keys).agg(F.min(F.struct(*ranked)).alias("_first"))
    return first.select(*[F.col(c) if c in keys else F.col(f"_first.{c}").alias(c) for c in df.columns])


def explode_tickers(df: DataFrame, source: str, out: str) -> DataFrame:
    """`EXCHANGE:AAA, BBB` to one row per ticker."""
    listed = F.element_at(F.split(F.col(source), ":"), -1)
    return df.withColumn(out, F.explode(F.split(listed, ", ")))


def override(df: DataFrame, keys: Sequence[str], column: str, corrections: DataFrame) -> DataFrame:
    """Replace `column` where the key is in `corrections`, whatever was there before.

    `corrections` has the key columns and `column`, one row per key.
    """
    fixes = corrections.select(*keys, F.col(column).alias("_fix"))
    return (
        df.join(fixes, list(keys), "left")
        .withColumn(column, F.coalesce("_fix", F.col(column)))
        .select(*df.columns)
    )


def append_rows(df: DataFrame, rows: Sequence[Mapping]) -> DataFrame:
    """Add literal rows; columns not named are null."""
    names = list(rows[0])
    schema = T.StructType([T.StructField(n, df.schema[n].dataType) for n in names])
    extra = df.sparkSession.createDataFrame([tuple(r[n] for n in names) for r in rows], schema)
    return df.unionByName(extra, allowMissingColumns=True)


def stack_tables(tables: Sequence[DataFrame]) -> DataFrame:
    """Tables under each other by column name."""
    result = tables[0]
    for table in tables[1:]:
        result = result.unionByName(table, allowMissingColumns=True)
    return result


def to_long(df: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str, value: str) -> DataFrame:
    """One row per key and column."""
    return df.unpivot(list(keys), list(columns), name, value)
