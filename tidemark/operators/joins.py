"""Joins of news, prices, lookups and annual tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.frames import keep_first
from tidemark.operators.order import row_index
from tidemark.session import materialise, one_row


def articles_with_prices(news: DataFrame, prices: DataFrame) -> DataFrame:
    """News rows with that day's price row; the price date is dropped. Prices have one row per ticker and day."""
    return lookup_join(news, prices.withColumnRenamed("date", "enterdate"), ["TICKER", "enterdate"])


def restrict_to(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key occurs in the other table."""
    return df.join(other.select(*keys).distinct(), list(keys), "left_semi")


def build_panel(prices: DataFrame, counts: DataFrame) -> DataFrame:
    """Prices of tickers that ever had news, with daily news counts, zero where none."""
    daily = counts.withColumn("date", F.col("enterdate"))
    return (
        restrict_to(prices, counts, ["TICKER"])
        .join(daily, ["TICKER", "date"], "left")
        .fillna(0, ["positive", "negative", "total"])
    )


def next_day_returns(
    news: DataFrame, prices: DataFrame, flags: Sequence[str], keys: Sequence[str]
) -> DataFrame:
    """News of a day against the price row of the next calendar day; rows without a return go.

    Prices have one row per date and key.
    """
    moved = news.withColumn("date", F.date_add("date", 1)).withColumnsRenamed(
        {f: f"yesterday_{f}" for f in flags}
    )
    return lookup_join(moved, prices, ["date", *keys]).dropna(subset=["RET"])


def join_by_position(
    left: DataFrame, right: DataFrame, left_order: Sequence[str], right_order: Sequence[str]
) -> DataFrame:
    """Row i with row i, each side in its stated (unique) order."""
    return (
        row_index(left, left_order, "_position")
        .join(row_index(right, right_order, "_position"), "_position")
        .drop("_position")
    )


def lookup_join(
    facts: DataFrame, lookup: DataFrame, keys: Sequence[str], how: str = "left", hot_share: float = 0.002, copies: int = 64,
) -> DataFrame:
    """Join a table to a lookup with one row per key, safe when few keys or missing keys hold most rows.

    Keys holding at least `hot_share` of the facts (so at most 1 / hot_share keys) are split over `copies` salted
    copies of their lookup row, and facts with a null key, which match nothing, are spread by the same salt. The
    salt is a hash of the whole row, so a rerun task gives every row the same salt. The salted lookup is
    written, so that Spark broadcasts it when its size in bytes allows. Only joins that keep no unmatched
    lookup rows are offered: a salted copy that meets no fact must not come out.
    """
    if how not in ("left", "inner"):
        raise ValueError(f"lookup_join is a left or inner join, not {how}")
    keys = list(keys)
    counts = facts.dropna(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    size = one_row(facts.agg(F.count(F.lit(1)).alias("n")))["n"]
    hot = materialise(counts.filter(F.col("_n") >= size * hot_share).select(*keys, F.lit(True).alias("_hot")))
    hot = F.broadcast(hot)  # at most 1 / hot_share rows
    salt = F.pmod(F.xxhash64(*facts.columns), F.lit(copies)).cast("int")
    missing = F.greatest(*[F.col(k).isNull() for k in keys], F.lit(False))
    salted = facts.join(hot, keys, "left").withColumn("_salt", F.when(F.col("_hot") | missing, salt).otherwise(0))
    spread = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(copies - 1))).otherwise(F.array(F.lit(0)))
    copied = materialise(lookup.join(hot, keys, "left").withColumn("_salt", F.explode(spread)).drop("_hot"))
    return salted.drop("_hot").join(copied, [*keys, "_salt"], how).drop("_salt")


def attach_tickers(headlines: DataFrame, codes: DataFrame, key: str = "gvkey", ticker: str = "TICKER") -> DataFrame:
    """Give headlines the first ticker of their company code; unmatched headlines go."""
    single = keep_first(codes.select(key, ticker).dropna(), [key], [ticker])
    return lookup_join(headlines, single, [key]).dropna(subset=[ticker])


def complement(df: DataFrame, sample: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows that are not in the sample."""
    return df.join(sample.select(*keys), list(keys), "left_anti")
