"""Summaries of news and returns."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.values import ratio
from tidemark.operators import moments
from tidemark.operators.order import grouped_quantiles, quantile_values
from tidemark.session import materialise, one_row

NEWS = ("positive", "negative", "total")


def news_counts(news: DataFrame, keys: Sequence[str] = ("enterdate", "TICKER")) -> DataFrame:
    """Headlines to counts per key."""
    return news.groupBy(*keys).agg(*[F.sum(c).cast("bigint").alias(c) for c in NEWS])


def with_news(df: DataFrame) -> DataFrame:
    return df.filter(F.col("total") > 0)


def market_summary(df: DataFrame, keys: Sequence[str] = ("date", "sprtrn")) -> DataFrame:
    """News sums of each date with that date's market return."""
    return df.groupBy(*keys).agg(*[F.sum(c).alias(f"sum_{c}") for c in NEWS])


def _news_sums(prefix: str = "") -> list[Column]:
    return [
        F.sum(f"{prefix}positive").alias("total_positive"),
        F.sum(f"{prefix}negative").alias("total_negative"),
        F.sum(f"{prefix}total").alias("total"),
    ]


def with_shares(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "positive_perc": ratio(F.col("total_positive"), F.col("total")),
            "negative_perc": ratio(F.col("total_negative"), F.col("total")),
        }
    )


def frequency(df: DataFrame, column: str) -> DataFrame:
    """Rows per value."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("frequency"))


def shares(df: DataFrame, column: str) -> DataFrame:
    """Count and share of every category."""
    counts = frequency(df, column)
    whole = one_row(counts.agg(F.sum("frequency").alias("n")))["n"]
    return counts.withColumn("share", ratio(F.col("frequency"), whole))


def industry_summary(df: DataFrame, industry: Column, min_firms: int | None = None) -> DataFrame:
    """Firms, summed return and news by industry, kept above a number of firms."""
    result = (
        df.groupBy(industry.alias("industry"))
        .agg(F.countDistinct("TICKER").alias("num_firms"), F.sum("RET").alias("cum_ret"), *_news_sums())
    )
    if min_firms is not None:
        result = result.filter(F.col("num_firms") > min_firms)
    return with_shares(result)


def per_company(df: DataFrame) -> DataFrame:
    """News per firm on an industry summary."""
    return df.withColumns(
        {
            "tot_per_comp": ratio(F.col("total"), F.col("num_firms")),
            "pos_per_comp": ratio(F.col("total_positive"), F.col("num_firms")),
            "neg_per_comp": ratio(F.col("total_negative"), F.col("num_firms")),
        }
    )


def size_summary(df: DataFrame, group: str, ret: str = "RET") -> DataFrame:
    """Summed return and news by size group."""
    return with_shares(df.groupBy(group).agg(F.sum(ret).alias("sum_ret"), *_news_sums()))


def market_band_summary(df: DataFrame, band: str, market: str = "sprtrn") -> DataFrame:
    """Mean market return and news by band of a market summary."""
    return df.groupBy(band).agg(F.avg(market).alias("avg_sprtn"), *_news_sums("sum_"))


def stock_band_summary(df: DataFrame, band: str, ret: str = "RET") -> DataFrame:
    """Mean return, mean previous return and news by band of stock returns."""
    return with_shares(
        df.groupBy(band).agg(
            F.avg(ret).alias("avg_ret"), F.avg("lagged_return").alias("avg_lag_ret"), *_news_sums()
        )
    )


def by_news_count(
    df: DataFrame, count: str, ret: str = "RET", market: str = "sprtrn", below: int | None = None
) -> DataFrame:
    """Return statistics for every exact number of news items."""
    kept = df if below is None else df.filter(F.col(count) < below)
    return kept.groupBy(F.col(count).alias("news_count")).agg(
        F.count(F.lit(1)).alias("num_obs"),
        F.avg(ret).alias("avg_return"),
        F.avg("lagged_return").alias("avg_lagged_return"),
        F.stddev_samp(ret).alias("volatility"),
        F.stddev_samp("lagged_return").alias("lag_volatility"),
        F.avg(market).alias("sprtrn"),
        F.stddev_samp(market).alias("sp_vol"),
    )


def describe(df: DataFrame, value: str, groups: Sequence[str] = ()) -> DataFrame:
    """Count, mean, deviation, minimum, quartiles and maximum, plain or by group."""
    moments = df.groupBy(*groups).agg(
        F.count(value).alias("count"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )
    if groups:
        quartiles = grouped_quantiles(df, value, [0.25, 0.5, 0.75], ["q25", "q50", "q75"], groups)
        return moments.join(quartiles, list(groups), "left")
    values = quantile_values(df, value, [0.25, 0.5, 0.75])
    return moments.withColumns({n: F.lit(v).cast("double") for n, v in zip(("q25", "q50", "q75"), values)})


def describe_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """`describe` for many columns in one go, one row per column."""
    wide = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    return describe(wide.unpivot([], list(columns), "column", "value"), "value", ["column"])


def box_stats(df: DataFrame, value: str, groups: Sequence[str]) -> DataFrame:
    """Quartiles, spread between them and whisker limits by group."""
    quartiles = grouped_quantiles(df, value, [0.25, 0.5, 0.75], ["q25", "q50", "q75"], groups)
    return (
        quartiles.withColumn("iqr", F.col("q75") - F.col("q25"))
        .withColumn("lower_limit", F.col("q25") - 1.5 * F.col("iqr"))
        .withColumn("upper_limit", F.col("q75") + 1.5 * F.col("iqr"))
    )


def compounded_return(column: str) -> Column:
    return F.product(1 + F.col(column)) - 1


def mode_per_group(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """Most frequent value, the smallest on ties."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*groups).agg(F.min(F.struct((-F.col("_n")).alias("a"), F.col(value).alias("b"))).b.alias("mode"))


def top_groups(df: DataFrame, key: str, measure: Column, n: int) -> DataFrame:
    """The n largest groups by a measure, ties by key."""
    return df.groupBy(key).agg(measure.alias("measure")).orderBy(F.desc("measure"), F.asc(key)).limit(n)


def largest_companies(df: DataFrame, n: int) -> DataFrame:
    """Rows of the n tickers with the highest mean market capitalisation."""
    kept = top_groups(df, "TICKER", F.avg("market_cap"), n).select("TICKER")
    return df.join(kept, "TICKER", "left_semi")


def _stack(df: DataFrame, rows: Sequence[Column]) -> DataFrame:
    return df.select(F.inline(F.array(*rows)))


def dummy_contrast(df: DataFrame, value: str, dummies: Sequence[str]) -> DataFrame:
    """Mean and deviation with and without each dummy, and their differences."""
    parts = []
    for d in dummies:
        for flag in (1, 0):
            x = F.when(F.col(d) == flag, F.col(value))
            parts += [F.avg(x).alias(f"m_{d}_{flag}"), F.stddev_samp(x).alias(f"s_{d}_{flag}")]
    rows = [
        F.struct(
            F.lit(d).alias("dummy"),
            F.col(f"m_{d}_1").alias("mean_with"),
            F.col(f"m_{d}_0").alias("mean_without"),
            F.col(f"s_{d}_1").alias("volatility_with"),
            F.col(f"s_{d}_0").alias("volatility_without"),
            (F.col(f"m_{d}_1") - F.col(f"m_{d}_0")).alias("mean_difference"),
            (F.col(f"s_{d}_1") - F.col(f"s_{d}_0")).alias("volatility_difference"),
        )
        for d in dummies
    ]
    return _stack(df.agg(*parts), rows)


def shape(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Skewness and excess kurtosis with the small-sample correction, one row per column."""
    parts = []
    for c in columns:
        x = F.col(c).cast("double")
        parts += [F.count(x).alias(f"n_{c}"), F.skewness(x).alias(f"g_{c}"), F.kurtosis(x).alias(f"k_{c}")]
    rows = []
    for c in columns:
        n, g, k = F.col(f"n_{c}").cast("double"), F.col(f"g_{c}"), F.col(f"k_{c}")
        skew = F.when(n > 2, ratio(F.sqrt(n * (n - 1)), n - 2) * g)
        kurt = F.when(n > 3, ratio(n - 1, (n - 2) * (n - 3)) * ((n + 1) * k + 6))
        rows.append(F.struct(F.lit(c).alias("column"), skew.alias("skewness"), kurt.alias("kurtosis")))
    return _stack(df.agg(*parts), rows)


def histogram(df: DataFrame, columns: Sequence[str], bins: int) -> DataFrame:
    """Equal-width counts for each column, empty bins included, last edge closed.

    The columns are written once; their limits enter the counting pass as literals.
    """
    rows = materialise(df.select(*[F.col(c).cast("double").alias(c) for c in columns]))
    limits = rows.agg(*[f(c).alias(f"{f.__name__}_{c}") for c in columns for f in (F.min, F.max)]).first()
    edges = [(c, limits[f"min_{c}"], limits[f"max_{c}"]) for c in columns]

    def cell(c: str, low: float | None, high: float | None) -> Column:
        flat = low is None or high == low
        place = F.lit(0.0) if flat else (F.col(c) - F.lit(low)) / F.lit(high - low) * bins
        return F.struct(F.lit(c).alias("column"), F.when(F.col(c).isNotNull(), F.least(F.floor(place), F.lit(bins - 1))).alias("bin"))

    counted = (
        rows.select(F.inline(F.array(*[cell(*e) for e in edges]))).filter(F.col("bin").isNotNull())
        .groupBy("column", "bin").agg(F.count(F.lit(1)).alias("n"))
    )
    grid = df.sparkSession.createDataFrame(
        [(c, i, low if low is None else low + i * ((high - low) / bins)) for c, low, high in edges for i in range(bins)],
        "column string, bin long, edge double",
    )
    return grid.join(counted, ["column", "bin"], "left").select("column", "bin", "edge", F.coalesce("n", F.lit(0)).alias("n"))


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pairwise correlation on rows where every column is present, upper triangle.

    The rows are read once; only the columns-by-columns matrices of the tasks reach the driver.
    """
    complete = df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in columns]).dropna()
    n, _, products = moments.centred_moments(complete, columns)
    spread = np.sqrt(np.diag(products))
    spread[spread <= 1e-12 * np.sqrt(max(n - 1, 1))] = np.nan  # a constant column has no correlation
    matrix = products / np.outer(spread, spread)
    rows = [
        (a, b, float(matrix[i, j]) if np.isfinite(matrix[i, j]) else None)
        for i, a in enumerate(columns)
        for j, b in enumerate(columns)
        if i < j
    ]
    return df.sparkSession.createDataFrame(rows, "a string, b string, correlation double")


def sign_confusion(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Counts of actual against predicted sign; zero counts as negative."""
    def sign(c: str) -> Column:
        return F.when(F.col(c) > 0, "Positive").when(F.col(c).isNotNull(), "Negative")

    return (
        df.select(sign(actual).alias("actual"), sign(predicted).alias("predicted"))
        .dropna()
        .groupBy("actual", "predicted")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def quadrants(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Rows in each strict quadrant of actual against predicted."""
    a, p = F.col(actual), F.col(predicted)
    cells = {
        "Upper Right": (p > 0) & (a > 0),
        "Upper Left": (p > 0) & (a < 0),
        "Lower Right": (p < 0) & (a > 0),
        "Lower Left": (p < 0) & (a < 0),
    }
    counts = df.agg(*[F.count(F.when(c, 1)).alias(k) for k, c in cells.items()])
    return _stack(counts, [F.struct(F.lit(k).alias("quadrant"), F.col(k).alias("n")) for k in cells])


def class_agreement(df: DataFrame, predicted: str, ret: str) -> DataFrame:
    """Five-way agreement of a predicted class with the sign of the return."""
    up, down = F.col(predicted) == "Positive", F.col(predicted) == "Negative"
    kind = (
        F.when(up & (F.col(ret) > 0), "Both Positive")
        .when(down & (F.col(ret) < 0), "Both Negative")
        .when(up & (F.col(ret) < 0), "One Positive and One Negative")
        .when(down & (F.col(ret) > 0), "One Negative and One Positive")
        .otherwise("Other")
    )
    return df.groupBy(kind.alias("agreement")).agg(F.count(F.lit(1)).alias("n"))


def category_counts_by_sign(df: DataFrame, columns: Sequence[str], ret: str) -> DataFrame:
    """Value counts of every categorical column, split by the sign of the return."""
    sign = F.when(F.col(ret) >= 0, "positive").when(F.col(ret) < 0, "negative")
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    return (
        df.select(sign.alias("sign"), F.inline(cells))
        .dropna()
        .groupBy("column", "value", "sign")
        .agg(F.count(F.lit(1)).alias("n"))
    )
