"""Per-ticker series: lags, averages, compounding, standardising.

All windows here run over (TICKER, date). A panel has one row per ticker and day
(`one_row_per_day` makes it so), so a window partition holds at most as many rows as there are
days, whatever the size of the table. Every window of a feature build shares the same
partitioning and order, so Spark shuffles once for all of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import Frequency
from tidemark.functions.values import at_least_one, ratio
from tidemark.operators.frames import keep_first
from tidemark.operators.order import quantile_values


def by_ticker(date: str = "date", ticker: str = "TICKER"):
    return Window.partitionBy(ticker).orderBy(date)


def one_row_per_day(df: DataFrame, ticker: str = "TICKER", date: str = "date") -> DataFrame:
    """Enforce the (ticker, date) key that the ordered windows rely on."""
    return keep_first(df, [ticker, date], [])


def shifted(column: str, steps: int, date: str = "date", ticker: str = "TICKER") -> Column:
    """Value `steps` rows later (negative: earlier) within the ticker."""
    w = by_ticker(date, ticker)
    return F.lead(column, steps).over(w) if steps > 0 else F.lag(column, -steps).over(w)


def with_lags(df: DataFrame, freq: Frequency, date: str = "date") -> DataFrame:
    return df.withColumns(
        {
            freq.target: shifted("RET", 1, date),
            freq.previous_return: shifted("RET", -1, date),
            freq.previous_volume: shifted("VOL", -1, date),
        }
    )


def with_lagged_return(df: DataFrame, column: str = "RET", date: str = "date") -> DataFrame:
    """Previous return; the first row of each ticker is dropped."""
    return df.withColumn("lagged_return", shifted(column, -1, date)).filter(F.col("lagged_return").isNotNull())


def rolling_mean(column: str, rows: int, date: str = "date") -> Column:
    """Mean of the last `rows` rows, null until the window is full."""
    w = by_ticker(date).rowsBetween(1 - rows, 0)
    return F.when(F.count(column).over(w) == rows, F.avg(column).over(w))


def with_averages(df: DataFrame, freq: Frequency, date: str = "date") -> DataFrame:
    """Price averages and whether they stand in order short > mid > long."""
    averaged = df.withColumns(
        {name: rolling_mean("PRC", n, date) for name, n in zip(freq.average_columns, freq.averages)}
    )
    short, mid, long = (F.col(f"`{c}`") for c in freq.average_columns)
    return averaged.withColumn("proper", F.coalesce((short > mid) & (mid > long), F.lit(False)))


def average_above_price(average: Column, price: Column) -> Column:
    """1 when the average is above the price, 0 when not, null when either is missing."""
    return F.when(average > price, 1).when(average <= price, 0)


def with_features(df: DataFrame, freq: Frequency, date: str = "date") -> DataFrame:
    """Lags, averages, spread and news dummies on one shuffle by ticker."""
    return with_averages(with_lags(df, freq, date), freq, date).withColumns(
        {
            "Ask_minus_Bid": F.col("ASKHI") - F.col("BIDLO"),
            "dummy_negative": at_least_one(F.col("negative")),
            "dummy_positive": at_least_one(F.col("positive")),
            "dummy_total": at_least_one(F.col("total")),
        }
    )


def drop_outliers(df: DataFrame, column: str, limit: float = 3.0) -> DataFrame:
    """Rows within `limit` standard deviations of the mean of the table, which is read twice: give it a stored one.

    The mean and the deviation enter the filter as literals.
    """
    mean, std = df.agg(F.avg(column), F.stddev_samp(column)).first()
    if mean is None or not std:
        return df.filter(F.lit(False))
    return df.filter(F.abs((F.col(column) - F.lit(mean)) / F.lit(std)) < limit)


def standardise(df: DataFrame, columns: Sequence[str], ticker: str = "TICKER") -> DataFrame:
    """Distance from the ticker's mean in sample standard deviations; null where that is zero."""
    whole = Window.partitionBy(ticker)
    return df.withColumns(
        {c: ratio(F.col(c) - F.avg(c).over(whole), F.stddev_samp(c).over(whole)) for c in columns}
    )


def percent_change(column: str, date: str = "DATE", ticker: str = "TICKER") -> Column:
    return ratio(F.col(column), shifted(column, -1, date, ticker)) - 1


def compounded(column: str, date: str = "DATE", ticker: str = "TICKER") -> Column:
    """Running product of 1 + return, minus 1."""
    w = by_ticker(date, ticker).rowsBetween(Window.unboundedPreceding, 0)
    return F.product(1 + F.coalesce(F.col(column), F.lit(0.0))).over(w) - 1


def trim_to_quantiles(
    df: DataFrame, train: DataFrame, column: str, low: float = 0.025, high: float = 0.975
) -> DataFrame:
    """Rows inside the quantiles of the train set, both ends included."""
    bottom, top = quantile_values(train, column, [low, high])
    return df.filter(F.col(column).between(F.lit(bottom), F.lit(top)))
