"""Daily panel to weeks and months."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.dates import period_end, period_start
from tidemark.operators.aggregates import compounded_return


def steady(value: Column, places: int) -> Column:
    """Round off the last bits, which depend on the order rows were added in.

    Period values are compared and ranked later, so they must be the same in every evaluation.
    """
    return F.rint(value * 10.0**places) / 10.0**places


def resample(panel: DataFrame, freq: str) -> DataFrame:
    """Calendar periods per ticker named by their last day, empty periods kept.

    Weeks end on Monday, months on their last day. Returns compound. An empty period has zero
    news, zero return and nulls elsewhere. Gaps are filled from each row to the next one of
    the ticker, so no calendar is joined.
    """
    periods = panel.groupBy("TICKER", period_end(F.col("date"), freq).alias("date")).agg(
        F.min_by("SICCD", "date").alias("SICCD"),
        F.min_by("COMNAM", "date").alias("COMNAM"),
        steady(F.avg("market_cap"), 8).alias("market_cap"),
        F.avg("SHROUT").alias("SHROUT"),
        F.avg("VOL").alias("VOL"),
        steady(F.avg("PRC"), 8).alias("PRC"),
        F.max("ASKHI").alias("ASKHI"),
        F.min("BIDLO").alias("BIDLO"),
        F.sum("total").alias("total"),
        F.sum("negative").alias("negative"),
        F.sum("positive").alias("positive"),
        steady(compounded_return("sprtrn"), 12).alias("sprtrn"),
        steady(compounded_return("RET"), 12).alias("RET"),
    )
    following = F.lead("date").over(Window.partitionBy("TICKER").orderBy("date"))
    if freq == "weekly":
        last = F.greatest(F.date_sub(following, 7), F.col("date"))
        steps = F.sequence("date", F.coalesce(last, F.col("date")), F.expr("interval 7 days"))
        day = F.col("_step")
    else:
        last = F.greatest(F.add_months(F.trunc(following, "MM"), -1), F.to_date(F.trunc("date", "MM")))
        first = F.to_date(F.trunc("date", "MM"))
        steps = F.sequence(first, F.coalesce(last, first), F.expr("interval 1 month"))
        day = F.last_day("_step")
    spread = periods.withColumn("_steps", steps).select("*", F.explode("_steps").alias("_step")).drop("_steps")
    real = day == F.col("date")
    zero = {"total", "negative", "positive", "sprtrn", "RET"}
    values = []
    for c in periods.columns:
        if c in ("TICKER", "date"):
            continue
        empty = F.lit(0).cast(periods.schema[c].dataType) if c in zero else F.lit(None)
        values.append(F.when(real, F.col(c)).otherwise(empty).alias(c))
    return spread.select("TICKER", day.alias("date"), *values)


def rollup(panel: DataFrame, freq: str) -> DataFrame:
    """Weeks from Sunday or months by their first day, returns summed, no empty periods.

    Industry and name come from the ticker's earliest day in the period.
    """
    return panel.groupBy("TICKER", period_start(F.col("date"), freq).alias("start")).agg(
        F.min_by("SICCD", "date").alias("SICCD"),
        F.min_by("COMNAM", "date").alias("COMNAM"),
        steady(F.avg("market_cap"), 8).alias("mean_market_cap"),
        F.avg("SHROUT").alias("mean_SHROUT"),
        F.avg("VOL").alias("mean_VOL"),
        steady(F.avg("PRC"), 8).alias("mean_PRC"),
        F.max("ASKHI").alias("max_ASKHI"),
        F.min("BIDLO").alias("min_BIDLO"),
        F.sum("total").alias("sum_total"),
        F.sum("negative").alias("sum_negative"),
        F.sum("positive").alias("sum_positive"),
        steady(F.sum("sprtrn"), 10).alias("sum_sprtrn"),
        steady(F.sum("RET"), 10).alias("sum_RET"),
    )


def market_rollup(periods: DataFrame) -> DataFrame:
    """News of each period with the market return of its first ticker."""
    return periods.groupBy("start").agg(
        F.min_by("sum_sprtrn", "TICKER").alias("sum_sprtrn"),
        F.sum("sum_positive").alias("sum_positive"),
        F.sum("sum_negative").alias("sum_negative"),
        F.sum("sum_total").alias("sum_total"),
    )
