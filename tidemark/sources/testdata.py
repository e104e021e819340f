"""The project's tables, seen through the driver's parquet files.

Sums behind prices and returns are taken over whole cents and whole millionths, so a value does
not depend on the order of addition and is the same each time it is computed.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import BY_NAME
from tidemark.operators.resample import resample
from tidemark.operators.windows import with_features

NUMERIC = ["PRC", "ASKHI", "BIDLO", "VOL", "SHROUT", "RET", "sprtrn", "market_cap", "Ask_minus_Bid"]


class Tables:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def __getitem__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    @cached_property
    def prices(self) -> DataFrame:
        """One row per supplier and ship day: the price table without market and company data."""
        unit = F.col("l_extendedprice") / F.col("l_quantity")
        flag = F.col("l_returnflag")
        spread = (F.rint(F.col("l_discount") * 100) - F.rint(F.col("l_tax") * 100)).cast("bigint")
        return (
            self["lineitem"]
            .groupBy("l_suppkey", F.to_date("l_shipdate").alias("date"))
            .agg(
                F.sum(F.rint(F.col("l_extendedprice") * 100).cast("bigint")).alias("_cents"),
                F.sum("l_quantity").alias("VOL"),
                F.max(unit).alias("ASKHI"),
                F.min(unit).alias("BIDLO"),
                F.count(F.lit(1)).alias("SHROUT"),
                F.sum(spread).alias("_spread"),
                F.count(F.when(flag == "A", 1)).alias("positive"),
                F.count(F.when(flag == "R", 1)).alias("negative"),
                F.count(F.when(flag.isin("A", "R"), 1)).alias("total"),
            )
            .withColumn("_micro", F.floor(F.col("_spread") * 10000.0 / F.col("SHROUT") + 0.5))
            .withColumn("PRC", F.col("_cents") / (F.col("VOL") * 100.0))
            .withColumn("RET", F.col("_micro") / 1e6)
            .withColumn("market_cap", F.col("PRC") * F.col("SHROUT"))
            .withColumn("TICKER", F.col("l_suppkey").cast("string"))
        )

    @cached_property
    def panel(self) -> DataFrame:
        """Prices with the market return of the day and the company's name and industry."""
        market = self.prices.groupBy("date").agg((F.sum("_micro") / (F.count(F.lit(1)) * 1e6)).alias("sprtrn"))
        firms = self["supplier"].select(
            F.col("s_suppkey").alias("l_suppkey"),
            (F.col("s_nationkey") * 10 + F.col("s_suppkey") % 10).cast("bigint").alias("SICCD"),
            F.col("s_name").alias("COMNAM"),
        )
        return (
            self.prices.join(F.broadcast(market), "date")  # one row per calendar day, however much data there is
            .join(firms, "l_suppkey")
            .select(
                "TICKER", "date", "COMNAM", "SICCD", "PRC", "ASKHI", "BIDLO", "VOL", "SHROUT", "RET", "positive",
                "negative", "total", "market_cap", "sprtrn",
            )
        )

    def periods(self, freq: str) -> DataFrame:
        return self.panel if freq == "daily" else resample(self.panel, freq)

    def features(self, freq: str = "daily", source: str = "panel") -> DataFrame:
        """Lags, averages and dummies; `source="prices"` leaves out market and company columns."""
        rows = getattr(self, source) if freq == "daily" else self.periods(freq)
        return with_features(rows, BY_NAME[freq])

    def scored_at(self, freq: str) -> DataFrame:
        """Features with simple fixed predictors in the place of fitted models."""
        before = F.col(BY_NAME[freq].previous_return)
        return self.features(freq).withColumns(
            {
                "lasso_pred": -before,
                "pred_forest": F.col("RET") - F.col("sprtrn"),
                "log_pred": F.when(before >= 0, "Positive").when(before < 0, "Negative"),
            }
        )

    @property
    def scored(self) -> DataFrame:
        return self.scored_at("daily")

    @property
    def news(self) -> DataFrame:
        """Events as headlines: one row each, the event type as free text."""
        words = (
            F.when(F.col("event_type") == "purchase", "Positive.")
            .when(F.col("event_type") == "error", "This is NEGATIVE")
            .when(F.col("event_type") == "view", F.lit(None).cast("string"))
            .otherwise("mixed")
        )
        return self["events"].select(
            "event_id", "ts", F.col("user_id").cast("string").alias("TICKER"), F.to_date("ts").alias("enterdate"),
            "event_type", words.alias("Sentiment"), "value", "props",
        )

    @property
    def event_prices(self) -> DataFrame:
        """A price row per user and day of the events table."""
        cents = F.sum(F.rint(F.col("value") * 100).cast("bigint"))
        return self["events"].groupBy(F.col("user_id").cast("string").alias("TICKER"), F.to_date("ts").alias("date")).agg(
            (cents / (F.count(F.lit(1)) * 100.0)).alias("PRC"),
            (F.floor(cents * 100.0 / F.count(F.lit(1)) + 0.5) / 1e6).alias("RET"),
            (F.min("user_id") % 7).alias("SICCD"),
        )

    @property
    def pay(self) -> DataFrame:
        """Orders as executive pay: customer as person, nation as company, order year as year."""
        people = self["customer"].select("c_custkey", "c_nationkey", "c_acctbal")
        return self["orders"].join(people, F.col("o_custkey") == F.col("c_custkey")).select(
            F.col("c_nationkey").cast("string").alias("TICKER"),
            F.col("o_custkey").alias("EXEC_FULLNAME"),
            F.year("o_orderdate").alias("YEAR"),
            "o_orderkey",
            (F.col("o_totalprice") / 10).alias("SALARY"),
            F.col("c_acctbal").alias("BONUS"),
            F.col("o_totalprice").alias("TDC1"),
        )

    @property
    def price_path(self) -> DataFrame:
        """Customer price series: the first order of each day."""
        return self["orders"].groupBy(
            F.col("o_custkey").cast("string").alias("TICKER"), F.to_date("o_orderdate").alias("DATE")
        ).agg(F.min_by("o_totalprice", "o_orderkey").alias("CLOSE"))
