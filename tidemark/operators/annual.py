"""Annual company factors: pay, tenure, developments, filing counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.values import lookup, ratio
from tidemark.operators.frames import append_rows, override

# Pay measures summarised by (TICKER, YEAR).
PAY_MEASURES = ("SALARY", "BONUS", "TDC1", "SAL_PCT", "TDC1_PCT", "PAGE", "ISR", "TENURE")

# Company names of the key developments file and their tickers.
COMPANY_TICKERS = {
    "Alphabet Inc.": "GOOGL",
    "Apple Inc.": "AAPL",
    "Meta Platforms, Inc.": "META",
    "Microsoft Corporation": "MSFT",
    "NVIDIA Corporation": "NVDA",
    "Tesla, Inc.": "TSLA",
    "Walmart Inc.": "WMT",
    "Eli Lilly and Company": "LLY",
    "J.P. Morgan Exchange-Traded Fund Trust - JPMorgan Social Advancement ETF": "JPM",
}

# Filing counts corrected by hand, and the row that was missing.
CULTURE_CORRECTIONS = (
    ("aapl", 2014, 3.0), ("nvda", 2016, 3.0), ("nvda", 2019, 3.0), ("nvda", 2020, 3.0), ("nvda", 2023, 11.0),
    ("amzn", 2018, 9.0), ("meta", 2023, 18.0), ("lly", 2014, 10.0), ("lly", 2015, 4.0), ("lly", 2021, 3.0),
    ("jpm", 2014, 3.0), ("wmt", 2019, 11.0), ("wmt", 2020, 14.0), ("wmt", 2021, 8.0), ("tsla", 2015, 21.0),
    ("tsla", 2018, 15.0), ("tsla", 2019, 11.0), ("msft", 2014, 3.0), ("msft", 2019, 9.0),
)
MISSING_CULTURE_ROWS = ({"ticker": "jpm", "year": 2023, "culture_emphasis": 2.0},)
DROPPED_FILING_YEAR = 2013


def with_tenure(pay: DataFrame, ticker: str = "TICKER", person: str = "EXEC_FULLNAME", year: str = "YEAR") -> DataFrame:
    """Length of the run of consecutive years each executive is in, joined back to the rows.

    A window holds the distinct years of one executive, so it stays small, and so does a key of the join.
    """
    by_person = Window.partitionBy(ticker, person).orderBy(year)
    runs = (
        pay.select(ticker, person, year)
        .distinct()
        .withColumn("_run", F.col(year) - F.row_number().over(by_person))
    )
    in_run = Window.partitionBy(ticker, person, "_run").orderBy(year)
    tenure = runs.withColumn("TENURE", F.row_number().over(in_run)).drop("_run")
    return pay.join(tenure, [ticker, person, year], "left")


def pay_summary(pay: DataFrame, measures: Sequence[str], keys: Sequence[str] = ("TICKER", "YEAR")) -> DataFrame:
    """Mean and deviation of every measure per company and year, flat names."""
    parts = []
    for m in measures:
        parts += [F.avg(m).alias(f"{m}_{m}_mean"), F.stddev_samp(m).alias(f"{m}_{m}_std")]
    return pay.groupBy(*keys).agg(*parts)


def with_salary_share(pay: DataFrame) -> DataFrame:
    return pay.withColumn("ISR", ratio(F.col("SALARY"), F.col("TDC1")))


def development_counts(developments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Items per company and year."""
    return developments.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))


def culture_counts(
    reports: DataFrame,
    missing: Sequence[Mapping] = MISSING_CULTURE_ROWS,
    corrections: DataFrame | None = None,
    dropped_year: int = DROPPED_FILING_YEAR,
) -> DataFrame:
    """Stacked filing counts, cleaned: the stray year out, missing rows in, corrections applied."""
    named = reports.withColumnRenamed("count", "culture_emphasis")
    complete = append_rows(named.filter(F.col("year") != dropped_year), missing)
    if corrections is None:
        corrections = reports.sparkSession.createDataFrame(
            list(CULTURE_CORRECTIONS), "ticker string, year int, culture_emphasis double"
        )
    return override(complete, ["ticker", "year"], "culture_emphasis", corrections)


def factor_table(
    pay: DataFrame, developments: DataFrame, culture: DataFrame, names: Mapping[str, str] = COMPANY_TICKERS
) -> DataFrame:
    """Pay, development counts and culture counts side by side, one row per company and year."""
    articles = (
        developments.withColumn("TICKER", lookup(F.col("companyname"), names))
        .dropna()
        .select("TICKER", F.col("year").alias("YEAR"), F.col("count").alias("ART_COUNT"))
    )
    emphasis = culture.select(
        F.upper("ticker").alias("TICKER"), F.col("year").alias("YEAR"), F.col("culture_emphasis").alias("CULT_EMPH")
    )
    return pay.join(articles, ["TICKER", "YEAR"]).join(emphasis, ["TICKER", "YEAR"])


def split_by_year(df: DataFrame, test_year: int = 2019) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Train before, test in, predict from the year on (the test year is predicted too)."""
    year = F.col("YEAR")
    return df.filter(year < test_year), df.filter(year == test_year), df.filter(year >= test_year)
