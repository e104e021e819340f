"""Trading rules, backtests and ranked portfolios."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import INITIAL_INVESTMENT
from tidemark.functions.values import ratio
from tidemark.operators.order import row_index
from tidemark.operators.windows import compounded

# Number, name, predictions that must agree, needs news, long only.
RULES = (
    (1, "news", (), True, True),
    (2, "lasso", ("lasso",), False, False),
    (3, "lasso_news", ("lasso",), True, False),
    (4, "log", ("log",), False, False),
    (5, "log_news", ("log",), True, False),
    (6, "forest", ("forest",), False, False),
    (7, "forest_news", ("forest",), True, False),
    (8, "forest_lasso_news", ("forest", "lasso"), True, False),
    (9, "forest_log_news", ("forest", "log"), True, False),
    (10, "log_lasso_news", ("log", "lasso"), True, False),
    (11, "all_news", ("forest", "lasso", "log"), True, False),
)


def _views(prediction: str) -> tuple[Column, Column]:
    """Whether a prediction points up, and whether it points down."""
    if prediction == "log":
        return F.col("log_pred") == "Positive", F.col("log_pred") == "Negative"
    score = F.col({"lasso": "lasso_pred", "forest": "pred_forest"}[prediction])
    return score > 0, score < 0


def rule_positions(gates: Mapping[int, int] | None = None) -> dict[str, Column]:
    """Position of every rule: 1, -1 or 0. `gates` asks for more than k news items."""
    gates = gates or {}
    positions = {}
    for number, name, predictions, needs_news, long_only in RULES:
        news = F.col("total") > gates[number] if number in gates else F.col("dummy_total") == 1
        up, down = F.lit(True), F.lit(not long_only)
        if needs_news:
            up, down = up & news, down & news
        for prediction in predictions:
            rises, falls = _views(prediction)
            up, down = up & rises, down & falls
        positions[name] = F.when(up, 1).when(down, -1).otherwise(0)
    return positions


def positions_long(scored: DataFrame, gates: Mapping[int, int] | None = None) -> DataFrame:
    """One row per rule, ticker and date."""
    cells = [
        F.struct(F.lit(name).alias("strategy"), p.alias("position")) for name, p in rule_positions(gates).items()
    ]
    return scored.select(F.inline(F.array(*cells)), "TICKER", "date").select(
        "strategy", "TICKER", "date", "position"
    )


def daily_growth(scored: DataFrame, positions: Mapping[str, Column], ret: str) -> DataFrame:
    """Equal-weight growth per rule and date: all rules in one pass, one row per date leaves it."""
    parts = []
    for i, p in enumerate(positions.values()):
        parts.append(F.sum(p * F.col(ret)).alias(f"_gain{i}"))
        parts.append(F.count(F.when(p != 0, 1)).alias(f"_held{i}"))
    daily = scored.filter(F.col(ret).isNotNull()).groupBy("date").agg(*parts)
    cells = [
        F.struct(
            F.lit(name).alias("strategy"),
            (1 + F.coalesce(ratio(F.col(f"_gain{i}"), F.col(f"_held{i}")), F.lit(0.0))).alias("growth"),
        )
        for i, name in enumerate(positions)
    ]
    return daily.select("date", F.inline(F.array(*cells)))


def equity_curve(growth: DataFrame, initial: float = INITIAL_INVESTMENT) -> DataFrame:
    """Value of each rule over time; its last date is left out. One row per date and rule goes in."""
    w = Window.partitionBy("strategy").orderBy("date")
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    return (
        growth.withColumn("_next", F.lead("date").over(w))
        .withColumn("value", initial * F.product("growth").over(running))
        .filter(F.col("_next").isNotNull())
        .select("strategy", "date", "value")
    )


def backtest(
    scored: DataFrame, ret: str, gates: Mapping[int, int] | None = None, after: str | None = None,
    rules: Sequence[str] | None = None,
) -> DataFrame:
    """Equity curves of the chosen rules (all by default) on dates later than `after`."""
    kept = scored if after is None else scored.filter(F.col("date") > F.lit(after).cast("date"))
    positions = rule_positions(gates)
    if rules is not None:
        positions = {name: positions[name] for name in rules}
    return equity_curve(daily_growth(kept, positions, ret))


def final_values(curve: DataFrame) -> DataFrame:
    """Last value of each series."""
    return curve.groupBy("strategy").agg(
        F.max_by("value", "date").alias("final_value"), F.max("date").alias("last_date")
    )


def benchmark_curve(panel: DataFrame, initial: float = INITIAL_INVESTMENT) -> DataFrame:
    """Buy and hold of the raw market return."""
    daily = panel.groupBy("date").agg(F.max("sprtrn").alias("_r"))
    return equity_curve(daily.select(F.lit("market").alias("strategy"), "date", (1 + F.col("_r")).alias("growth")), initial)


def rank_predictions(predictions: DataFrame) -> DataFrame:
    """Rank within (YEAR, MODEL) by predicted value, highest first, ties by TICKER."""
    ranked = row_index(predictions.filter(F.col("EXP").isNotNull()), ["EXP", "TICKER"], "_i", ["YEAR", "MODEL"], ["EXP"])
    return ranked.withColumn("RANK", F.col("_i") + 1).drop("_i")


def long_short_weights(predictions: DataFrame, longs: int = 4, shorts: int = 4) -> DataFrame:
    """Best `longs` at +1, next `shorts` at -1, scaled so absolute weights add up to one.

    Spark keeps only the leading rows of each group before the shuffle (window group limit).
    """
    w = Window.partitionBy("YEAR", "MODEL").orderBy(F.desc("EXP"), F.asc("TICKER"))
    top = (
        predictions.filter(F.col("EXP").isNotNull())
        .withColumn("RANK", F.row_number().over(w))
        .filter(F.col("RANK") <= longs + shorts)
    )
    side = F.when(F.col("RANK") <= longs, 1).otherwise(-1)
    return top.withColumn("POS", side / F.sum(F.abs(side)).over(Window.partitionBy("YEAR", "MODEL")))


def all_positions(predictions: DataFrame, longs: int = 4, shorts: int = 4) -> DataFrame:
    """Every ranked company with its weight, null beyond the held ones.

    The held ones are a handful per year and model, so they are broadcast.
    """
    held = long_short_weights(predictions, longs, shorts).select("TICKER", "YEAR", "MODEL", "POS")
    ranked = predictions.filter(F.col("EXP").isNotNull()).select("TICKER", "YEAR", "MODEL")
    return ranked.join(F.broadcast(held), ["TICKER", "YEAR", "MODEL"], "left")


def join_positions(returns: DataFrame, positions: DataFrame) -> DataFrame:
    """Annual positions onto daily returns."""
    distinct = positions.select("TICKER", "YEAR", "MODEL", "POS").dropDuplicates()
    return returns.join(distinct, ["TICKER", "YEAR"], "left")


def portfolio_returns(positioned: DataFrame) -> DataFrame:
    """Weighted return of each model and date; zero on dates when only companies not held trade."""
    weighted = F.coalesce(F.sum(F.col("RET") * F.col("POS")), F.lit(0.0))
    return positioned.filter(F.col("MODEL").isNotNull()).groupBy("MODEL", "DATE").agg(weighted.alias("RET"))


def sharpe(df: DataFrame, groups: Sequence[str], ret: str = "RET") -> DataFrame:
    """Annualised mean over deviation of daily returns."""
    return df.groupBy(*groups).agg(
        (F.sqrt(F.lit(252.0)) * ratio(F.avg(ret), F.stddev_samp(ret))).alias("sharpe")
    )


def cumulative(df: DataFrame, series: str, date: str = "DATE") -> DataFrame:
    """Running compounded return of every series; one row per series and date goes in."""
    return df.withColumn("CUM_RET", compounded("RET", date, series))


def against_benchmark(portfolio: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Cumulative return per model next to the benchmark's on the same date."""
    base = cumulative(benchmark, "TICKER").select("DATE", F.col("CUM_RET").alias("BENCHMARK"))
    return cumulative(portfolio, "MODEL").join(base, "DATE", "left").select("MODEL", "DATE", "CUM_RET", "BENCHMARK")


def excess_target(df: DataFrame, outcome: str = "P", holding: str = "H") -> DataFrame:
    """Outcome minus what holding would have returned."""
    return df.withColumn("PH", F.col(outcome) - F.col(holding))


def stacked_predictions(df: DataFrame, models: Sequence[str]) -> DataFrame:
    """LR, RF, XGB columns to one row per key and model."""
    return df.unpivot(["TICKER", "YEAR"], list(models), "MODEL", "EXP")
