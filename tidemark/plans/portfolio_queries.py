"""J: rules, backtests and ranked portfolios; L: the news stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import config
from tidemark.operators import annual, portfolio, windows
from tidemark.plans import study
from tidemark.plans.registry import query
from tidemark.plans.window_queries import PREDICTIONS_SQL, WEIGHTS_SQL, predictions
from tidemark.session import one_row, scratch_path
from tidemark.streaming import day_upserts, news_counts

C = F.col


def _rule(up: str, down: str | None) -> str:
    return f"CASE WHEN {up} THEN 1 " + (f"WHEN {down} THEN -1 " if down else "") + "ELSE 0 END"


def rules_sql(gates=None) -> dict[str, str]:
    """The eleven rules written out for the SQL side."""
    gates = gates or {}

    def news(n):
        return f"total > {gates[n]}" if n in gates else "dummy_total = 1"

    lu, ld = "lasso_pred > 0", "lasso_pred < 0"
    fu, fd = "pred_forest > 0", "pred_forest < 0"
    gu, gd = "log_pred = 'Positive'", "log_pred = 'Negative'"
    return {
        "news": _rule(news(1), None),
        "lasso": _rule(lu, ld),
        "lasso_news": _rule(f"{lu} AND {news(3)}", f"{ld} AND {news(3)}"),
        "log": _rule(gu, gd),
        "log_news": _rule(f"{gu} AND {news(5)}", f"{gd} AND {news(5)}"),
        "forest": _rule(fu, fd),
        "forest_news": _rule(f"{fu} AND {news(7)}", f"{fd} AND {news(7)}"),
        "forest_lasso_news": _rule(f"{fu} AND {lu} AND {news(8)}", f"{fd} AND {ld} AND {news(8)}"),
        "forest_log_news": _rule(f"{fu} AND {gu} AND {news(9)}", f"{fd} AND {gd} AND {news(9)}"),
        "log_lasso_news": _rule(f"{gu} AND {lu} AND {news(10)}", f"{gd} AND {ld} AND {news(10)}"),
        "all_news": _rule(f"{fu} AND {lu} AND {gu} AND {news(11)}", f"{fd} AND {ld} AND {gd} AND {news(11)}"),
    }


def positions_sql(source: str, gates=None, ret: str = "tomorrow_return") -> str:
    return " UNION ALL ".join(
        f"SELECT '{name}' AS strategy, TICKER, date, {ret} AS ret, {rule} AS position FROM {source}"
        for name, rule in rules_sql(gates).items()
    )


def curve_sql(source: str, gates=None) -> str:
    return f"""SELECT strategy, date, 100000 * product(growth) OVER (PARTITION BY strategy ORDER BY date) AS value
      FROM (SELECT strategy, date, 1 + coalesce(sum(position * ret) / nullif(count(*) FILTER (position <> 0), 0), 0) AS growth
            FROM ({positions_sql(source, gates)}) WHERE ret IS NOT NULL GROUP BY 1, 2)
      QUALIFY lead(date) OVER (PARTITION BY strategy ORDER BY date) IS NOT NULL"""


@query(
    "j01_rule_positions",
    "strategy:s date:d longs:i shorts:i",
    f"""SELECT strategy, date, count(*) FILTER (position = 1) AS longs, count(*) FILTER (position = -1) AS shorts
        FROM ({positions_sql('scored')}) GROUP BY 1, 2""",
    ["scored"],
)
def _(t):
    return portfolio.positions_long(t.scored).groupBy("strategy", "date").agg(
        F.count(F.when(C("position") == 1, 1)).alias("longs"), F.count(F.when(C("position") == -1, 1)).alias("shorts")
    )


@query(
    "j01_rule_positions_gated",
    "strategy:s longs:i shorts:i",
    f"""SELECT strategy, count(*) FILTER (position = 1) AS longs, count(*) FILTER (position = -1) AS shorts
        FROM ({positions_sql('scored', config.NEWS_GATES['russell', 'weekly'])}) GROUP BY 1""",
    ["scored"],
)
def _(t):
    return portfolio.positions_long(t.scored, config.NEWS_GATES["russell", "weekly"]).groupBy("strategy").agg(
        F.count(F.when(C("position") == 1, 1)).alias("longs"), F.count(F.when(C("position") == -1, 1)).alias("shorts")
    )


@query(
    "j02_backtest",
    "strategy:s date:d log_value:f8",
    f"""SELECT strategy, date, ln(value) AS log_value FROM ({curve_sql("(SELECT * FROM scored WHERE date > DATE '1995-02-13')")})
        WHERE strategy = 'lasso_news'""",
    ["scored"],
)
def _(t):
    curve = portfolio.backtest(t.scored, "tomorrow_return", after="1995-02-13", rules=["lasso_news"])
    return curve.withColumn("log_value", F.ln("value"))


@query(
    "j03_all_strategies",
    "strategy:s log_final:f8 last_date:d",
    f"""SELECT strategy, ln(arg_max(value, date)) AS log_final, max(date) AS last_date FROM ({curve_sql('scored')}) GROUP BY 1""",
    ["scored"],
)
def _(t):
    final = portfolio.final_values(portfolio.backtest(t.scored, "tomorrow_return"))
    return final.withColumn("log_final", F.ln("final_value"))


@query(
    "j03_benchmark_curve",
    "date:d log_value:f8",
    """SELECT date, ln(100000 * product(1 + r) OVER (ORDER BY date)) AS log_value FROM (
         SELECT date, max(sprtrn) AS r FROM panel GROUP BY 1) QUALIFY lead(date) OVER (ORDER BY date) IS NOT NULL""",
    ["panel"],
)
def _(t):
    return portfolio.benchmark_curve(t.panel).withColumn("log_value", F.ln("value"))


@query(
    "j03_strategies_weekly_gated",
    "strategy:s log_final:f8 last_date:d",
    f"""SELECT strategy, ln(arg_max(value, date)) AS log_final, max(date) AS last_date
        FROM ({curve_sql("""(SELECT *, -last_week_return AS lasso_pred, RET - sprtrn AS pred_forest, next_week_return AS tomorrow_return,
                CASE WHEN last_week_return >= 0 THEN 'Positive' WHEN last_week_return < 0 THEN 'Negative' END AS log_pred
                FROM features_weekly)""", config.NEWS_GATES['russell', 'weekly'])}) GROUP BY 1""",
    ["features_weekly"],
)
def _(t):
    final = portfolio.final_values(study.strategies(t.scored_at("weekly"), "russell", "weekly", after=None))
    return final.withColumn("log_final", F.ln("final_value"))


def returns(t):
    return t.price_path.withColumn("RET", windows.percent_change("CLOSE")).withColumn("YEAR", F.year("DATE"))


def daily_portfolio(t):
    positioned = joins_by_year(t)
    return portfolio.portfolio_returns(positioned)


def joins_by_year(t):
    return portfolio.join_positions(returns(t), portfolio.all_positions(predictions(t)))


POSITIONED_SQL = f"""SELECT r.TICKER, r.DATE, r.YEAR, r.RET, w.MODEL, w.POS FROM path_returns r
    LEFT JOIN (SELECT DISTINCT p.TICKER, p.YEAR, p.MODEL, h.POS FROM ({PREDICTIONS_SQL}) p
               LEFT JOIN ({WEIGHTS_SQL}) h ON p.TICKER = h.TICKER AND p.YEAR = h.YEAR AND p.MODEL = h.MODEL) w
      ON r.TICKER = w.TICKER AND r.YEAR = w.YEAR"""
PORTFOLIO_SQL = f"SELECT MODEL, DATE, coalesce(sum(RET * POS), 0) AS RET FROM ({POSITIONED_SQL}) WHERE MODEL IS NOT NULL GROUP BY 1, 2"


@query(
    "c09_positions_on_returns",
    "TICKER:s DATE:d RET:f9 MODEL:s POS:f9",
    POSITIONED_SQL,
    ["pay", "path_returns"],
)
def _(t):
    return joins_by_year(t)


@query("j04_portfolio_returns", "MODEL:s DATE:d RET:f9", PORTFOLIO_SQL, ["pay", "path_returns"])
def _(t):
    return daily_portfolio(t)


@query(
    "j05_sharpe",
    "MODEL:s sharpe:f",
    f"""SELECT MODEL, sqrt(252) * avg(RET) / nullif(stddev_samp(RET), 0) AS sharpe FROM ({PORTFOLIO_SQL}) GROUP BY 1
        UNION ALL SELECT 'benchmark', sqrt(252) * avg(RET) / nullif(stddev_samp(RET), 0) FROM (
          SELECT date, max(sprtrn) AS RET FROM panel GROUP BY 1)""",
    ["pay", "path_returns", "panel"],
)
def _(t):
    market = t.panel.groupBy("date").agg(F.max("sprtrn").alias("RET")).withColumn("MODEL", F.lit("benchmark"))
    both = daily_portfolio(t).select("MODEL", "RET").unionByName(market.select("MODEL", "RET"))
    return portfolio.sharpe(both, ["MODEL"])


@query(
    "j06_benchmark_series",
    "TICKER:s DATE:d CUM_RET:f4",
    """SELECT TICKER, DATE, product(1 + coalesce(RET, 0)) OVER (ORDER BY DATE) - 1 AS CUM_RET FROM path_returns
       WHERE TICKER = (SELECT min(TICKER) FROM path_returns)""",
    ["path_returns"],
)
def _(t):
    series = returns(t)
    first = one_row(series.agg(F.min("TICKER").alias("TICKER")))["TICKER"]
    return portfolio.cumulative(series.filter(C("TICKER") == first), "TICKER")


@query(
    "j07_excess_target",
    "TICKER:s YEAR:i PH:f4",
    "SELECT TICKER, YEAR, avg(SALARY) - avg(BONUS) AS PH FROM pay GROUP BY 1, 2",
    ["pay"],
)
def _(t):
    outcome = t.pay.groupBy("TICKER", "YEAR").agg(F.avg("SALARY").alias("P"), F.avg("BONUS").alias("H"))
    return portfolio.excess_target(outcome)


@query(
    "j08_against_benchmark",
    "MODEL:s DATE:d SIDE:i LOG_RET:f8 LOG_BENCHMARK:f8",
    f"""SELECT MODEL, DATE, sign(1 + CUM_RET) AS SIDE, CASE WHEN 1 + CUM_RET <> 0 THEN ln(abs(1 + CUM_RET)) END AS LOG_RET, ln(1 + BENCHMARK) AS LOG_BENCHMARK
        FROM (SELECT MODEL, DATE, product(1 + coalesce(RET, 0)) OVER (PARTITION BY MODEL ORDER BY DATE) - 1 AS CUM_RET FROM ({PORTFOLIO_SQL})) LEFT JOIN (
          SELECT date AS DATE, product(1 + r) OVER (ORDER BY date) - 1 AS BENCHMARK FROM (
            SELECT date, max(sprtrn) AS r FROM panel GROUP BY 1)) USING (DATE)""",
    ["pay", "path_returns", "panel"],
)
def _(t):
    """Signs and logarithms of the compounded values, which grow beyond reading."""
    market = t.panel.groupBy("date").agg(F.max("sprtrn").alias("RET")).select(
        F.lit("market").alias("TICKER"), C("date").alias("DATE"), "RET"
    )
    both = portfolio.against_benchmark(daily_portfolio(t), market)
    grown = 1 + C("CUM_RET")
    return both.withColumns({"SIDE": F.signum(grown), "LOG_RET": F.ln(F.abs(grown)), "LOG_BENCHMARK": F.ln(1 + C("BENCHMARK"))})


FACTORS = ["SALARY_SALARY_mean", "BONUS_BONUS_mean", "TENURE_TENURE_mean", "ART_COUNT"]


def yearly_factors(t):
    """Customers as companies: pay and tenure of a year against the return of the next."""
    pay = annual.with_tenure(t.pay).withColumn("TICKER", C("EXEC_FULLNAME").cast("string"))
    factors = annual.pay_summary(pay, ["SALARY", "BONUS", "TENURE"]).join(
        annual.development_counts(pay, ["TICKER", "YEAR"]).withColumnRenamed("count", "ART_COUNT"), ["TICKER", "YEAR"]
    )
    outcome = returns(t).groupBy("TICKER", "YEAR").agg(F.avg("RET").alias("P"))
    return factors.join(outcome, ["TICKER", "YEAR"])


@query("i10_annual_model_errors", "MODEL:s n:i mse:f rmse:f r2:f")
def _(t):
    return study.annual_predictions(yearly_factors(t), FACTORS, "P", 1999)[0]


@query("j04_fitted_portfolio", "MODEL:s DATE:d RET:f")
def _(t):
    predicted = study.annual_predictions(yearly_factors(t), FACTORS, "P", 1999)[1]
    return study.ranked_portfolio(predicted, returns(t))


def _feed(feed):
    """Events as headlines with an instant, as the streams take them."""
    words = (
        F.when(C("event_type") == "purchase", "Positive.")
        .when(C("event_type") == "error", "This is NEGATIVE")
        .when(C("event_type") == "view", F.lit(None).cast("string"))
        .otherwise("mixed")
    )
    return feed.select(
        "event_id", news_counts.utc_instant("ts").alias("ts"), C("user_id").cast("string").alias("TICKER"),
        words.alias("Sentiment"),
    )


@query(
    "l01_news_stream",
    "enterdate:d TICKER:s positive:i negative:i total:i",
    """SELECT enterdate, TICKER, sum(positive) AS positive, sum(negative) AS negative, sum(total) AS total
       FROM labelled WHERE enterdate + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM events) GROUP BY 1, 2""",
    ["labelled"],
)
def _(t):
    """Days that are closed by the watermark: those ending a day or more before the last event."""
    return news_counts.land_and_count(
        t.spark, t.folder, t["events"].schema, "events.parquet", _feed, "ts", "TICKER", "event_id", "Sentiment",
        scratch_path(t.spark, "news_counts"), scratch_path(t.spark, "news_counts_state"),
    )


@query(
    "l01_news_upserts",
    "enterdate:d TICKER:s positive:i negative:i total:i",
    "SELECT enterdate, TICKER, sum(positive) AS positive, sum(negative) AS negative, sum(total) AS total FROM labelled GROUP BY 1, 2",
    ["labelled"],
)
def _(t):
    """Every day, those that a watermark would still hold back included."""
    feed = _feed(news_counts.read_feed(t.spark, t.folder, t["events"].schema, "events.parquet"))
    out = scratch_path(t.spark, "news_days")
    day_upserts.run_upserts(day_upserts.day_versions(feed, "ts", "TICKER", "event_id", "Sentiment"), out, scratch_path(t.spark, "news_days_state"))
    return day_upserts.latest_days(t.spark, out)
