"""E: lags, rolling averages, bins, ranks, standardising and compounding."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.config import DAILY
from tidemark.operators import annual, order, portfolio, windows
from tidemark.plans.registry import query
from tidemark.plans.summary_queries import edges_sql, lagged, sas_rank, stored
from tidemark.session import materialise, scratch_path, shuffle_width
from tidemark.sources.files import store_bucketed
from tidemark.sources.testdata import NUMERIC

C = F.col
WEEKLY_KINDS = "TICKER:s date:d next_week_return:f9 last_week_return:f9 last_week_volume:f"


@query(
    "e01_lags_daily",
    "TICKER:s date:d tomorrow_return:f9 yesterday_return:f9 yesterday_volume:f",
    "SELECT TICKER, date, tomorrow_return, yesterday_return, yesterday_volume FROM features",
    ["features"],
)
def _(t):
    return windows.with_lags(t.prices, DAILY)


@query(
    "e01_lags_weekly",
    WEEKLY_KINDS,
    "SELECT TICKER, date, next_week_return, last_week_return, last_week_volume FROM features_weekly",
    ["features_weekly"],
)
def _(t):
    return t.features("weekly")


@query(
    "e02_lagged_return",
    "TICKER:s date:d RET:f9 lagged_return:f9",
    "SELECT TICKER, date, RET, lagged_return FROM lagged",
    ["lagged"],
)
def _(t):
    return lagged(t, "prices")


@query(
    "e03_rolling_means",
    "TICKER:s date:d 10_day_ma:f4 20_day_ma:f4 30_day_ma:f4",
    'SELECT TICKER, date, "10_day_ma", "20_day_ma", "30_day_ma" FROM features',
    ["features"],
)
def _(t):
    return windows.with_averages(t.prices, DAILY)


@query(
    "e03_rolling_means_monthly",
    "TICKER:s date:d 1_month_ma:f4 2_month_ma:f4 3_month_ma:f4",
    'SELECT TICKER, date, "1_month_ma", "2_month_ma", "3_month_ma" FROM features_monthly',
    ["features_monthly"],
)
def _(t):
    return t.features("monthly")


def _stored_by_ticker(t, df):
    """A table dealt and sorted by ticker, as a feature store would keep it."""
    return store_bucketed(df, scratch_path(t.spark, "by_ticker"), "TICKER", ["date"], shuffle_width(t.spark))


@query(
    "e03_rolling_means_stored",
    "TICKER:s date:d 10_day_ma:f4 20_day_ma:f4 30_day_ma:f4",
    'SELECT TICKER, date, "10_day_ma", "20_day_ma", "30_day_ma" FROM features',
    ["features"],
)
def _(t):
    """The same averages on a table stored by ticker: no row is shuffled."""
    return windows.with_averages(_stored_by_ticker(t, t.prices.select("TICKER", "date", "PRC")), DAILY)


@query("e04_average_order", "TICKER:s date:d proper:b", "SELECT TICKER, date, proper FROM features", ["features"])
def _(t):
    return windows.with_averages(t.prices, DAILY)


@query(
    "e05_average_above_price",
    "TICKER:s date:d move_avg_10:i move_avg_20:i move_avg_30:i",
    """SELECT TICKER, date, CAST("10_day_ma" > PRC AS INT) AS move_avg_10, CAST("20_day_ma" > PRC AS INT) AS move_avg_20,
              CAST("30_day_ma" > PRC AS INT) AS move_avg_30 FROM features""",
    ["features"],
)
def _(t):
    return windows.with_averages(t.prices, DAILY).withColumns(
        {f"move_avg_{n}": windows.average_above_price(C(f"{n}_day_ma"), C("PRC")) for n in (10, 20, 30)}
    )


@query(
    "e06_quantile_bins",
    "TICKER:s date:d comp_size:i",
    f"SELECT TICKER, date, bin AS comp_size FROM ({edges_sql('market_cap', 10, 'panel')})",
    ["panel"],
)
def _(t):
    return order.quantile_bins(stored(t.prices, "market_cap"), "market_cap", DAILY.size_bins, "comp_size")


@query(
    "e06_quantile_bins_from_sketches",
    "TICKER:s date:d comp_size:i",
    f"SELECT TICKER, date, bin AS comp_size FROM ({edges_sql('market_cap', 10, 'panel')})",
    ["panel"],
)
def _(t):
    """The same bins where a sketch per month is stored beside the rows: the edges cost one scan."""
    rows = materialise(t.prices.select("TICKER", "date", "market_cap"))
    sketches = materialise(order.value_sketches(rows.withColumn("month", F.trunc("date", "MM")), "market_cap", ["month"]))
    return order.quantile_bins(rows, "market_cap", DAILY.size_bins, "comp_size", sketches=sketches)


@query(
    "e06_quantile_bins_monthly",
    "TICKER:s date:d comp_size:i",
    f"""SELECT TICKER, date, CASE WHEN market_cap IS NOT NULL THEN bin END AS comp_size
        FROM ({edges_sql('market_cap', 3, 'monthly')})""",
    ["monthly"],
)
def _(t):
    return order.quantile_bins(stored(t.periods("monthly"), "market_cap"), "market_cap", 3, "comp_size")


@query(
    "e07_rank_groups",
    "TICKER:s date:d RET:f9 rank:i",
    f"SELECT TICKER, date, RET, grp AS rank FROM ({sas_rank('RET', 10, 'panel')})",
    ["panel"],
)
def _(t):
    return order.rank_groups(stored(t.prices), "RET", 10, "rank")


@query(
    "e08_drop_outliers",
    "TICKER:s n:i spread_sum:f4",
    """WITH a AS (SELECT * FROM panel CROSS JOIN (SELECT avg(PRC) AS m, stddev_samp(PRC) AS s FROM panel)
                  WHERE abs((PRC - m) / s) < 3),
            b AS (SELECT a.*, m2, s2 FROM a CROSS JOIN (SELECT avg(VOL) AS m2, stddev_samp(VOL) AS s2 FROM a)
                  WHERE abs((VOL - m2) / s2) < 3)
       SELECT TICKER, count(*) AS n, sum(ASKHI - BIDLO) AS spread_sum FROM b GROUP BY 1""",
    ["panel"],
)
def _(t):
    rows = materialise(t.prices.select("TICKER", "PRC", "VOL", "ASKHI", "BIDLO"))
    kept = windows.drop_outliers(windows.drop_outliers(rows, "PRC"), "VOL")
    return kept.groupBy("TICKER").agg(F.count(F.lit(1)).alias("n"), F.sum(C("ASKHI") - C("BIDLO")).alias("spread_sum"))


STANDARD = [*NUMERIC, "yesterday_return", "10_day_ma", "20_day_ma", "30_day_ma", "yesterday_volume"]


@query(
    "e09_standardise",
    "TICKER:s date:d " + " ".join(f"{c}:f" for c in STANDARD),
    "SELECT TICKER, date, " + ", ".join(
        f'("{c}" - avg("{c}") OVER w) / nullif(stddev_samp("{c}") OVER w, 0) AS "{c}"' for c in STANDARD
    ) + " FROM features WINDOW w AS (PARTITION BY TICKER)",
    ["features"],
)
def _(t):
    return windows.standardise(t.features(), STANDARD)


@query(
    "e09_standardise_stored",
    "TICKER:s date:d PRC:f RET:f VOL:f",
    "SELECT TICKER, date, " + ", ".join(
        f"({c} - avg({c}) OVER w) / nullif(stddev_samp({c}) OVER w, 0) AS {c}" for c in ("PRC", "RET", "VOL")
    ) + " FROM panel WINDOW w AS (PARTITION BY TICKER)",
    ["panel"],
)
def _(t):
    return windows.standardise(_stored_by_ticker(t, t.prices.select("TICKER", "date", "PRC", "RET", "VOL")), ["PRC", "RET", "VOL"])


@query("e10_percent_change", "TICKER:s DATE:d RET:f9", "SELECT TICKER, DATE, RET FROM path_returns", ["path_returns"])
def _(t):
    return t.price_path.withColumn("RET", windows.percent_change("CLOSE"))


@query(
    "e11_compounded",
    "TICKER:s date:d LOG_CUM_RET:f8",
    """SELECT TICKER, date, ln(product(1 + RET) OVER (PARTITION BY TICKER ORDER BY date)) AS LOG_CUM_RET FROM panel""",
    ["panel"],
)
def _(t):
    """Running return over the whole series of each ticker, as logarithms."""
    return t.prices.select("TICKER", "date", F.ln(1 + windows.compounded("RET", "date")).alias("LOG_CUM_RET"))


@query(
    "e11_compounded_stored",
    "TICKER:s date:d LOG_CUM_RET:f8",
    """SELECT TICKER, date, ln(product(1 + RET) OVER (PARTITION BY TICKER ORDER BY date)) AS LOG_CUM_RET FROM panel""",
    ["panel"],
)
def _(t):
    rows = _stored_by_ticker(t, t.prices.select("TICKER", "date", "RET"))
    return rows.select("TICKER", "date", F.ln(1 + windows.compounded("RET", "date")).alias("LOG_CUM_RET"))


@query(
    "e12_tenure",
    "TICKER:s EXEC_FULLNAME:i YEAR:i o_orderkey:i TENURE:i",
    """WITH runs AS (SELECT TICKER, EXEC_FULLNAME, YEAR, YEAR - row_number() OVER (
                       PARTITION BY TICKER, EXEC_FULLNAME ORDER BY YEAR) AS run
                     FROM (SELECT DISTINCT TICKER, EXEC_FULLNAME, YEAR FROM pay)),
            ten AS (SELECT *, row_number() OVER (PARTITION BY TICKER, EXEC_FULLNAME, run ORDER BY YEAR) AS TENURE FROM runs)
       SELECT TICKER, EXEC_FULLNAME, YEAR, o_orderkey, TENURE FROM pay JOIN ten USING (TICKER, EXEC_FULLNAME, YEAR)""",
    ["pay"],
)
def _(t):
    return annual.with_tenure(t.pay)


def predictions(t):
    """Yearly customer means as three predicted values per customer and year."""
    wide = t.pay.groupBy(C("EXEC_FULLNAME").cast("string").alias("TICKER"), "YEAR").agg(
        (F.sum(F.round(C("TDC1") * 100).cast("bigint")) / (F.count(F.lit(1)) * 100.0)).alias("LR"),
        F.max("TDC1").alias("RF"),
        (-F.min("TDC1")).alias("XGB"),
    )
    return portfolio.stacked_predictions(wide, ["LR", "RF", "XGB"])


PREDICTIONS_SQL = """SELECT TICKER, YEAR, MODEL, EXP FROM (UNPIVOT (
    SELECT CAST(EXEC_FULLNAME AS VARCHAR) AS TICKER, YEAR,
           CAST(sum(CAST(round(TDC1 * 100) AS BIGINT)) AS BIGINT) / (count(*) * 100.0) AS "LR",
           max(TDC1) AS "RF", -min(TDC1) AS "XGB" FROM pay GROUP BY 1, 2)
    ON "LR", "RF", "XGB" INTO NAME MODEL VALUE EXP)"""


@query(
    "e13_rank_predictions",
    "TICKER:s YEAR:i MODEL:s EXP:f4 RANK:i",
    f"""SELECT *, row_number() OVER (PARTITION BY YEAR, MODEL ORDER BY EXP DESC, TICKER) AS RANK FROM ({PREDICTIONS_SQL})""",
    ["pay"],
)
def _(t):
    return portfolio.rank_predictions(predictions(t))


WEIGHTS_SQL = f"""SELECT TICKER, YEAR, MODEL, RANK, side / sum(abs(side)) OVER (PARTITION BY YEAR, MODEL) AS POS FROM (
    SELECT *, CASE WHEN RANK <= 4 THEN 1 ELSE -1 END AS side FROM (
      SELECT *, row_number() OVER (PARTITION BY YEAR, MODEL ORDER BY EXP DESC, TICKER) AS RANK FROM ({PREDICTIONS_SQL}))
    WHERE RANK <= 8)"""


@query("e14_long_short_weights", "TICKER:s YEAR:i MODEL:s RANK:i POS:f", WEIGHTS_SQL, ["pay"])
def _(t):
    return portfolio.long_short_weights(predictions(t))


@query(
    "e15_trim_to_quantiles",
    "TICKER:s date:d tomorrow_return:f9",
    """SELECT TICKER, date, tomorrow_return FROM features CROSS JOIN (
         SELECT quantile_cont(tomorrow_return, 0.025) AS lo, quantile_cont(tomorrow_return, 0.975) AS hi
         FROM features WHERE year(date) < 2000)
       WHERE tomorrow_return BETWEEN lo AND hi AND year(date) < 2000""",
    ["features"],
)
def _(t):
    train = stored(windows.with_lags(t.prices, DAILY), DAILY.target).filter(F.year("date") < 2000)
    return windows.trim_to_quantiles(train, train, "tomorrow_return")
