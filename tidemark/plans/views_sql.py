"""SQL text of the stand-in views, for the checking side of the queries."""

from __future__ import annotations

from collections.abc import Sequence

from tidemark.config import BY_NAME


def _features(source: str, freq: str) -> str:
    f = BY_NAME[freq]
    averages = ", ".join(
        f"CASE WHEN count(PRC) OVER (w ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) = {n} "
        f'THEN avg(PRC) OVER (w ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) END AS "{c}"'
        for n, c in zip(f.averages, f.average_columns)
    )
    a, b, c = f.average_columns
    return f"""
      SELECT *, coalesce("{a}" > "{b}" AND "{b}" > "{c}", false) AS proper, ASKHI - BIDLO AS "Ask_minus_Bid",
        CASE WHEN negative >= 1 THEN 1 ELSE 0 END AS dummy_negative,
        CASE WHEN positive >= 1 THEN 1 ELSE 0 END AS dummy_positive,
        CASE WHEN total >= 1 THEN 1 ELSE 0 END AS dummy_total
      FROM (SELECT *, lead(RET) OVER w AS {f.target}, lag(RET) OVER w AS {f.previous_return},
                   lag(VOL) OVER w AS {f.previous_volume}, {averages}
            FROM {source} WINDOW w AS (PARTITION BY TICKER ORDER BY date))"""


def _steady(value: str, places: int) -> str:
    return f"round_even({value} * 1e{places}, 0) / 1e{places}"


def _resampled(period: str, calendar: str) -> str:
    return f"""
      SELECT c.TICKER, c.date, p.SICCD, p.COMNAM, p.market_cap, p.SHROUT, p.VOL, p.PRC, p.ASKHI, p.BIDLO,
             coalesce(p.total, 0) AS total, coalesce(p.negative, 0) AS negative, coalesce(p.positive, 0) AS positive,
             coalesce(p.sprtrn, 0) AS sprtrn, coalesce(p.RET, 0) AS RET
      FROM (SELECT DISTINCT TICKER, {calendar} AS date
            FROM (SELECT TICKER, min({period}) AS lo, max({period}) AS hi FROM panel GROUP BY TICKER)) c
      LEFT JOIN (SELECT TICKER, {period} AS date, arg_min(SICCD, date) AS SICCD, arg_min(COMNAM, date) AS COMNAM,
                   {_steady('avg(market_cap)', 8)} AS market_cap, avg(SHROUT) AS SHROUT, avg(VOL) AS VOL,
                   {_steady('avg(PRC)', 8)} AS PRC, max(ASKHI) AS ASKHI, min(BIDLO) AS BIDLO, sum(total) AS total, sum(negative) AS negative,
                   sum(positive) AS positive, {_steady('(product(1 + sprtrn) - 1)', 12)} AS sprtrn, {_steady('(product(1 + RET) - 1)', 12)} AS RET
                 FROM panel GROUP BY TICKER, {period}) p
        ON c.TICKER = p.TICKER AND c.date = p.date"""


def _rollup(start: str) -> str:
    return f"""
      SELECT TICKER, {start} AS start, arg_min(SICCD, date) AS SICCD, arg_min(COMNAM, date) AS COMNAM,
             {_steady('avg(market_cap)', 8)} AS mean_market_cap, avg(SHROUT) AS mean_SHROUT, avg(VOL) AS mean_VOL, {_steady('avg(PRC)', 8)} AS mean_PRC,
             max(ASKHI) AS max_ASKHI, min(BIDLO) AS min_BIDLO, sum(total) AS sum_total, sum(negative) AS sum_negative,
             sum(positive) AS sum_positive, {_steady('sum(sprtrn)', 10)} AS sum_sprtrn, {_steady('sum(RET)', 10)} AS sum_RET
      FROM panel GROUP BY TICKER, {start}"""


WEEK_END = "CAST(date + CAST((8 - isodow(date)) % 7 AS INTEGER) AS DATE)"
WEEK_START = "CAST(date - CAST(dayofweek(date) AS INTEGER) AS DATE)"
MONTH_START = "CAST(date_trunc('month', date) AS DATE)"

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "price_day": ((), """
      SELECT l_suppkey, CAST(l_shipdate AS DATE) AS date,
             sum(CAST(round(l_extendedprice * 100) AS BIGINT)) / (sum(l_quantity) * 100.0) AS PRC,
             max(l_extendedprice / l_quantity) AS ASKHI, min(l_extendedprice / l_quantity) AS BIDLO,
             sum(l_quantity) AS VOL, count(*) AS SHROUT,
             CAST(floor(sum(CAST(round(l_discount * 100) AS BIGINT) - CAST(round(l_tax * 100) AS BIGINT)) * 10000.0
                        / count(*) + 0.5) AS BIGINT) AS micro,
             count(*) FILTER (l_returnflag = 'A') AS positive, count(*) FILTER (l_returnflag = 'R') AS negative,
             count(*) FILTER (l_returnflag IN ('A', 'R')) AS total
      FROM lineitem GROUP BY 1, 2"""),
    "market": (("price_day",), """
      SELECT date, CAST(sum(micro) AS BIGINT) / (count(*) * 1e6) AS sprtrn FROM price_day GROUP BY date"""),
    "panel": (("market",), """
      SELECT CAST(l_suppkey AS VARCHAR) AS TICKER, date, s_name AS COMNAM,
             CAST(s_nationkey * 10 + l_suppkey % 10 AS BIGINT) AS SICCD, PRC, ASKHI, BIDLO, VOL, SHROUT,
             micro / 1e6 AS RET, positive, negative, total, PRC * SHROUT AS market_cap, sprtrn
      FROM price_day JOIN market USING (date) JOIN supplier ON s_suppkey = l_suppkey"""),
    "features": (("panel",), _features("panel", "daily")),
    "lagged": (("panel",), """
      SELECT * FROM (SELECT *, lag(RET) OVER (PARTITION BY TICKER ORDER BY date) AS lagged_return FROM panel)
      WHERE lagged_return IS NOT NULL"""),
    "weekly": (("panel",), _resampled(WEEK_END, "CAST(unnest(generate_series(lo, hi, INTERVAL 7 DAY)) AS DATE)")),
    "monthly": (("panel",), _resampled(
        "last_day(date)",
        "last_day(CAST(unnest(generate_series(date_trunc('month', lo), date_trunc('month', hi), INTERVAL 1 MONTH)) AS DATE))")),
    "features_weekly": (("weekly",), _features("weekly", "weekly")),
    "features_monthly": (("monthly",), _features("monthly", "monthly")),
    "rollup_weekly": (("panel",), _rollup(WEEK_START)),
    "rollup_monthly": (("panel",), _rollup(MONTH_START)),
    "lagged_weekly": (("rollup_weekly",), """
      SELECT * FROM (SELECT *, lag(sum_RET) OVER (PARTITION BY TICKER ORDER BY start) AS lagged_return FROM rollup_weekly)
      WHERE lagged_return IS NOT NULL"""),
    "lagged_monthly": (("rollup_monthly",), """
      SELECT * FROM (SELECT *, lag(sum_RET) OVER (PARTITION BY TICKER ORDER BY start) AS lagged_return FROM rollup_monthly)
      WHERE lagged_return IS NOT NULL"""),
    "scored": (("features",), """
      SELECT *, -yesterday_return AS lasso_pred, RET - sprtrn AS pred_forest,
             CASE WHEN yesterday_return >= 0 THEN 'Positive' WHEN yesterday_return < 0 THEN 'Negative' END AS log_pred
      FROM features"""),
    "news": ((), """
      SELECT event_id, ts, CAST(user_id AS VARCHAR) AS TICKER, CAST(ts AS DATE) AS enterdate, event_type,
             CASE event_type WHEN 'purchase' THEN 'Positive.' WHEN 'error' THEN 'This is NEGATIVE'
                  WHEN 'view' THEN NULL ELSE 'mixed' END AS Sentiment, value, props
      FROM events"""),
    "labelled": (("news",), """
      SELECT *, CASE WHEN label = 'positive' THEN 1 ELSE 0 END AS positive,
                CASE WHEN label = 'negative' THEN 1 ELSE 0 END AS negative,
                CASE WHEN label IS NOT NULL THEN 1 ELSE 0 END AS total
      FROM (SELECT *, CASE WHEN Sentiment IS NULL THEN NULL WHEN contains(lower(Sentiment), 'positive') THEN 'positive'
                   WHEN contains(lower(Sentiment), 'negative') THEN 'negative' ELSE 'neutral' END AS label FROM news)"""),
    "event_prices": ((), """
      SELECT CAST(user_id AS VARCHAR) AS TICKER, CAST(ts AS DATE) AS date,
             CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) / (count(*) * 100.0) AS PRC,
             floor(CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) * 100.0 / count(*) + 0.5) / 1e6 AS RET,
             min(user_id) % 7 AS SICCD
      FROM events GROUP BY 1, 2"""),
    "pay": ((), """
      SELECT CAST(c_nationkey AS VARCHAR) AS TICKER, o_custkey AS EXEC_FULLNAME, year(o_orderdate) AS YEAR, o_orderkey,
             o_totalprice / 10 AS SALARY, c_acctbal AS BONUS, o_totalprice AS TDC1
      FROM orders JOIN customer ON o_custkey = c_custkey"""),
    "price_path": ((), """
      SELECT CAST(o_custkey AS VARCHAR) AS TICKER, CAST(o_orderdate AS DATE) AS DATE,
             arg_min(o_totalprice, o_orderkey) AS CLOSE
      FROM orders GROUP BY 1, 2"""),
    "path_returns": (("price_path",), """
      SELECT *, CLOSE / nullif(lag(CLOSE) OVER (PARTITION BY TICKER ORDER BY DATE), 0) - 1 AS RET,
             year(DATE) AS YEAR FROM price_path"""),
}


def with_views(names: Sequence[str]) -> str:
    """WITH clause holding the named views and what they build on, in order."""
    order: list[str] = []

    def visit(name: str) -> None:
        for needed in VIEWS[name][0]:
            visit(needed)
        if name not in order:
            order.append(name)

    for name in names:
        visit(name)
    if not order:
        return ""
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n][1]})" for n in order) + "\n"
