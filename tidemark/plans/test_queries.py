"""H: two-sample tests. The SQL side integrates the distributions numerically."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import hypothesis
from tidemark.plans.registry import query
from tidemark.plans.summary_queries import CONTRAST_SQL, DUMMIES
from tidemark.sources.testdata import NUMERIC

C = F.col


def t_p_sql(source: str) -> str:
    """Two-sided Student p-value for columns t and df, by Simpson's rule after x = sqrt(df) tan(a)."""
    steps = 4000
    return f"""
      SELECT s.*, CASE WHEN t IS NULL THEN NULL ELSE 2 * exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(pi()) * area END AS p_value
      FROM ({source}) s JOIN (
        SELECT feature, sum(weight * pow(cos(least(lo + (hi - lo) * k / {steps}, pi() / 2)), df - 1)) * (hi - lo) / {steps} / 3 AS area
        FROM (SELECT feature, df, atan(abs(t) / sqrt(df)) AS lo, least(pi() / 2, atan(abs(t) / sqrt(df)) + 14 / sqrt(df)) AS hi
              FROM ({source}))
        CROSS JOIN (SELECT k, CASE WHEN k IN (0, {steps}) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END AS weight
                    FROM (SELECT unnest(range({steps + 1})) AS k))
        GROUP BY feature, lo, hi) a ON s.feature = a.feature"""


def z_p_sql(source: str) -> str:
    """Two-sided normal p-value for column z, by Simpson's rule."""
    steps = 4000
    return f"""
      SELECT s.*, least(2 * area / sqrt(2 * pi()), 1.0) AS p_value FROM ({source}) s JOIN (
        SELECT feature, sum(weight * exp(-0.5 * pow(z + 14.0 * k / {steps}, 2))) * 14.0 / {steps} / 3 AS area
        FROM ({source}) CROSS JOIN (SELECT k, CASE WHEN k IN (0, {steps}) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END AS weight
                    FROM (SELECT unnest(range({steps + 1})) AS k))
        GROUP BY feature) a ON s.feature = a.feature"""


# the spread of the driver's panel is mostly zero, so the tests look at the market capitalisation
VALUE = "market_cap"

POOLED_SQL = " UNION ALL ".join(
    f"""SELECT '{d}' AS feature, n1, n0, mean1, mean0,
          (mean1 - mean0) / sqrt(((n1 - 1) * var1 + (n0 - 1) * var0) / (n1 + n0 - 2) * (1.0 / n1 + 1.0 / n0)) AS t,
          CAST(n1 + n0 - 2 AS DOUBLE) AS df
        FROM (SELECT count({VALUE}) FILTER ({d} = 1) AS n1, count({VALUE}) FILTER ({d} = 0) AS n0,
                     avg({VALUE}) FILTER ({d} = 1) AS mean1, avg({VALUE}) FILTER ({d} = 0) AS mean0,
                     var_samp({VALUE}) FILTER ({d} = 1) AS var1, var_samp({VALUE}) FILTER ({d} = 0) AS var0 FROM features)"""
    for d in DUMMIES
)


@query(
    "h01_pooled_t_test",
    "feature:s n1:i n0:i mean1:f4 mean0:f4 t:f df:f p_value:f",
    t_p_sql(POOLED_SQL),
    ["features"],
)
def _(t):
    return hypothesis.pooled_t_test(t.features("daily", "prices"), VALUE, DUMMIES)


def _rank_sql(value: str) -> str:
    ranked = f"""SELECT {', '.join(DUMMIES)}, rank() OVER (ORDER BY {value}) + (count(*) OVER (PARTITION BY {value}) - 1) / 2.0 AS r
                 FROM features"""
    ties = f"SELECT sum(pow(c, 3) - c) AS ties FROM (SELECT CAST(count(*) AS DOUBLE) AS c FROM features GROUP BY {value})"
    return " UNION ALL ".join(
        f"""SELECT '{d}' AS feature, u, (greatest(u, n1 * n0 - u) - n1 * n0 / 2 - 0.5)
              / sqrt(n1 * n0 / 12 * (n1 + n0 + 1 - ties / ((n1 + n0) * (n1 + n0 - 1)))) AS z
            FROM (SELECT n1, n0, ties, r1 - n1 * (n1 + 1) / 2 AS u FROM (
              SELECT CAST(sum({d}) AS DOUBLE) AS n1, CAST(count(*) - sum({d}) AS DOUBLE) AS n0,
                     sum(CASE WHEN {d} = 1 THEN r END) AS r1 FROM ({ranked})) CROSS JOIN ({ties}))"""
        for d in DUMMIES
    )


@query("h02_mann_whitney", "feature:s u:f1 z:f p_value:f", z_p_sql(_rank_sql("RET")), ["features"])
def _(t):
    return hypothesis.mann_whitney(t.features("daily", "prices"), "RET", DUMMIES)


WELCH_SQL = " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, mean0 AS mean_negative, mean1 AS mean_positive, mean1 - mean0 AS mean_difference,
          (mean1 - mean0) / nullif(sqrt(a + b), 0) AS t, (a + b) * (a + b) / nullif(a * a / (n1 - 1) + b * b / (n0 - 1), 0) AS df
        FROM (SELECT n1, n0, mean1, mean0, var1 / n1 AS a, var0 / n0 AS b FROM (
          SELECT count("{c}") FILTER (tomorrow_return >= 0) AS n1, count("{c}") FILTER (tomorrow_return < 0) AS n0,
                 avg("{c}") FILTER (tomorrow_return >= 0) AS mean1, avg("{c}") FILTER (tomorrow_return < 0) AS mean0,
                 var_samp("{c}") FILTER (tomorrow_return >= 0) AS var1, var_samp("{c}") FILTER (tomorrow_return < 0) AS var0
          FROM features WHERE tomorrow_return IS NOT NULL))"""
    for c in NUMERIC + ["yesterday_return", "30_day_ma"]
)


@query(
    "h03_welch_t_test",
    "feature:s mean_negative:f4 mean_positive:f4 mean_difference:f4 t:f df:f4 p_value:f",
    t_p_sql(WELCH_SQL),
    ["features"],
)
def _(t):
    return hypothesis.welch_t_test(t.features(), NUMERIC + ["yesterday_return", "30_day_ma"], "tomorrow_return")


@query(
    "h04_dummy_test_table",
    "dummy:s mean_with:f4 mean_without:f4 volatility_with:f4 volatility_without:f4 mean_difference:f4 "
    "volatility_difference:f4 mean_p_value:f volatility_p_value:f",
    f"""SELECT c.*, m.p_value AS mean_p_value, v.p_value AS volatility_p_value
        FROM ({CONTRAST_SQL.replace('ASKHI - PRC', VALUE)}) c
        JOIN ({t_p_sql(POOLED_SQL)}) m ON m.feature = c.dummy
        JOIN ({z_p_sql(_rank_sql(VALUE))}) v ON v.feature = c.dummy""",
    ["features"],
)
def _(t):
    return hypothesis.dummy_test_table(t.features("daily", "prices"), VALUE, DUMMIES)
