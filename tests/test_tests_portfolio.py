"""Two-sample tests and portfolios against direct computation."""

import random
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.config import NEWS_GATES
from tidemark.functions.distributions import normal_two_sided, student_two_sided
from tidemark.operators import hypothesis, portfolio

C = F.col


def two_groups(spark, seed=0):
    rng = random.Random(seed)
    data = [(int(rng.random() < 0.4), round(rng.gauss(0, 1), 1)) for _ in range(300)]
    return data, spark.createDataFrame(data, "d int, x double")


def test_pooled_t(spark):
    data, df = two_groups(spark)
    a, b = (np.array([x for d, x in data if d == k]) for k in (1, 0))
    pooled = ((len(a) - 1) * a.var(ddof=1) + (len(b) - 1) * b.var(ddof=1)) / (len(a) + len(b) - 2)
    t = (a.mean() - b.mean()) / np.sqrt(pooled * (1 / len(a) + 1 / len(b)))
    row = hypothesis.pooled_t_test(df, "x", ["d"]).first()
    assert row["t"] == pytest.approx(t) and row["p_value"] == pytest.approx(student_two_sided(t, len(data) - 2))


def test_welch(spark):
    data, df = two_groups(spark, 1)
    a, b = (np.array([d for d, x in data if (x >= 0) == up], dtype=float) for up in (True, False))
    va, vb = a.var(ddof=1) / len(a), b.var(ddof=1) / len(b)
    row = hypothesis.welch_t_test(df, ["d"], "x").first()
    assert row["t"] == pytest.approx((a.mean() - b.mean()) / np.sqrt(va + vb))
    assert row["df"] == pytest.approx((va + vb) ** 2 / (va**2 / (len(a) - 1) + vb**2 / (len(b) - 1)))


def test_mann_whitney_with_ties(spark):
    data, df = two_groups(spark, 2)
    a, b = ([x for d, x in data if d == k] for k in (1, 0))
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    n, ties = len(data), sum(c**3 - c for c in np.unique([x for _, x in data], return_counts=True)[1])
    spread = np.sqrt(len(a) * len(b) / 12 * (n + 1 - ties / (n * (n - 1))))
    z = (max(u, len(a) * len(b) - u) - len(a) * len(b) / 2 - 0.5) / spread
    row = hypothesis.mann_whitney(df, "x", ["d"]).first()
    assert row["u"] == pytest.approx(u) and row["p_value"] == pytest.approx(min(1.0, normal_two_sided(z)))


def scored(spark):
    rng = random.Random(4)
    data = []
    for i in range(40):
        for t in "ABCDE":
            quiet = i == 7  # a date without news, so news rules hold nothing
            data.append((
                t, date(2024, 1, 1) + timedelta(i), rng.uniform(-0.05, 0.05), rng.choice([-1.0, 0.0, 1.0]),
                rng.choice([-1.0, 1.0]), rng.choice(["Positive", "Negative", None]), 0 if quiet else rng.randint(0, 5),
            ))
    names = "TICKER string, date date, ret double, lasso_pred double, pred_forest double, log_pred string, total int"
    return data, spark.createDataFrame(data, names).withColumn("dummy_total", (C("total") >= 1).cast("int"))


def brute(data, rule):
    value, curve = 100000.0, []
    days = sorted({d[1] for d in data})
    for day in days[:-1]:
        held = [(rule(d), d[2]) for d in data if d[1] == day]
        n = sum(p != 0 for p, _ in held)
        if n:
            value += sum(p * r for p, r in held) * value / n
        curve.append((day, value))
    return curve


RULES = {
    "news": lambda d: int(d[6] >= 1),
    "lasso": lambda d: int(d[3] > 0) - int(d[3] < 0),
    "log_news": lambda d: (int(d[5] == "Positive") - int(d[5] == "Negative")) * int(d[6] >= 1),
    "forest_lasso_news": lambda d: (int(d[4] > 0 and d[3] > 0) - int(d[4] < 0 and d[3] < 0)) * int(d[6] >= 1),
    "all_news": lambda d: (
        int(d[4] > 0 and d[3] > 0 and d[5] == "Positive") - int(d[4] < 0 and d[3] < 0 and d[5] == "Negative")
    ) * int(d[6] >= 1),
}


def test_backtest_equals_the_loop(spark):
    data, df = scored(spark)
    curves = portfolio.backtest(df, "ret").collect()
    assert len({r["strategy"] for r in curves}) == 11
    for name, rule in RULES.items():
        got = sorted((r["date"], r["value"]) for r in curves if r["strategy"] == name)
        want = brute(data, rule)
        assert [d for d, _ in got] == [d for d, _ in want]
        assert [v for _, v in got] == pytest.approx([v for _, v in want])


def test_quiet_date_leaves_value_unchanged(spark):
    _, df = scored(spark)
    got = portfolio.backtest(df, "ret", rules=["news"]).orderBy("date").collect()
    assert got[7]["value"] == pytest.approx(got[6]["value"])


def test_gates(spark):
    data, df = scored(spark)
    got = portfolio.positions_long(df, NEWS_GATES["dowjones", "monthly"])
    held = got.filter((C("strategy") == "lasso_news") & (C("position") != 0)).count()
    assert held == sum(d[6] > 2 and d[3] != 0 for d in data)
    assert got.filter((C("strategy") == "news") & (C("position") != 0)).count() == 0


def test_ranks_and_weights(spark):
    data = [(f"T{i:02d}", 2020 + i % 2, "LR", float(i // 3)) for i in range(30)] + [("X", 2022, "LR", 1.0), ("Y", 2022, "LR", None)]
    df = spark.createDataFrame(data, "TICKER string, YEAR int, MODEL string, EXP double")
    weights = portfolio.long_short_weights(df)
    totals = {r["YEAR"]: r["s"] for r in weights.groupBy("YEAR").agg(F.sum(F.abs("POS")).alias("s")).collect()}
    assert totals == pytest.approx({2020: 1.0, 2021: 1.0, 2022: 1.0})
    ranks = {(r["TICKER"], r["YEAR"]): r["RANK"] for r in portfolio.rank_predictions(df).collect()}
    for y in (2020, 2021):
        own = sorted((d for d in data if d[1] == y), key=lambda d: (-d[3], d[0]))
        assert [ranks[d[0], y] for d in own] == list(range(1, 16))
    assert all(ranks[r["TICKER"], r["YEAR"]] == r["RANK"] for r in weights.collect())


def test_dates_without_held_companies_return_zero(spark):
    predictions = spark.createDataFrame([(f"T{i}", 2020, "LR", float(-i)) for i in range(9)], "TICKER string, YEAR int, MODEL string, EXP double")
    returns = spark.createDataFrame(
        [("T0", 2020, "d1", 0.8), ("T7", 2020, "d1", 0.4), ("T8", 2020, "d2", 0.5), ("other", 2020, "d3", 0.5)],
        "TICKER string, YEAR int, DATE string, RET double",
    )
    got = portfolio.portfolio_returns(portfolio.join_positions(returns, portfolio.all_positions(predictions)))
    assert {r["DATE"]: r["RET"] for r in got.collect()} == pytest.approx({"d1": 0.05, "d2": 0.0})


def test_weights_cut_groups_before_the_shuffle(spark):
    df = spark.createDataFrame([("A", 2020, "LR", 1.0)], "TICKER string, YEAR int, MODEL string, EXP double")
    assert "WindowGroupLimit" in portfolio.long_short_weights(df)._jdf.queryExecution().executedPlan().toString()
