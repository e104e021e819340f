"""Windows, resampling and summaries on small frames."""

import math
from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.config import DAILY, MONTHLY, WEEKLY
from tidemark.operators import aggregates, resample, windows

C = F.col
START = date(2024, 1, 1)


def series(spark, data):
    return spark.createDataFrame(data, "TICKER string, date date, PRC double, VOL double, RET double")


def test_lags_and_full_windows_stay_inside_a_ticker(spark):
    data = [(t, START + timedelta(i), float(i + k), 1.0 * i, 0.1 * i) for t, k in (("A", 0), ("B", 100)) for i in range(12)]
    got = windows.with_averages(windows.with_lags(series(spark, data), DAILY), DAILY).orderBy("TICKER", "date").collect()
    assert got[0]["yesterday_return"] is None and got[11]["tomorrow_return"] is None and got[12]["yesterday_return"] is None
    assert got[11]["10_day_ma"] == pytest.approx(6.5) and got[20]["10_day_ma"] is None and got[21]["10_day_ma"] == pytest.approx(104.5)
    assert got[11]["proper"] is False  # the longer averages are missing


def test_one_shuffle_for_all_features(spark):
    data = [("A", START + timedelta(i), 1.0, 1.0, 0.1) for i in range(3)]
    df = series(spark, data).withColumns(
        {"ASKHI": C("PRC"), "BIDLO": C("PRC"), **{c: F.lit(1) for c in ("positive", "negative", "total")}}
    )
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        scaled = windows.standardise(windows.with_features(df, WEEKLY), ["PRC", "VOL"])
        plan = scaled._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("Exchange hashpartitioning") == 1


def test_one_row_per_day(spark):
    df = series(spark, [("A", START, 2.0, 1.0, 0.1), ("A", START, 1.0, 1.0, 0.1), ("B", START, 3.0, 1.0, 0.1)])
    assert windows.one_row_per_day(df).count() == 2


def test_running_product(spark):
    rs = [0.1, -0.5, 0.2, 0.2]
    df = series(spark, [("A", START + timedelta(i), 1.0, 1.0, r) for i, r in enumerate(rs)])
    got = [r["c"] for r in df.withColumn("c", windows.compounded("RET", "date")).orderBy("date").collect()]
    assert got == pytest.approx([0.1, -0.45, -0.34, -0.208])


def test_standardise(spark):
    df = series(spark, [("A", START + timedelta(i), x, 5.0, 0.0) for i, x in enumerate((1.0, 2.0, 3.0))])
    got = windows.standardise(df, ["PRC", "VOL"]).orderBy("date").collect()
    assert [r["PRC"] for r in got] == pytest.approx([-1.0, 0.0, 1.0]) and {r["VOL"] for r in got} == {None}


def test_outliers_in_sequence(spark):
    xs = [0.0] * 50 + [1.0] * 50 + [100.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    once = windows.drop_outliers(df, "x")
    assert once.count() == 100 and windows.drop_outliers(once, "x").count() == 100


def panel(spark, rows):
    full = [(t, d, "Co", 10, p, p + 1, p - 1, 1.0, 2, r, 1, 0, 1, 2 * p, s) for t, d, p, r, s in rows]
    return spark.createDataFrame(
        full,
        "TICKER string, date date, COMNAM string, SICCD int, PRC double, ASKHI double, BIDLO double, VOL double, "
        "SHROUT int, RET double, positive int, negative int, total int, market_cap double, sprtrn double",
    )


def test_weekly_resample_keeps_empty_weeks(spark):
    days = ["2024-01-01", "2024-01-02", "2024-01-07", "2024-01-08", "2024-01-30"]
    rows = [("A", date.fromisoformat(d), 10.0 + i, 0.1, 0.0) for i, d in enumerate(days)]
    got = resample.resample(panel(spark, rows), "weekly").orderBy("date").collect()
    assert [r["date"].isoformat() for r in got] == [
        "2024-01-01", "2024-01-08", "2024-01-15", "2024-01-22", "2024-01-29", "2024-02-05",
    ]
    assert got[1]["RET"] == pytest.approx(1.1**3 - 1) and got[1]["total"] == 3 and got[1]["PRC"] == pytest.approx(12.0)
    assert got[2]["RET"] == 0 and got[2]["total"] == 0 and got[2]["PRC"] is None and got[2]["SICCD"] is None


@pytest.mark.parametrize("freq, rule", [("weekly", "W-MON"), ("monthly", "ME")])
def test_resample_against_pandas(spark, freq, rule):
    rng = np.random.default_rng(1)
    rows = []
    for t in "AB":
        for i in sorted(rng.choice(400, 60, replace=False)):
            rows.append((t, START + timedelta(int(i)), float(rng.uniform(5, 9)), float(rng.normal(0, 0.1)), 0.01))
    got = resample.resample(panel(spark, rows), freq).orderBy("TICKER", "date").toPandas()
    frame = pd.DataFrame(rows, columns=["TICKER", "date", "PRC", "RET", "sprtrn"]).assign(total=1)
    frame["date"] = pd.to_datetime(frame["date"])
    want = (
        frame.groupby("TICKER").resample(rule, on="date")
        .agg({"PRC": "mean", "RET": lambda x: (1 + x).prod() - 1, "total": "sum"}).reset_index()
    )
    assert list(got["date"].astype(str)) == list(want["date"].dt.strftime("%Y-%m-%d"))
    assert np.allclose(got["RET"], want["RET"], atol=1e-9) and list(got["total"]) == list(want["total"])
    assert np.allclose(got["PRC"].astype(float), want["PRC"], atol=1e-6, equal_nan=True)


def test_rollup_weeks_start_on_sunday(spark):
    rows = [("A", date(2024, 1, 6), 1.0, 0.1, 0.2), ("A", date(2024, 1, 7), 2.0, 0.3, 0.4), ("A", date(2024, 1, 8), 2.0, 0.5, 0.4)]
    got = resample.rollup(panel(spark, rows), "weekly").orderBy("start").collect()
    assert [(r["start"].isoformat(), r["sum_RET"]) for r in got] == [("2023-12-31", 0.1), ("2024-01-07", 0.8)]


def test_shape_is_bias_corrected(spark):
    df = spark.createDataFrame([(x,) for x in (0.1, -0.5, 0.2, 0.2)], "x double")
    row = aggregates.shape(df, ["x"]).first()
    assert row["kurtosis"] == pytest.approx(3.576125, abs=1e-6) and row["skewness"] == pytest.approx(-1.887105, abs=1e-6)


def test_histogram_counts_everything(spark):
    xs = [0.0, 0.1, 0.5, 0.99, 1.0, None]
    got = aggregates.histogram(spark.createDataFrame([(x, 3) for x in xs], "x double, y int"), ["x", "y"], 4).collect()
    by = {(r["column"], r["bin"]): r["n"] for r in got}
    assert [by["x", i] for i in range(4)] == [2, 0, 1, 2] and sum(by["y", i] for i in range(4)) == 6


def test_mode_takes_smallest_on_ties(spark):
    df = spark.createDataFrame([("a", 2), ("a", 1), ("b", 3), ("b", 3), ("b", 1), ("c", None)], "g string, v int")
    assert sorted(tuple(r) for r in aggregates.mode_per_group(df, ["g"], "v").collect()) == [("a", 1), ("b", 3)]


def test_correlations_on_complete_rows(spark):
    rng = np.random.default_rng(0)
    xy = rng.normal(size=(200, 2)) + 1000
    data = [(float(a), float(a + b), None if i % 9 == 0 else float(b)) for i, (a, b) in enumerate(xy)]
    got = {(r["a"], r["b"]): r["correlation"] for r in aggregates.correlations(spark.createDataFrame(data, "x double, y double, z double"), ["x", "y", "z"]).collect()}
    kept = np.array([d for d in data if d[2] is not None], dtype=float)
    want = np.corrcoef(kept.T)
    assert got["x", "y"] == pytest.approx(want[0, 1]) and got["y", "z"] == pytest.approx(want[1, 2])


def test_correlations_read_the_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)
    rng = np.random.default_rng(1)
    data = [(float(a), float(b), 0.1) for a, b in rng.normal(size=(300, 2)) * [1, 1e-3] + [1e6, 5]]

    def part(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = spark.createDataFrame(data, "x double, y double, flat double").repartition(5).mapInArrow(part, "x double, y double, flat double")
    got = {(r["a"], r["b"]): r["correlation"] for r in aggregates.correlations(rows, ["x", "y", "flat"]).collect()}
    assert got["x", "y"] == pytest.approx(np.corrcoef(np.array(data)[:, :2].T)[0, 1], abs=1e-9)
    assert got["x", "flat"] is None and got["y", "flat"] is None and seen.value == 300
    empty = aggregates.correlations(spark.createDataFrame([], "x double, y double"), ["x", "y"]).collect()
    assert [tuple(r) for r in empty] == [("x", "y", None)]


def test_describe_and_box(spark):
    xs = [1.0, 2.0, 3.0, 10.0]
    df = spark.createDataFrame([("g", x) for x in xs], "g string, x double")
    row = aggregates.describe(df, "x").first()
    assert (row["q25"], row["q50"], row["q75"]) == pytest.approx((1.75, 2.5, 4.75)) and row["count"] == 4
    box = aggregates.box_stats(df, "x", ["g"]).first()
    assert box["upper_limit"] == pytest.approx(4.75 + 1.5 * 3.0)


def test_monthly_parameters():
    assert MONTHLY.average_columns == ("1_month_ma", "2_month_ma", "3_month_ma") and not math.isnan(MONTHLY.size_bins)
