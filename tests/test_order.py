"""Ranks, positions and quantiles against brute force, with ties, nulls and hot values."""

import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.operators import order

C = F.col


def table(spark, xs):
    return spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "id int, x double")


def mean_ranks(xs):
    known = [x for x in xs if x is not None]
    return {x: sum(y < x for y in known) + (sum(y == x for y in known) + 1) / 2 for x in set(known)}


def brute_groups(xs, k):
    n = sum(x is not None for x in xs)
    ranks = mean_ranks(xs)
    return [None if x is None else int(ranks[x] * k // (n + 1)) for x in xs]


def groups_of(spark, xs, k):
    got = order.rank_groups(table(spark, xs), "x", k, "g").collect()
    return [r["g"] for r in sorted(got, key=lambda r: r["id"])]


def test_rank_groups_ties_and_nulls(spark):
    assert groups_of(spark, [1.0, 2.0, 2.0, 3.0, None], 2) == [0, 1, 1, 1, None]


@pytest.mark.parametrize("seed", range(4))
def test_rank_groups_brute_force(spark, seed):
    rng = random.Random(seed)
    xs = [rng.choice([None, 0.5, rng.gauss(0, 1), round(rng.gauss(0, 1), 1)]) for _ in range(800)]
    xs += [7.25] * 400  # a third of the rows share one value
    assert groups_of(spark, xs, 10) == brute_groups(xs, 10)
    assert groups_of(spark, xs, 30) == brute_groups(xs, 30)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.integers(-5, 5).map(float)), min_size=1, max_size=40), st.integers(2, 7))
def test_rank_groups_property(spark, xs, k):
    if any(x is not None for x in xs):
        assert groups_of(spark, xs, k) == brute_groups(xs, k)


def test_lumps_are_used_and_quantiles_are_exact(spark):
    rng = np.random.default_rng(3)
    xs = np.concatenate([rng.lognormal(size=20_000), np.full(10_000, 0.75)])
    frame = spark.createDataFrame([(float(x),) for x in xs], "x double")
    probs = [0.025, 0.1, 0.25, 0.5, 0.9, 0.975]
    rows = order.counts_near(frame, "x", probs).collect()
    assert sum(r["n"] for r in rows) == 30_000 == rows[0]["total"]
    assert any(r["lump"] and r["n"] > 100 for r in rows) and len(rows) < 4_000
    assert order.quantile_values(frame, "x", probs) == pytest.approx(list(np.quantile(xs, probs)), abs=1e-12)


def test_missed_bracket_falls_back(spark, monkeypatch):
    """A sketch that is off must not change the answer."""
    real = order.counts_near

    def off(df, value, probs, groups=()):
        return real(df, value, [0.5 for _ in probs], groups)

    monkeypatch.setattr(order, "counts_near", off)
    xs = [float(i * i % 977) for i in range(900)]
    frame = table(spark, xs)
    assert order.quantile_values(frame, "x", [0.1, 0.9]) == pytest.approx(list(np.quantile(xs, [0.1, 0.9])))
    assert groups_of(spark, xs, 5) == brute_groups(xs, 5)
    halves = frame.withColumn("g", C("id") % 2)
    for row in order.grouped_quantiles(halves, "x", [0.1, 0.9], ["a", "b"], ["g"]).collect():
        assert list(row)[1:] == pytest.approx(list(np.quantile(xs[row["g"]::2], [0.1, 0.9])))


def test_quantile_bins(spark):
    xs = [1.0, 2.0, 3.0, 4.0, 5.0, None]
    rows = order.quantile_bins(table(spark, xs), "x", 2, "b", keep_edges=True).orderBy("id").collect()
    assert [r["b"] for r in rows] == [0, 0, 0, 1, 1, None]
    assert (rows[0]["b_low"], rows[0]["b_high"]) == (1.0, 3.0) and rows[4]["b_low"] == 3.0
    tied = table(spark, [1.0] * 9 + [2.0])
    with pytest.raises(ValueError):
        order.quantile_bins(tied, "x", 3, "b")
    assert {r["b"] for r in order.quantile_bins(tied, "x", 3, "b", duplicates="drop").collect()} == {0}


def test_row_index_by_group_and_direction(spark):
    data = [(f"g{i % 3}" if i % 2 else "hot", i) for i in range(500)]
    frame = spark.createDataFrame(data, "g string, i int")
    got = {(r["g"], r["i"]): r["at"] for r in order.row_index(frame, ["i"], "at", ["g"], ["i"]).collect()}
    for g in {g for g, _ in data}:
        members = sorted((i for h, i in data if h == g), reverse=True)
        assert [got[g, i] for i in members] == list(range(len(members)))


def test_value_counts_equal_window_rank(spark):
    xs = [float(i % 7) for i in range(100)]
    got = {r["x"]: (r["n"], r["before"]) for r in order.value_counts_in_order(table(spark, xs), "x").collect()}
    assert got == {v: (xs.count(v), sum(x < v for x in xs)) for v in set(xs)}


def test_grouped_quantiles(spark):
    rng = random.Random(5)
    data = [(rng.choice("ab"), rng.gauss(0, 1)) for _ in range(600)] + [("c", 1.0)]
    frame = spark.createDataFrame(data, "g string, x double")
    for row in order.grouped_quantiles(frame, "x", [0.25, 0.5, 0.75], ["a", "b", "c"], ["g"]).collect():
        own = [x for g, x in data if g == row["g"]]
        assert list(row)[1:] == pytest.approx(list(np.quantile(own, [0.25, 0.5, 0.75])))


def test_no_single_partition_over_rows(spark):
    frame = spark.range(1000).select(C("id"), (C("id") * 37 % 101).cast("double").alias("x"))
    plan = order.rank_groups(frame, "x", 10, "g")._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Exchange" not in plan
