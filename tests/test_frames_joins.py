"""Shaping and joining on small frames."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from tidemark.operators import annual, frames, joins
from tidemark.session import scratch_path
from tidemark.sources import files

C = F.col


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_keep_first(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 3, "z")], "k string, o int, v string")
    assert rows(frames.keep_first(df, ["k"], ["o"])) == [("a", 1, "y"), ("b", 3, "z")]
    assert rows(frames.keep_first(df.select("k"), ["k"], [])) == [("a",), ("b",)]


def test_explode_tickers(spark):
    df = spark.createDataFrame([("NYSE:AAA, BBB",), ("CCC",)], "t string")
    assert [r["u"] for r in frames.explode_tickers(df, "t", "u").collect()] == ["AAA", "BBB", "CCC"]


def test_override_and_append(spark):
    df = spark.createDataFrame([("a", 1, 5.0), ("a", 2, None)], "t string, y int, v double")
    fixes = spark.createDataFrame([("a", 1, 9.0), ("z", 1, 0.0)], "t string, y int, v double")
    assert rows(frames.override(df, ["t", "y"], "v", fixes).na.fill(-1.0)) == [("a", 1, 9.0), ("a", 2, -1.0)]
    assert frames.append_rows(df, [{"t": "b", "y": 3, "v": None}]).count() == 3


def test_profile(spark):
    df = spark.createDataFrame([(1, None), (2, "b")], "a int, b string")
    assert rows(frames.profile(df)) == [("a", "int", 2, 2), ("b", "string", 1, 2)]


@pytest.mark.parametrize("how", ["left", "inner"])
def test_lookup_join_equals_plain_join_with_hot_and_null_keys(spark, how):
    facts = spark.range(3000).select(C("id"), F.when(C("id") % 3 == 0, 7).when(C("id") % 3 == 1, C("id") % 400).alias("k"))
    lookup = spark.range(300).select(C("id").alias("k"), (C("id") * 2).alias("v")).union(spark.createDataFrame([(None, 5)], "k long, v long"))
    plain = rows(facts.join(lookup, "k", how).select("id", "k", "v").na.fill(-1))
    for limit in ("-1", "10m"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        got = joins.lookup_join(facts, lookup, ["k"], how, hot_share=0.05, copies=8)
        assert rows(got.select("id", "k", "v").na.fill(-1)) == plain
        small = joins.lookup_join(facts.limit(200), lookup.limit(3), ["k"], how, hot_share=0.05)
        assert small.count() == facts.limit(200).join(lookup.limit(3), "k", how).count()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("how", ["right", "full", "outer", "left_anti", "cross"])
def test_lookup_join_refuses_joins_that_keep_lookup_rows(spark, how):
    facts = spark.createDataFrame([(1,)], "k int")
    with pytest.raises(ValueError):
        joins.lookup_join(facts, facts, ["k"], how)


def test_hot_and_null_keys_are_spread(spark):
    facts = spark.range(2000).select(C("id"), F.when(C("id") % 2 == 0, 1).alias("k"))
    lookup = spark.createDataFrame([(1, "x")], "k int, v string")
    plan = joins.lookup_join(facts, lookup, ["k"])._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" in plan


def test_attach_tickers_drops_unmatched(spark):
    news = spark.createDataFrame([(1, "h1"), (2, "h2"), (3, "h3")], "gvkey int, headline string")
    codes = spark.createDataFrame([(1, "B"), (1, "A"), (1, "B"), (2, "C")], "gvkey int, TICKER string")
    got = joins.attach_tickers(news, codes).select("gvkey", "headline", "TICKER")
    assert rows(got) == [(1, "h1", "A"), (2, "h2", "C")]


def test_panel_build_and_next_day(spark):
    prices = spark.createDataFrame(
        [("A", date(2024, 1, 1), 1.0), ("A", date(2024, 1, 2), 2.0), ("B", date(2024, 1, 1), 3.0)],
        "TICKER string, date date, RET double",
    )
    counts = spark.createDataFrame(
        [(date(2024, 1, 1), "A", 1, 0, 2)], "enterdate date, TICKER string, positive int, negative int, total int"
    )
    panel = joins.build_panel(prices, counts).select("TICKER", "date", "positive", "total")
    assert rows(panel) == [("A", date(2024, 1, 1), 1, 2), ("A", date(2024, 1, 2), 0, 0)]
    news = spark.createDataFrame([("A", date(2024, 1, 1), 1), ("A", date(2024, 1, 5), 1)], "TICKER string, date date, positive int")
    moved = joins.next_day_returns(news, prices, ["positive"], ["TICKER"])
    assert rows(moved.select("date", "yesterday_positive", "RET")) == [(date(2024, 1, 2), 1, 2.0)]


def test_join_by_position(spark):
    a = spark.createDataFrame([(3,), (1,), (2,)], "a int")
    b = spark.createDataFrame([("x",), ("y",)], "b string")
    assert rows(joins.join_by_position(a, b, ["a"], ["b"])) == [(1, "x"), (2, "y")]


def test_tenure_restarts_after_a_gap(spark):
    pay = spark.createDataFrame([("T", "P", y) for y in (2010, 2011, 2013, 2014, 2015)], "TICKER string, EXEC_FULLNAME string, YEAR int")
    got = annual.with_tenure(pay).orderBy("YEAR").collect()
    assert [r["TENURE"] for r in got] == [1, 2, 1, 2, 3]


def test_culture_counts(spark):
    reports = spark.createDataFrame(
        [("nvda", 2015, 10.0), ("nvda", 2016, None), ("jpm", 2013, 4.0), ("aapl", 2014, 1.0)], "ticker string, year int, count double"
    )
    assert rows(annual.culture_counts(reports)) == [
        ("aapl", 2014, 3.0), ("jpm", 2023, 2.0), ("nvda", 2015, 10.0), ("nvda", 2016, 3.0),
    ]


def test_factor_table(spark):
    pay = spark.createDataFrame([("AAPL", 2014, 1.0), ("WMT", 2014, 2.0)], "TICKER string, YEAR int, SALARY_SALARY_mean double")
    developments = spark.createDataFrame(
        [("Apple Inc.", 2014, 249), ("Unknown Co", 2014, 5)], "companyname string, year int, count bigint"
    )
    culture = spark.createDataFrame([("aapl", 2014, 3.0), ("wmt", 2014, 4.0)], "ticker string, year int, culture_emphasis double")
    assert rows(annual.factor_table(pay, developments, culture)) == [("AAPL", 2014, 1.0, 249, 3.0)]


@pytest.mark.parametrize("n, shards", [(103, 10), (7, 10), (100, 4)])
def test_shards(spark, n, shards):
    got = files.with_shard(spark.range(n).withColumn("id", C("id") * 3), "id", shards).collect()
    length = n // shards
    want = {3 * i: (min(i // length, shards - 1) + 1 if length else shards) for i in range(n)}
    assert {r["id"]: r["shard"] for r in got} == want


def test_listed_files_pass_over_missing(spark):
    path = scratch_path(spark, "one")
    files.write_table(spark.createDataFrame([(1, "a")], "i int, s string"), path, "csv")
    got = files.read_listed(spark, [path, path + "-not-there"], "i int, s string")
    assert rows(got.select("i", "s")) == [(1, "a")]
    with pytest.raises(FileNotFoundError):
        files.read_listed(spark, [path + "-x"], "i int")


def test_pages(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"page": 3,\n "content": [{"title": "a", "n": 1}, {"title": "b", "n": 2}]}')
    got = files.read_pages(spark, str(tmp_path), "title string, n int")
    assert rows(got) == [(3, "a", 1), (3, "b", 2)]
