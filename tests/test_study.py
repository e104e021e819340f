"""Whole studies on a small random panel."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark import config
from tidemark.plans import study
from tidemark.session import materialise, scratch_path

C = F.col


@pytest.fixture(scope="module")
def panel(spark):
    rng = random.Random(11)
    rows = []
    for day in range(150):
        market = rng.gauss(0, 0.01)
        for i in range(24):
            up, down = rng.randint(0, 2), rng.randint(0, 1)
            price = rng.uniform(5, 50)
            rows.append((
                f"T{i:02d}", date(2023, 1, 2) + timedelta(day), f"Company {i}", 10 * (i % 2), price, price + rng.random(),
                price - rng.random(), rng.uniform(1, 9), 10 + i, market + rng.gauss(0, 0.02), up, down, up + down,
                price * (10 + i), market,
            ))
    return materialise(spark.createDataFrame(
        rows,
        "TICKER string, date date, COMNAM string, SICCD int, PRC double, ASKHI double, BIDLO double, VOL double, "
        "SHROUT int, RET double, positive int, negative int, total int, market_cap double, sprtrn double",
    ))


@pytest.mark.parametrize("universe, freq", [("dowjones", "daily"), ("nasdaq", "weekly"), ("russell", "monthly")])
def test_every_summary_builds(panel, universe, freq):
    tables = study.return_summaries(panel, universe, freq)
    assert len(tables) == 11
    counts = {name: build().count() for name, build in tables.items()}
    if freq == "daily":
        assert counts["stock_deciles"] == 10 and counts["sizes"] == 2 and counts["industries"] == 2
    assert all(counts[name] > 0 for name in ("market", "stock_deciles", "sizes"))
    # months with 21 or more news items are left out of the limited count tables
    assert (counts["by_total"] > 0) == (freq != "monthly")


def test_parameters_cover_every_study():
    for universe in config.UNIVERSES:
        for freq in config.FREQUENCIES:
            assert (universe, freq) in config.SIZE_GROUPS
            if freq != "daily":
                assert (universe, freq) in config.NEWS_GATES


def test_summed_news_is_kept_by_every_grouping(panel):
    tables = study.return_summaries(panel, "sp500", "weekly")
    totals = [tables[n]().agg(F.sum("total")).first()[0] for n in ("stock_deciles", "sizes")]
    market = tables["market"]().agg(F.sum("sum_total")).first()[0]
    assert totals == [market, market]


def test_repeated_days_count_once(panel):
    twice = panel.union(panel.limit(500))
    once = {tuple(r) for r in study.features_of(panel, "daily").select("TICKER", "date", "yesterday_return").collect()}
    got = study.features_of(twice, "daily").select("TICKER", "date", "yesterday_return").collect()
    assert len(got) == len(once) and {tuple(r) for r in got} == once
    assert study.summary_rows(twice, "daily").count() == study.summary_rows(panel, "daily").count()


def test_store_features(spark, panel):
    path = scratch_path(spark, "features")
    study.store_features({"dowjones": panel}, path, ["daily", "monthly"])
    weekly = spark.read.option("basePath", path).parquet(f"{path}/universe=dowjones/freq=monthly")
    assert {"universe", "freq", "next_month_return"} <= set(weekly.columns) and weekly.count() == 24 * 5


def test_from_features_to_backtest(panel):
    features = study.features_of(panel, "daily")
    assert study.model_numbers(features, "daily") == [
        "VOL", "RET", "positive", "negative", "total", "sprtrn", "yesterday_return", "yesterday_volume", "Ask_minus_Bid"
    ]
    frame = study.model_frame(features, "daily")
    assert {"move_avg_10", "move_avg_20", "move_avg_30", "comp_size"} <= set(frame.columns)
    vectors = materialise(study.feature_vectors(frame, "daily"))
    target = config.BY_NAME["daily"].target
    trimmed = study.train_rows(vectors, "daily", "tree").agg(F.min(target), F.max(target)).first()
    whole = vectors.agg(F.min(target), F.max(target)).first()
    assert whole[0] < trimmed[0] and trimmed[1] < whole[1]
    scored = study.score(vectors, "daily")
    joined = scored.join(panel.select("TICKER", "date", "total"), ["TICKER", "date"]).withColumn(
        "dummy_total", (C("total") >= 1).cast("int")
    )
    curves = study.strategies(joined, "dowjones", "daily", after="2023-02-13")
    assert curves.select("strategy").distinct().count() == 11
    assert curves.agg(F.min("date")).first()[0] > date(2023, 2, 13)
    assert curves.filter(C("value") <= 0).count() == 0
