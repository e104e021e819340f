"""Stored layouts and states: bucketed tables, stored sketches, landed pages, days that late headlines correct, the text model."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tidemark.config import DAILY
from tidemark.operators import order, text_model, windows
from tidemark.session import materialise, scratch_path
from tidemark.sources import files
from tidemark.streaming import day_upserts

C = F.col


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_windows_over_a_bucketed_table_shuffle_nothing(spark):
    rows = spark.range(4000).select((C("id") % 37).cast("string").alias("TICKER"), F.date_add(F.lit("2020-01-01"), (C("id") / 37).cast("int")).alias("date"), F.rand(3).alias("PRC"), (F.rand(4) / 10).alias("RET"))
    rows = materialise(rows)
    held = files.store_bucketed(rows, scratch_path(spark, "bucketed"), "TICKER", ["date"], 4)
    built = {
        "averages": lambda df: windows.with_averages(df, DAILY),
        "standardised": lambda df: windows.standardise(df, ["PRC", "RET"]),
        "compounded": lambda df: df.select("TICKER", "date", windows.compounded("RET", "date").alias("c")),
    }
    for name, build in built.items():
        assert "Exchange" not in plan(build(held)), name
        assert "Exchange" in plan(build(rows)), name
        shown = [[F.round(C(f"`{c}`"), 9) if kind == "double" else C(f"`{c}`") for c, kind in build(df).dtypes] for df in (held, rows)]
        assert build(held).select(*shown[0]).exceptAll(build(rows).select(*shown[1])).count() == 0, name


def test_quantiles_from_stored_sketches_are_exact(spark):
    rng = random.Random(8)
    data = [(i % 12, rng.choice([rng.gauss(0, 1), 3.0, rng.random() * 1e6, None])) for i in range(20_000)]
    df = materialise(spark.createDataFrame(data, "month int, v double"))
    sketches = materialise(order.value_sketches(df, "v", ["month"]))
    probs = [i / 10 for i in range(11)]
    for months in (range(12), (3,), (1, 7)):
        rows, some = df.filter(C("month").isin(*months)), sketches.filter(C("month").isin(*months))
        assert order.quantile_values(rows, "v", probs, some) == pytest.approx(order.quantile_values(rows, "v", probs))
    assert order.quantile_values(df.filter("month > 99"), "v", [0.5], sketches.filter("month > 99")) == [None]


def test_pages_are_read_once_over_restarts(spark, tmp_path):
    landed, out, state = tmp_path / "pages", str(tmp_path / "out"), str(tmp_path / "state")
    landed.mkdir()

    def land(page, ids):
        (landed / f"{page}.json").write_text(json.dumps({"page": page, "content": [{"id": i} for i in ids]}) + "\n")

    def run():
        return sorted((r["page"], r["id"]) for r in files.land_pages(files.stream_pages(spark, str(landed), "id bigint", 1), out, state).collect())

    land(1, [1, 2])
    land(2, [])
    assert run() == [(1, 1), (1, 2)]
    land(3, [2, 7])
    assert run() == [(1, 1), (1, 2), (3, 2), (3, 7)]
    assert run() == [(1, 1), (1, 2), (3, 2), (3, 7)]


def test_late_headlines_correct_their_day(spark, tmp_path):
    feed, out, state = tmp_path / "feed", str(tmp_path / "out"), str(tmp_path / "state")
    rng, start = random.Random(1), datetime(2024, 1, 1)
    data = []
    for i in range(600):
        moment = start + timedelta(hours=rng.randrange(24 * 20))
        data.append((i, moment, f"T{rng.randrange(5)}", rng.choice(["Positive", "so NEGATIVE", "mixed", None])))
    data += data[:40] + [(None, start, "T1", "Positive"), (None, start, "T1", "Positive"), (9999, start, None, "Negative")]
    schema = "event_id long, ts timestamp, TICKER string, Sentiment string"
    rng.shuffle(data)
    before = spark.conf.get(day_upserts.STORE)
    for part in range(3):  # every part holds headlines of all days
        spark.createDataFrame(data[part::3], schema).coalesce(1).write.mode("append").parquet(str(feed))
        versions = day_upserts.day_versions(spark.readStream.schema(schema).parquet(str(feed)), "ts", "TICKER", "event_id", "Sentiment")
        day_upserts.run_upserts(versions, out, state)
        got = {(r["enterdate"], r["TICKER"]): (r["positive"], r["negative"], r["total"]) for r in day_upserts.latest_days(spark, out).collect()}
        want, seen = {}, set()
        for ident, ts, ticker, label in [d for p in range(part + 1) for d in data[p::3]]:
            if ident is not None and ident in seen:
                continue
            seen.add(ident)
            key = (ts.date(), ticker)
            low = (label or "").lower()
            flags = ("positive" in low, "positive" not in low and "negative" in low, label is not None)
            want[key] = tuple(a + b for a, b in zip(want.get(key, (0, 0, 0)), flags))
        assert got == want
    assert spark.conf.get(day_upserts.STORE) == before


class _Store:
    """A state store that counts its calls."""

    def __init__(self):
        self.value, self.entries, self.calls = None, {}, 0

    def getValueState(self, *_):
        return self

    getMapState = getValueState

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value

    def containsKey(self, key):
        self.calls += 1
        return key in self.entries

    def updateValue(self, key, value):
        self.calls += 1
        self.entries[key] = value


class _Clock:
    def __init__(self, now):
        self.now = now

    def getCurrentProcessingTimeInMs(self):
        return self.now


def _batch(processor, now, rows):
    given = [Row("enterdate", "bucket", "TICKER", "ident", *day_upserts.COUNTS)("d", 0, *r) for r in rows]
    return {r["TICKER"]: r["total"] for r in processor.handleInputRows(("d", 0), iter(given), _Clock(now))}


def test_days_of_a_bucket_take_two_calls_of_the_store():
    store, processor = _Store(), day_upserts.DayCounts(open_for_ms=100)
    processor.init(store)
    assert _batch(processor, 0, [(f"T{i % 50}", i, 1, 0, 1) for i in range(500)]) == {f"T{i}": 10 for i in range(50)}
    assert store.calls == 2
    # repeated ids change nothing, and only days that change are handed on
    assert _batch(processor, 60, [("T1", 1, 1, 0, 1), ("T2", 2, 1, 0, 1), ("T2", 900, 1, 0, 1)]) == {"T2": 11}
    # a day that nothing came for is forgotten, its neighbours in the bucket are not
    assert _batch(processor, 130, [("T1", 1, 1, 0, 1), ("T2", 900, 1, 0, 1), ("T2", None, 1, 0, 1)]) == {"T1": 1, "T2": 12}
    assert store.calls == 6


def test_ids_beyond_the_value_are_kept_one_by_one(spark, tmp_path):
    feed, out, state = tmp_path / "feed", str(tmp_path / "out"), str(tmp_path / "state")
    schema, moment = "event_id long, ts timestamp, TICKER string, Sentiment string", datetime(2024, 1, 1)
    for ids in ([1, 2, 3, 4], [4, 5, 1, 3], [6, 6, 2]):
        data = [(i, moment, name, "Positive") for i in ids for name in ("T", None)]
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(str(feed))
        stream = spark.readStream.schema(schema).parquet(str(feed))
        day_upserts.run_upserts(day_upserts.day_versions(stream, "ts", "TICKER", "event_id", "Sentiment", inline_ids=2), out, state)
    assert {r["TICKER"]: r["total"] for r in day_upserts.latest_days(spark, out).collect()} == {"T": 6, None: 6}


def test_text_model_learns_words_and_keeps_nulls(spark):
    rng = random.Random(5)
    words = {"positive": ["fine", "good"], "negative": ["awful", "bad"], "neutral": ["table", "chair"]}
    data = []
    for i in range(600):
        label = rng.choice(list(words))
        data.append((i, " ".join(rng.choice(words[label] + ["and", "the", "it", "of"]) for _ in range(12)), label))
    data += [(1000, None, "positive"), (1001, "", "neutral"), (1002, "good good", "unknown"), (1003, "bad awful bad", None)]
    rows = text_model.with_part(spark.createDataFrame(data, "id int, text string, label string"), ["id"])
    assert 0.2 < rows.filter("is_held_out").count() / len(data) < 0.4
    model = text_model.fit_text_model(rows.filter("NOT is_held_out"), "text", "label")
    scored = text_model.label_texts(model, rows)
    assert scored.columns == [*rows.columns, "Sentiment"] and scored.count() == len(data)
    labels = {r["id"]: r["Sentiment"] for r in scored.collect()}
    assert labels[1000] is None and labels[1002] == "positive" and labels[1003] == "negative"
    judged = text_model.agreement(scored.filter("is_held_out AND id < 1000"), "label", "Sentiment").first()
    assert judged["accuracy"] > 0.95 and judged["commonest"] < 0.5
    assert "Python" not in plan(scored)
