"""Scalar expressions on hand-made values."""

import math
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions import dates, distributions, labels, text, values

C = F.col


def column(spark, data, kind, expression):
    frame = spark.createDataFrame([(x,) for x in data], f"x {kind}")
    return [r[0] for r in frame.select(expression(C("x"))).collect()]


def days(*texts):
    return [date.fromisoformat(t) for t in texts]


def test_week_borders(spark):
    sample = days("2024-01-01", "2024-01-02", "2024-01-07", "2024-01-08", "2024-01-30")
    assert column(spark, sample, "date", dates.week_end_monday) == days(
        "2024-01-01", "2024-01-08", "2024-01-08", "2024-01-08", "2024-02-05"
    )
    assert column(spark, sample, "date", dates.week_start_sunday) == days(
        "2023-12-31", "2023-12-31", "2024-01-07", "2024-01-07", "2024-01-28"
    )


def test_parse_times(spark):
    assert column(spark, ["05JAN2023:10:11:12.345", "x", None], "string", lambda c: dates.parse_time(c, "news_clock")) == [
        datetime(2023, 1, 5, 10, 11, 12, 345000), None, None,
    ]
    assert column(spark, ["1/5/2023", "12/31/2023"], "string", lambda c: dates.parse_date(c, "us_date")) == days(
        "2023-01-05", "2023-12-31"
    )


def test_market_session_borders(spark):
    moments = [datetime(2024, 1, 2, *t) for t in ((9, 29, 59), (9, 30, 0), (16, 30, 0), (16, 30, 1))]
    moments.append(datetime(2024, 1, 2, 16, 30, 0, 5))
    assert column(spark, moments + [None], "timestamp", dates.market_session) == [
        "pre_market_hours", "market_hours", "market_hours", "post_market_hours", "post_market_hours", None,
    ]


def test_day_type(spark):
    assert column(spark, days("2024-01-05", "2024-01-06", "2024-01-07", "2024-01-08"), "date", dates.day_type) == [
        "Weekday", "Weekend", "Weekend", "Weekday",
    ]


def test_numbers(spark):
    assert column(spark, ["1.5", "C", None, "-2"], "string", values.to_number) == [1.5, None, None, -2.0]
    assert column(spark, ["$1,234.5", "n/a"], "string", values.digits_to_number) == [1234.5, None]
    assert column(spark, [0, 3, 4, None, -1], "int", lambda c: values.band_label(c, values.even_labels(4))) == [
        "0-25%", "75-100%", None, None, None,
    ]
    assert column(spark, ["a", "z", None], "string", lambda c: values.lookup(c, {"a": 1})) == [1, None, None]
    assert column(spark, [0, 1, 7, None], "int", values.at_least_one) == [0, 1, 1, 0]
    assert column(spark, [0.0, 4.0], "double", lambda c: values.ratio(F.lit(2), c)) == [None, 0.5]


def test_labels(spark):
    sample = ["Positive.", "This is NEGATIVE", "mixed", None, "positive and negative"]
    assert column(spark, sample, "string", labels.normalise_label) == [
        "positive", "negative", "neutral", None, "positive",
    ]
    assert column(spark, sample, "string", lambda c: labels.mentions(c, "negative")) == [0, 1, 0, 0, 1]
    frame = spark.createDataFrame([(1, 0, 0), (1, 1, 0), (1, 1, 1), (0, 0, 0)], "p int, n int, u int")
    named = labels.last_true([(C("p"), "positive"), (C("n"), "negative"), (C("u"), "neutral")])
    assert [r[0] for r in frame.select(named).collect()] == ["positive", "negative", "neutral", ""]


def test_text(spark):
    sample = "short\n" + "a" * 20 + "\n" + "b" * 19 + "\n" + "c" * 25
    assert column(spark, [sample], "string", text.long_lines) == ["a" * 20 + "\n" + "c" * 25]
    assert column(spark, ["about 18 or 20", "none", None], "string", text.first_integer) == [18, None, None]
    assert column(spark, ["a\nb\nlast", "one", "x\n"], "string", text.last_line) == ["last", "one", ""]
    told = ["Our CULTURE is good. We sell things! Does culture pay? ", "Nothing."]
    assert column(spark, told, "string", lambda c: text.topic_sentences(c, ["culture"])) == [2, 0]
    assert column(
        spark, ["Good good gain", "gain, loss", "loss", None], "string", lambda c: text.word_list_label(c, ["good", "gain"], ["loss"])
    ) == ["positive", "neutral", "negative", None]


def test_whole_text_is_read(spark):
    long = "x" * 200_000 + " culture."
    assert column(spark, [long], "string", lambda c: text.topic_sentences(c, ["culture"])) == [1]


@pytest.mark.parametrize("t, df, p", [(2.0, 1, 0.2951672353), (2.0, 2, 0.1835034191), (2.0422724563, 30, 0.05), (0.0, 5, 1.0)])
def test_student_p(t, df, p):
    # for 1 and 2 degrees of freedom the tail has a closed form
    if df == 1:
        p = 1 - 2 / math.pi * math.atan(t)
    if df == 2:
        p = 1 - t / math.sqrt(2 + t * t)
    assert distributions.student_two_sided(t, df) == pytest.approx(p, abs=1e-6)


def test_normal_p(spark):
    assert distributions.normal_two_sided(1.959963984540054) == pytest.approx(0.05, abs=1e-12)
    frame = spark.createDataFrame([(2.0, 2.0), (None, 3.0)], "t double, df double")
    got = [r[0] for r in frame.select(distributions.t_p_value("t", "df")).collect()]
    assert got[0] == pytest.approx(1 - 2 / math.sqrt(6)) and got[1] is None


def test_scorer_hook(spark):
    frame = spark.createDataFrame([(1, "up up"), (2, "down")], "id int, headline string")
    got = text.label_with(frame, "headline", lambda s: s.str.contains("up").map({True: "positive", False: "negative"}))
    assert [(r["id"], r["Sentiment"]) for r in got.orderBy("id").collect()] == [(1, "positive"), (2, "negative")]
