"""B and G: projections, cleaning, filters and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import dates, labels, values
from tidemark.operators import frames
from tidemark.operators.annual import development_counts
from tidemark.plans.registry import query

C = F.col


@query(
    "b01_parse_dates",
    "event_id:i iso_date:d news_clock:t us_date:d iso_clock:t compact_date:d bad:d",
    """SELECT event_id, CAST(ts AS DATE) AS iso_date, date_trunc('millisecond', ts) AS news_clock,
              CAST(ts AS DATE) AS us_date, date_trunc('second', ts) AS iso_clock, CAST(ts AS DATE) AS compact_date,
              CAST(NULL AS DATE) AS bad FROM events""",
)
def _(t):
    """Each event time is written as text in the five landed styles and read back."""
    texts = t["events"].select(
        "event_id",
        F.date_format("ts", "yyyy-MM-dd").alias("a"),
        F.upper(F.date_format("ts", "ddMMMyyyy:HH:mm:ss.SSS")).alias("b"),
        F.date_format("ts", "MM/dd/yyyy").alias("c"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("d"),
        F.date_format("ts", "yyyyMMdd").alias("e"),
        "event_type",
    )
    return texts.select(
        "event_id",
        dates.parse_date(C("a"), "iso_date").alias("iso_date"),
        dates.parse_time(C("b"), "news_clock").alias("news_clock"),
        dates.parse_date(C("c"), "us_date").alias("us_date"),
        dates.parse_time(C("d"), "iso_clock").alias("iso_clock"),
        dates.parse_date(C("e"), "compact_date").alias("compact_date"),
        dates.parse_date(C("event_type"), "iso_date").alias("bad"),
    )


@query(
    "b02_coerce_number",
    "o_orderkey:i amount:f2",
    """SELECT o_orderkey, TRY_CAST(CASE WHEN o_orderstatus = 'P' THEN o_orderpriority
                                        ELSE CAST(o_totalprice AS VARCHAR) END AS DOUBLE) AS amount FROM orders""",
)
def _(t):
    dirty = F.when(C("o_orderstatus") == "P", C("o_orderpriority")).otherwise(C("o_totalprice").cast("string"))
    return t["orders"].select("o_orderkey", values.to_number(dirty).alias("amount"))


@query(
    "b03_digits_to_number",
    "p_partkey:i brand:f kind:f",
    """SELECT p_partkey, TRY_CAST(nullif(regexp_replace(p_brand, '[^0-9.]', '', 'g'), '') AS DOUBLE) AS brand,
              TRY_CAST(nullif(regexp_replace(p_type, '[^0-9.]', '', 'g'), '') AS DOUBLE) AS kind FROM part""",
)
def _(t):
    return t["part"].select(
        "p_partkey",
        values.digits_to_number(C("p_brand")).alias("brand"),
        values.digits_to_number(C("p_type")).alias("kind"),
    )


@query(
    "b04_drop_columns",
    "TICKER:s date:d RET:f total:i",
    "SELECT TICKER, date, RET, total FROM panel",
    ["panel"],
)
def _(t):
    return t.panel.drop(
        "COMNAM", "SICCD", "PRC", "ASKHI", "BIDLO", "VOL", "SHROUT", "positive", "negative", "market_cap", "sprtrn"
    )


@query(
    "b05_rename_upper",
    "C_CUSTKEY:i C_NAME:s C_NATIONKEY:i C_ACCTBAL:f2 SEGMENT:s",
    """SELECT c_custkey AS "C_CUSTKEY", c_name AS "C_NAME", c_nationkey AS "C_NATIONKEY", c_acctbal AS "C_ACCTBAL",
              c_mktsegment AS "SEGMENT" FROM customer""",
)
def _(t):
    return frames.upper_columns(t["customer"].withColumnRenamed("c_mktsegment", "segment"))


@query(
    "b06_ids_as_text",
    "s_suppkey:s s_nationkey:s s_acctbal:f2",
    "SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier",
)
def _(t):
    return frames.as_text(t["supplier"], ["s_suppkey", "s_nationkey"])


@query(
    "b07_drop_missing",
    "TICKER:s any_rows:i subset_rows:i",
    """SELECT TICKER, count(CASE WHEN tomorrow_return IS NOT NULL AND yesterday_return IS NOT NULL
                                  AND "30_day_ma" IS NOT NULL THEN 1 END) AS any_rows,
              count(tomorrow_return) AS subset_rows FROM features GROUP BY TICKER""",
    ["features"],
)
def _(t):
    some = t.features().select("TICKER", "date", "tomorrow_return", "yesterday_return", "30_day_ma")
    every = frames.drop_missing(some).select("TICKER", F.lit(1).alias("a"), F.lit(0).alias("s"))
    subset = frames.drop_missing(some, ["tomorrow_return"]).select("TICKER", F.lit(0).alias("a"), F.lit(1).alias("s"))
    return every.union(subset).groupBy("TICKER").agg(F.sum("a").alias("any_rows"), F.sum("s").alias("subset_rows"))


@query(
    "b08_fill_missing",
    "event_id:i Sentiment:s",
    "SELECT event_id, coalesce(Sentiment, '') AS Sentiment FROM news",
    ["news"],
)
def _(t):
    return t.news.select("event_id", "Sentiment").fillna("", ["Sentiment"])


@query(
    "b09_key_case",
    "o_orderkey:i up:s low:s",
    "SELECT o_orderkey, upper(o_orderpriority) AS up, lower(o_orderpriority) AS low FROM orders",
)
def _(t):
    return t["orders"].select(
        "o_orderkey", F.upper("o_orderpriority").alias("up"), F.lower("o_orderpriority").alias("low")
    )


PRIORITY_WEIGHTS = {"1-URGENT": 5, "2-HIGH": 4, "3-MEDIUM": 3}


@query(
    "b10_dictionary_map",
    "o_orderkey:i weight:i",
    """SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 5 WHEN '2-HIGH' THEN 4 WHEN '3-MEDIUM' THEN 3 END
       AS weight FROM orders""",
)
def _(t):
    return t["orders"].select("o_orderkey", values.lookup(C("o_orderpriority"), PRIORITY_WEIGHTS).alias("weight"))


@query(
    "b11_keyed_override",
    "TICKER:s YEAR:i total:f2",
    """SELECT TICKER, YEAR, CASE WHEN n_name IS NOT NULL THEN n_nationkey ELSE total END AS total FROM (
         SELECT TICKER, YEAR, sum(CAST(round(TDC1 * 100) AS BIGINT)) / 100.0 AS total FROM pay GROUP BY 1, 2)
       LEFT JOIN nation ON CAST(n_nationkey AS VARCHAR) = TICKER AND YEAR = 1995 + n_regionkey""",
    ["pay"],
)
def _(t):
    """Yearly totals with one corrected year per nation."""
    totals = t.pay.groupBy("TICKER", "YEAR").agg(
        (F.sum(F.round(C("TDC1") * 100).cast("bigint")) / 100.0).alias("total")
    )
    fixes = t["nation"].select(
        C("n_nationkey").cast("string").alias("TICKER"),
        (C("n_regionkey") + 1995).alias("YEAR"),
        C("n_nationkey").cast("double").alias("total"),
    )
    return frames.override(totals, ["TICKER", "YEAR"], "total", fixes)


@query(
    "b12_append_rows",
    "TICKER:s YEAR:i n:i",
    """SELECT TICKER, YEAR, count(*) AS n FROM pay GROUP BY 1, 2
       UNION ALL SELECT 'extra', 2023, 2 UNION ALL SELECT 'extra', 2024, NULL""",
    ["pay"],
)
def _(t):
    counts = development_counts(t.pay, ["TICKER", "YEAR"]).withColumnRenamed("count", "n")
    return frames.append_rows(
        counts, [{"TICKER": "extra", "YEAR": 2023, "n": 2}, {"TICKER": "extra", "YEAR": 2024, "n": None}]
    )


@query(
    "b13_row_predicates",
    "TICKER:s n:i news:i",
    """SELECT TICKER, count(*) AS n, sum(total) AS news FROM panel
       WHERE date > DATE '1996-06-30' AND year(date) < 2001 AND total > 0 AND SICCD <> 150 GROUP BY TICKER""",
    ["panel"],
)
def _(t):
    kept = t.panel.filter(
        (C("date") > F.lit("1996-06-30").cast("date")) & (F.year("date") < 2001) & (C("total") > 0) & (C("SICCD") != 150)
    )
    return kept.groupBy("TICKER").agg(F.count(F.lit(1)).alias("n"), F.sum("total").alias("news"))


@query(
    "b14_labelled_bands",
    "event_id:i ten:s five:s two:s",
    """SELECT event_id,
         CASE event_id % 11 WHEN 0 THEN 'Bottom 10%' WHEN 1 THEN '10-20%' WHEN 2 THEN '20-30%' WHEN 3 THEN '30-40%'
              WHEN 4 THEN '40-50%' WHEN 5 THEN '50-60%' WHEN 6 THEN '60-70%' WHEN 7 THEN '70-80%' WHEN 8 THEN '80-90%'
              WHEN 9 THEN 'Top 10%' END AS ten,
         CASE event_id % 5 WHEN 0 THEN '0-20%' WHEN 1 THEN '20-40%' WHEN 2 THEN '40-60%' WHEN 3 THEN '60-80%'
              ELSE '80-100%' END AS five,
         CASE event_id % 30 > 20 WHEN true THEN 'Top 10' ELSE '11-30' END AS two FROM events""",
)
def _(t):
    from tidemark.config import DECILE_LABELS

    return t["events"].select(
        "event_id",
        values.band_label(C("event_id") % 11, DECILE_LABELS).alias("ten"),
        values.band_label(C("event_id") % 5, values.even_labels(5)).alias("five"),
        values.band_label((C("event_id") % 30 > 20).cast("int"), ("11-30", "Top 10")).alias("two"),
    )


@query(
    "b15_threshold_dummies",
    "TICKER:s date:d dummy_positive:i dummy_negative:i dummy_total:i",
    """SELECT TICKER, date, CAST(positive >= 1 AS INT) AS dummy_positive, CAST(negative >= 1 AS INT) AS dummy_negative,
              CAST(total >= 1 AS INT) AS dummy_total FROM panel""",
    ["panel"],
)
def _(t):
    return t.prices.select(
        "TICKER", "date", *[values.at_least_one(C(c)).alias(f"dummy_{c}") for c in ("positive", "negative", "total")]
    )


@query(
    "b16_label_flags",
    "event_id:i positive:i negative:i total:i",
    "SELECT event_id, positive, negative, total FROM labelled",
    ["labelled"],
)
def _(t):
    return t.news.withColumns(labels.label_counts(labels.normalise_label(C("Sentiment"))))


@query(
    "b17_arithmetic_columns",
    "TICKER:s date:d spread:f market_cap:f4 positive_share:f",
    """SELECT TICKER, date, ASKHI - BIDLO AS spread, PRC * SHROUT AS market_cap,
              positive / nullif(total, 0) AS positive_share FROM panel""",
    ["panel"],
)
def _(t):
    return t.prices.select(
        "TICKER", "date", (C("ASKHI") - C("BIDLO")).alias("spread"), (C("PRC") * C("SHROUT")).alias("market_cap"),
        values.share(C("positive"), C("total")).alias("positive_share"),
    )


@query(
    "b18_industry_bucket",
    "industry:i n:i",
    "SELECT SICCD // 10 AS industry, count(*) AS n FROM panel GROUP BY 1",
    ["panel"],
)
def _(t):
    return t.panel.groupBy(values.industry(C("SICCD")).alias("industry")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "b19_keep_first",
    "o_custkey:i o_orderpriority:s o_orderkey:i",
    """SELECT o_custkey, o_orderpriority, o_orderkey FROM orders
       QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey) = 1""",
)
def _(t):
    rows = t["orders"].select("o_custkey", "o_orderpriority", "o_orderkey")
    return frames.keep_first(rows, ["o_custkey"], ["o_orderpriority", "o_orderkey"])


@query(
    "b20_explode_tickers",
    "event_id:i ticker:s",
    """SELECT event_id, unnest(string_split(string_split('NYSE:' || upper(event_type) || ', T' || user_id, ':')[-1], ', '))
       AS ticker FROM events""",
)
def _(t):
    listed = F.concat(F.lit("NYSE:"), F.upper("event_type"), F.lit(", T"), C("user_id").cast("string"))
    return frames.explode_tickers(t["events"].select("event_id", listed.alias("tickers")), "tickers", "ticker")


@query(
    "b21_substring_flags",
    "event_id:i positive:i negative:i neutral:i",
    """SELECT event_id, CASE WHEN contains(lower(Sentiment), 'positive') THEN 1 ELSE 0 END AS positive,
              CASE WHEN contains(lower(Sentiment), 'negative') THEN 1 ELSE 0 END AS negative,
              CASE WHEN contains(lower(Sentiment), 'neutral') THEN 1 ELSE 0 END AS neutral FROM news""",
    ["news"],
)
def _(t):
    return t.news.select(
        "event_id", *[labels.mentions(C("Sentiment"), w).alias(w) for w in ("positive", "negative", "neutral")]
    )


@query("b22_normalise_label", "event_id:i label:s", "SELECT event_id, label FROM labelled", ["labelled"])
def _(t):
    return t.news.select("event_id", labels.normalise_label(C("Sentiment")).alias("label"))


@query(
    "b23_market_session",
    "event_id:i session:s",
    """SELECT event_id, CASE WHEN CAST(ts AS TIME) < TIME '09:30:00' THEN 'pre_market_hours'
              WHEN CAST(ts AS TIME) <= TIME '16:30:00' THEN 'market_hours' ELSE 'post_market_hours' END AS session
       FROM events""",
)
def _(t):
    return t["events"].select("event_id", dates.market_session(C("ts")).alias("session"))


@query(
    "b24_day_type",
    "event_id:i day_type:s",
    "SELECT event_id, CASE WHEN isodow(ts) >= 6 THEN 'Weekend' ELSE 'Weekday' END AS day_type FROM events",
)
def _(t):
    return t["events"].select("event_id", dates.day_type(F.to_date("ts")).alias("day_type"))


@query(
    "b25_date_parts",
    "event_id:i day:d year:i prefix:s",
    "SELECT event_id, CAST(ts AS DATE) AS day, year(ts) AS year, strftime(ts, '%Y') AS prefix FROM events",
)
def _(t):
    text = F.date_format("ts", "yyyyMMdd")
    return t["events"].select(
        "event_id", F.to_date("ts").alias("day"), F.year("ts").alias("year"), F.substring(text, 1, 4).alias("prefix")
    )


@query("b26_shift_days", "event_id:i next_day:d", "SELECT event_id, CAST(ts AS DATE) + 1 AS next_day FROM events")
def _(t):
    return t["events"].select("event_id", F.date_add(F.to_date("ts"), 1).alias("next_day"))


@query(
    "b27_period_start",
    "date:d week:d month:d",
    """SELECT DISTINCT date, date - CAST(dayofweek(date) AS INTEGER) AS week,
              CAST(date_trunc('month', date) AS DATE) AS month FROM (SELECT CAST(l_shipdate AS DATE) AS date FROM lineitem)""",
)
def _(t):
    days = t["lineitem"].select(F.to_date("l_shipdate").alias("date")).distinct()
    return days.select("date", dates.week_start_sunday(C("date")).alias("week"), dates.month_start(C("date")).alias("month"))


@query(
    "b28_period_end",
    "date:d week:d month:d",
    """SELECT DISTINCT date, date + CAST((8 - isodow(date)) % 7 AS INTEGER) AS week, last_day(date) AS month
       FROM (SELECT CAST(l_shipdate AS DATE) AS date FROM lineitem)""",
)
def _(t):
    days = t["lineitem"].select(F.to_date("l_shipdate").alias("date")).distinct()
    return days.select("date", dates.week_end_monday(C("date")).alias("week"), dates.month_end(C("date")).alias("month"))


@query(
    "b29_distinct_values",
    "event_type:s users:i",
    "SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY 1",
)
def _(t):
    return t["events"].groupBy("event_type").agg(F.countDistinct("user_id").alias("users"))


@query(
    "b30_last_true_category",
    "event_id:i category:s",
    """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'neutral' WHEN negative = 1 THEN 'negative'
              WHEN positive = 1 THEN 'positive' ELSE '' END AS category FROM labelled""",
    ["labelled"],
)
def _(t):
    flagged = t.news.withColumns(labels.label_counts(labels.normalise_label(C("Sentiment"))))
    neutral = (C("event_id") % 5 == 0).cast("int")
    category = labels.last_true([(C("positive"), "positive"), (C("negative"), "negative"), (neutral, "neutral")])
    return flagged.select("event_id", category.alias("category"))


@query(
    "b31_year_shift",
    "TICKER:s year:i n:i",
    "SELECT TICKER, YEAR - 1 AS year, count(*) AS n FROM pay GROUP BY 1, 2",
    ["pay"],
)
def _(t):
    counts = development_counts(t.pay, ["TICKER", "YEAR"])
    return counts.select("TICKER", (C("YEAR") - 1).alias("year"), C("count").alias("n"))


@query(
    "b32_columns_by_type",
    "kind:s total:f2 n:i",
    """SELECT 'numeric' AS kind, sum(CAST(round(c_acctbal * 100) AS BIGINT) + 100 * (c_custkey + c_nationkey)) / 100.0 AS total,
              count(*) AS n FROM customer
       UNION ALL SELECT 'text', sum(length(c_name) + length(c_mktsegment)), count(*) FROM customer""",
)
def _(t):
    customers = t["customer"]
    cents = sum((F.round(C(c) * 100).cast("bigint") for c in frames.numeric_columns(customers)), F.lit(0))
    letters = sum((F.length(c) for c in frames.text_columns(customers)), F.lit(0))
    numeric = customers.agg((F.sum(cents) / 100.0).alias("total"), F.count(F.lit(1)).alias("n"))
    text = customers.agg(F.sum(letters).cast("double").alias("total"), F.count(F.lit(1)).alias("n"))
    return numeric.withColumn("kind", F.lit("numeric")).unionByName(text.withColumn("kind", F.lit("text")))


@query(
    "b33_wide_to_long",
    "TICKER:s YEAR:i MODEL:s EXP:f4",
    """SELECT TICKER, YEAR, MODEL, EXP FROM (
         UNPIVOT (SELECT TICKER, YEAR, avg(SALARY) AS "LR", max(SALARY) AS "RF", min(SALARY) AS "XGB" FROM pay GROUP BY 1, 2)
         ON "LR", "RF", "XGB" INTO NAME MODEL VALUE EXP)""",
    ["pay"],
)
def _(t):
    wide = t.pay.groupBy("TICKER", "YEAR").agg(
        F.avg("SALARY").alias("LR"), F.max("SALARY").alias("RF"), F.min("SALARY").alias("XGB")
    )
    return frames.to_long(wide, ["TICKER", "YEAR"], ["LR", "RF", "XGB"], "MODEL", "EXP")


@query(
    "g01_stack_tables",
    "id:i name:s nation:i",
    """SELECT s_suppkey AS id, s_name AS name, s_nationkey AS nation FROM supplier
       UNION ALL SELECT c_custkey, c_name, c_nationkey FROM customer
       UNION ALL SELECT p_partkey, p_name, NULL FROM part""",
)
def _(t):
    return frames.stack_tables(
        [
            t["supplier"].select(C("s_suppkey").alias("id"), C("s_name").alias("name"), C("s_nationkey").alias("nation")),
            t["customer"].select(C("c_nationkey").alias("nation"), C("c_custkey").alias("id"), C("c_name").alias("name")),
            t["part"].select(C("p_partkey").alias("id"), C("p_name").alias("name")),
        ]
    )


@query(
    "g02_distinct_rows",
    "o_custkey:i o_orderpriority:s o_orderstatus:s",
    "SELECT DISTINCT o_custkey, o_orderpriority, o_orderstatus FROM orders",
)
def _(t):
    return t["orders"].select("o_custkey", "o_orderpriority", "o_orderstatus").dropDuplicates()
