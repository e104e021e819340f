"""C: joins, and D03/D04/D20 which build the panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import dates, labels
from tidemark.operators import aggregates, annual, joins
from tidemark.plans.registry import query

C = F.col


def labelled(t):
    return t.news.withColumns(labels.label_counts(labels.normalise_label(C("Sentiment"))))


@query(
    "c01_articles_with_prices",
    "event_id:i TICKER:s enterdate:d day_type:s PRC:f RET:f",
    """SELECT event_id, n.TICKER, enterdate, CASE WHEN isodow(enterdate) >= 6 THEN 'Weekend' ELSE 'Weekday' END AS day_type,
              PRC, RET
       FROM labelled n LEFT JOIN event_prices p ON n.TICKER = p.TICKER AND n.enterdate + 1 = p.date
       WHERE label IS NOT NULL""",
    ["labelled", "event_prices"],
)
def _(t):
    """Prices stand a day earlier than their events, so that tickers idle on the next day have none."""
    news = labelled(t).filter(C("total") == 1).select("event_id", "TICKER", "enterdate")
    prices = t.event_prices.withColumn("date", F.date_add("date", -1))
    return joins.articles_with_prices(news, prices).withColumn("day_type", dates.day_type(C("enterdate")))


@query(
    "c02_inner_on_ticker_year",
    "TICKER:s YEAR:i n:i total:f2",
    """SELECT * FROM (SELECT TICKER, YEAR, count(*) AS n FROM pay GROUP BY 1, 2)
       JOIN (SELECT CAST(s_nationkey AS VARCHAR) AS TICKER, 1995 + CAST(s_suppkey % 5 AS INT) AS YEAR,
                    sum(CAST(round(s_acctbal * 100) AS BIGINT)) / 100.0 AS total FROM supplier GROUP BY 1, 2)
       USING (TICKER, YEAR)""",
    ["pay"],
)
def _(t):
    left = annual.development_counts(t.pay, ["TICKER", "YEAR"]).withColumnRenamed("count", "n")
    right = (
        t["supplier"]
        .groupBy(C("s_nationkey").cast("string").alias("TICKER"), (C("s_suppkey") % 5 + 1995).cast("int").alias("YEAR"))
        .agg((F.sum(F.round(C("s_acctbal") * 100).cast("bigint")) / 100.0).alias("total"))
    )
    return left.join(right, ["TICKER", "YEAR"])


@query(
    "c03_factor_join",
    "TICKER:s YEAR:i SALARY_SALARY_mean:f4 SALARY_SALARY_std:f4 BONUS_BONUS_mean:f4 ART_COUNT:i CULT_EMPH:i",
    """SELECT p.TICKER, p.YEAR, p.sm AS "SALARY_SALARY_mean", p.sd AS "SALARY_SALARY_std", p.bm AS "BONUS_BONUS_mean",
              d.n AS "ART_COUNT", c.n AS "CULT_EMPH"
       FROM (SELECT upper(n_name) AS TICKER, YEAR, avg(SALARY) AS sm, stddev_samp(SALARY) AS sd, avg(BONUS) AS bm
             FROM pay JOIN nation ON CAST(n_nationkey AS VARCHAR) = TICKER GROUP BY 1, 2) p
       JOIN (SELECT 'NATION_' || s_nationkey AS TICKER, year(l_shipdate) AS YEAR, count(*) AS n
             FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2) d ON p.TICKER = d.TICKER AND p.YEAR = d.YEAR
       JOIN (SELECT 'NATION_' || c_nationkey AS TICKER, year(o_orderdate) AS YEAR, count(*) AS n
             FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2) c
         ON p.TICKER = c.TICKER AND p.YEAR = c.YEAR""",
    ["pay"],
)
def _(t):
    """Pay by nation and year, shipments as developments, orders as filing counts."""
    names = {f"Nation {i}": f"NATION_{i}" for i in range(25)}
    pay = annual.pay_summary(t.pay.withColumn("TICKER", F.concat(F.lit("NATION_"), "TICKER")), ["SALARY", "BONUS"])
    developments = annual.development_counts(
        t["lineitem"].join(t["supplier"], C("l_suppkey") == C("s_suppkey")).select(
            F.concat(F.lit("Nation "), C("s_nationkey").cast("string")).alias("companyname"),
            F.year("l_shipdate").alias("year"),
        ),
        ["companyname", "year"],
    )
    culture = (
        t["orders"]
        .join(t["customer"], C("o_custkey") == C("c_custkey"))
        .groupBy(F.concat(F.lit("nation_"), C("c_nationkey").cast("string")).alias("ticker"), F.year("o_orderdate").alias("year"))
        .agg(F.count(F.lit(1)).alias("culture_emphasis"))
    )
    return annual.factor_table(pay, developments, culture, names)


@query(
    "c04_semi_join",
    "TICKER:s n:i",
    """SELECT TICKER, count(*) AS n FROM event_prices
       WHERE TICKER IN (SELECT TICKER FROM labelled WHERE positive = 1) GROUP BY TICKER""",
    ["labelled", "event_prices"],
)
def _(t):
    kept = joins.restrict_to(t.event_prices, labelled(t).filter(C("positive") == 1), ["TICKER"])
    return kept.groupBy("TICKER").agg(F.count(F.lit(1)).alias("n"))


@query(
    "c05_panel_build",
    "TICKER:s date:d PRC:f RET:f positive:i negative:i total:i",
    """SELECT p.TICKER, p.date, PRC, RET, coalesce(positive, 0) AS positive, coalesce(negative, 0) AS negative,
              coalesce(total, 0) AS total
       FROM event_prices p
       LEFT JOIN (SELECT enterdate, TICKER, sum(positive) AS positive, sum(negative) AS negative, sum(total) AS total
                  FROM labelled WHERE label IS NOT NULL GROUP BY 1, 2) c ON p.TICKER = c.TICKER AND p.date = c.enterdate
       WHERE p.TICKER IN (SELECT TICKER FROM labelled WHERE label IS NOT NULL)""",
    ["labelled", "event_prices"],
)
def _(t):
    counts = aggregates.news_counts(labelled(t).filter(C("total") == 1))
    return joins.build_panel(t.event_prices, counts)


@query(
    "c06_next_day_join",
    "TICKER:s date:d yesterday_positive:i yesterday_negative:i RET:f",
    """SELECT n.TICKER, CAST(n.enterdate + 1 AS DATE) AS date, positive AS yesterday_positive,
              negative AS yesterday_negative, RET
       FROM labelled n JOIN event_prices p ON p.date = n.enterdate + 1 AND p.TICKER = n.TICKER
         AND p.SICCD = CAST(n.TICKER AS BIGINT) % 7""",
    ["labelled", "event_prices"],
)
def _(t):
    news = labelled(t).select(
        C("enterdate").alias("date"), "TICKER", (C("TICKER").cast("bigint") % 7).alias("SICCD"), "positive", "negative"
    )
    return joins.next_day_returns(news, t.event_prices, ["positive", "negative"], ["TICKER", "SICCD"])


@query(
    "c07_positional_join",
    "s_suppkey:i c_custkey:i",
    """SELECT s_suppkey, c_custkey FROM (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey DESC) AS i FROM supplier)
       JOIN (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS i FROM customer) USING (i)""",
)
def _(t):
    left = t["supplier"].select("s_suppkey", (-C("s_suppkey")).alias("_back"))
    return joins.join_by_position(left, t["customer"].select("c_custkey"), ["_back"], ["c_custkey"])


@query(
    "c08_id_lookup",
    "l_orderkey:i l_linenumber:i TICKER:s",
    """SELECT l_orderkey, l_linenumber, TICKER FROM lineitem
       JOIN (SELECT o_custkey AS gvkey, min(o_orderpriority) AS TICKER FROM orders GROUP BY 1)
         ON gvkey = CAST(l_suppkey % 7 * l_suppkey AS BIGINT)""",
)
def _(t):
    """Line items as headlines; a seventh of the suppliers share company code 0."""
    headlines = t["lineitem"].select("l_orderkey", "l_linenumber", (C("l_suppkey") % 7 * C("l_suppkey")).alias("gvkey"))
    codes = t["orders"].select(C("o_custkey").alias("gvkey"), C("o_orderpriority").alias("TICKER"))
    return joins.attach_tickers(headlines, codes)


@query(
    "c10_complement",
    "doc_id:i lang:s",
    "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
)
def _(t):
    return joins.complement(t["documents"].select("doc_id", "lang"), t["labels"], ["doc_id"])


@query(
    "d03_daily_news_counts",
    "enterdate:d TICKER:s positive:i negative:i total:i",
    """SELECT enterdate, TICKER, sum(positive) AS positive, sum(negative) AS negative, sum(total) AS total
       FROM labelled GROUP BY 1, 2""",
    ["labelled"],
)
def _(t):
    return aggregates.news_counts(labelled(t))


@query(
    "d04_frequency_table",
    "total:i frequency:i",
    """SELECT total, count(*) AS frequency FROM (
         SELECT enterdate, TICKER, sum(total) AS total FROM labelled GROUP BY 1, 2) GROUP BY 1""",
    ["labelled"],
)
def _(t):
    return aggregates.frequency(aggregates.news_counts(labelled(t)), "total").orderBy("total")


@query(
    "d05_category_shares",
    "event_type:s frequency:i share:f",
    "SELECT event_type, count(*) AS frequency, count(*) / sum(count(*)) OVER () AS share FROM events GROUP BY 1",
)
def _(t):
    return aggregates.shares(t["events"], "event_type")


PAY_KINDS = {m: "f" if m in ("ISR", "TENURE", "PAGE", "SAL_PCT", "TDC1_PCT") else "f4" for m in annual.PAY_MEASURES}


@query(
    "d06_executive_aggregates",
    "TICKER:s YEAR:i " + " ".join(f"{m}_{m}_{s}:{k}" for m, k in PAY_KINDS.items() for s in ("mean", "std")),
    f"""WITH runs AS (SELECT TICKER, EXEC_FULLNAME, YEAR, YEAR - row_number() OVER (
                       PARTITION BY TICKER, EXEC_FULLNAME ORDER BY YEAR) AS run
                     FROM (SELECT DISTINCT TICKER, EXEC_FULLNAME, YEAR FROM pay)),
            ten AS (SELECT *, row_number() OVER (PARTITION BY TICKER, EXEC_FULLNAME, run ORDER BY YEAR) AS TENURE FROM runs),
            every AS (SELECT *, SALARY / TDC1 AS ISR, 30 + EXEC_FULLNAME % 41 AS PAGE, (o_orderkey % 81 - 40) / 2.0 AS SAL_PCT,
                             (o_orderkey % 49 - 20) / 4.0 AS TDC1_PCT
                      FROM pay JOIN ten USING (TICKER, EXEC_FULLNAME, YEAR))
       SELECT TICKER, YEAR, {", ".join(f'avg({m}) AS "{m}_{m}_mean", stddev_samp({m}) AS "{m}_{m}_std"' for m in PAY_KINDS)}
       FROM every GROUP BY 1, 2""",
    ["pay"],
)
def _(t):
    """All eight pay measures; age and yearly changes are drawn from the keys."""
    pay = annual.with_tenure(annual.with_salary_share(t.pay)).withColumns(
        {
            "PAGE": C("EXEC_FULLNAME") % 41 + 30,
            "SAL_PCT": (C("o_orderkey") % 81 - 40) / 2.0,
            "TDC1_PCT": (C("o_orderkey") % 49 - 20) / 4.0,
        }
    )
    return annual.pay_summary(pay, annual.PAY_MEASURES)


@query(
    "d20_top_by_market_cap",
    "TICKER:s n:i news:i",
    """SELECT TICKER, count(*) AS n, sum(total) AS news FROM panel WHERE TICKER IN (
         SELECT TICKER FROM panel GROUP BY 1 ORDER BY avg(market_cap) DESC, TICKER LIMIT 25) GROUP BY TICKER""",
    ["panel"],
)
def _(t):
    kept = aggregates.largest_companies(t.prices, 25)
    return kept.groupBy("TICKER").agg(F.count(F.lit(1)).alias("n"), F.sum("total").alias("news"))


@query(
    "f01_sort",
    "TICKER:s date:d RET:f",
    "SELECT TICKER, date, RET FROM panel",
    ["panel"],
)
def _(t):
    return t.prices.select("TICKER", "date", "RET").orderBy(C("date").asc(), C("RET").desc())


@query(
    "f02_largest_groups",
    "TICKER:s measure:f4",
    "SELECT TICKER, avg(market_cap) AS measure FROM panel GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    ["panel"],
)
def _(t):
    return aggregates.top_groups(t.prices, "TICKER", F.avg("market_cap"), 10)


@query(
    "f03_last_value",
    "TICKER:s last_price:f last_date:d",
    "SELECT TICKER, arg_max(PRC, date) AS last_price, max(date) AS last_date FROM panel GROUP BY 1",
    ["panel"],
)
def _(t):
    return t.prices.groupBy("TICKER").agg(F.max_by("PRC", "date").alias("last_price"), F.max("date").alias("last_date"))


