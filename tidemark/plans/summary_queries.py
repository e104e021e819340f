"""D: summaries, resampling and distributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import config
from tidemark.functions import labels, values
from tidemark.operators import aggregates, order, resample, windows
from tidemark.plans import study
from tidemark.plans.registry import query
from tidemark.session import materialise
from tidemark.sources.testdata import NUMERIC

C = F.col


def industry():
    return values.industry(C("SICCD"))



def sas_rank(value: str, groups: int, source: str) -> str:
    """Rank groups with mean ranks on ties, as SQL."""
    return f"""SELECT *, CAST(floor((rank() OVER (ORDER BY {value}) + (count(*) OVER (PARTITION BY {value}) - 1) / 2.0)
                 * {groups} / (count(*) OVER () + 1)) AS INT) AS grp FROM {source}"""


def edges_sql(value: str, bins: int, source: str) -> str:
    """Quantile bins from interpolated edges, as SQL."""
    cuts = ", ".join(f"quantile_cont({value}, {i / bins!r}) AS e{i}" for i in range(bins + 1))
    rank = " + ".join(f"CAST({value} > e{i} AS INT)" for i in range(1, bins))
    return f"SELECT *, {rank} AS bin FROM {source} CROSS JOIN (SELECT {cuts} FROM {source})"


NEWS_SQL = "sum(positive) AS total_positive, sum(negative) AS total_negative, sum(total) AS total"
SHARE_SQL = "sum(positive) / nullif(sum(total), 0) AS positive_perc, sum(negative) / nullif(sum(total), 0) AS negative_perc"
NEWS_KINDS = "total_positive:i total_negative:i total:i"
SHARE_KINDS = "positive_perc:f9 negative_perc:f9"


def stored(df, *extra):
    """Write the columns a ranked summary needs once, as the ranking reads its input several times."""
    return materialise(df.select("TICKER", "date", "RET", *aggregates.NEWS, *extra))


def lagged(t, source: str = "panel"):
    return windows.with_lagged_return(getattr(t, source))


def lagged_periods(t, freq):
    return windows.with_lagged_return(resample.rollup(t.panel, freq), "sum_RET", "start")


@query(
    "d01_daily_market_summary",
    "date:d sprtrn:f9 sum_positive:i sum_negative:i sum_total:i",
    """SELECT date, sprtrn, sum(positive) AS sum_positive, sum(negative) AS sum_negative, sum(total) AS sum_total
       FROM panel GROUP BY 1, 2""",
    ["panel"],
)
def _(t):
    return aggregates.market_summary(t.panel)


@query(
    "d02_daily_summary_news_only",
    "date:d sprtrn:f9 sum_positive:i sum_negative:i sum_total:i",
    """SELECT date, sprtrn, sum(positive) AS sum_positive, sum(negative) AS sum_negative, sum(total) AS sum_total
       FROM lagged WHERE total > 0 GROUP BY 1, 2""",
    ["lagged"],
)
def _(t):
    return aggregates.market_summary(aggregates.with_news(lagged(t)))


@query(
    "d07_industry_summary",
    f"industry:i num_firms:i cum_ret:f {NEWS_KINDS} {SHARE_KINDS}",
    f"""SELECT SICCD // 10 AS industry, count(DISTINCT TICKER) AS num_firms, sum(RET) AS cum_ret, {NEWS_SQL}, {SHARE_SQL}
        FROM panel GROUP BY 1 HAVING count(DISTINCT TICKER) > 2""",
    ["panel"],
)
def _(t):
    return aggregates.industry_summary(t.panel, industry(), 2).orderBy(F.desc("cum_ret"))


@query(
    "d08_industry_per_company",
    f"industry:i num_firms:i cum_ret:f {NEWS_KINDS} {SHARE_KINDS} tot_per_comp:f pos_per_comp:f neg_per_comp:f",
    f"""SELECT SICCD // 10 AS industry, count(DISTINCT TICKER) AS num_firms, sum(RET) AS cum_ret, {NEWS_SQL}, {SHARE_SQL},
               sum(total) / count(DISTINCT TICKER) AS tot_per_comp, sum(positive) / count(DISTINCT TICKER) AS pos_per_comp,
               sum(negative) / count(DISTINCT TICKER) AS neg_per_comp
        FROM lagged WHERE total > 0 GROUP BY 1""",
    ["lagged"],
)
def _(t):
    return aggregates.per_company(aggregates.industry_summary(aggregates.with_news(lagged(t)), industry()))


@query(
    "d09_size_summary_quantile",
    f"comp_size:i sum_ret:f {NEWS_KINDS} {SHARE_KINDS}",
    f"SELECT bin AS comp_size, sum(RET) AS sum_ret, {NEWS_SQL}, {SHARE_SQL} FROM ({edges_sql('market_cap', 10, 'panel')}) GROUP BY 1",
    ["panel"],
)
def _(t):
    return aggregates.size_summary(order.quantile_bins(stored(t.prices, "market_cap"), "market_cap", 10, "comp_size"), "comp_size")


@query(
    "d09_size_summary_rank_news_only",
    f"size_group:s sum_ret:f {NEWS_KINDS} {SHARE_KINDS}",
    f"""SELECT CASE WHEN grp > 20 THEN 'Top 10' ELSE '11-30' END AS size_group, sum(RET) AS sum_ret, {NEWS_SQL}, {SHARE_SQL}
        FROM ({sas_rank('market_cap', 30, 'lagged')}) WHERE total > 0 GROUP BY 1""",
    ["lagged"],
)
def _(t):
    groups = config.SIZE_GROUPS["dowjones", "daily"]
    ranked = order.rank_groups(stored(lagged(t, "prices"), "market_cap"), "market_cap", groups, "comp_size")
    named = ranked.withColumn("size_group", values.band_label((C("comp_size") > 20).cast("int"), ("11-30", "Top 10")))
    return aggregates.size_summary(aggregates.with_news(named), "size_group")


DECILE_CASE = "CASE grp " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(config.DECILE_LABELS)) + " END"


@query(
    "d10_market_decile_summary",
    f"percentile_range:s avg_sprtn:f9 {NEWS_KINDS}",
    f"""SELECT {DECILE_CASE} AS percentile_range, avg(sprtrn) AS avg_sprtn, {NEWS_SQL} FROM ({sas_rank('sprtrn', 10, '''(
          SELECT date, sprtrn, sum(positive) AS positive, sum(negative) AS negative, sum(total) AS total
          FROM lagged WHERE total > 0 GROUP BY 1, 2)''')}) GROUP BY 1""",
    ["lagged"],
)
def _(t):
    daily = aggregates.market_summary(aggregates.with_news(lagged(t)))
    ranked = order.rank_groups(materialise(daily), "sprtrn", 10, "rank").withColumn(
        "percentile_range", values.band_label(C("rank"), config.DECILE_LABELS)
    )
    return aggregates.market_band_summary(ranked, "percentile_range")


@query(
    "d10_market_quantile_summary",
    f"percentile_range:s avg_sprtn:f9 {NEWS_KINDS}",
    f"""SELECT '(' || printf('%.6f', round(lo + 1.2345678e-8, 6)) || ', ' || printf('%.6f', round(hi + 1.2345678e-8, 6)) || ']' AS percentile_range,
               avg(sprtrn) AS avg_sprtn, {NEWS_SQL}
        FROM (SELECT *, [e0, e1, e2, e3, e4, e5, e6, e7, e8, e9][bin + 1] AS lo,
                     [e1, e2, e3, e4, e5, e6, e7, e8, e9, e10][bin + 1] AS hi FROM ({edges_sql('sprtrn', 10, '''(
                SELECT date, sprtrn, sum(positive) AS positive, sum(negative) AS negative, sum(total) AS total
                FROM panel GROUP BY 1, 2)''')})) GROUP BY 1""",
    ["panel"],
)
def _(t):
    daily = aggregates.market_summary(t.panel)
    binned = order.quantile_bins(materialise(daily), "sprtrn", 10, "bin", keep_edges=True)
    low, high = (F.round(C(c) + 1.2345678e-8, 6) for c in ("bin_low", "bin_high"))
    return aggregates.market_band_summary(
        binned.withColumn("percentile_range", F.format_string("(%.6f, %.6f]", low, high)), "percentile_range"
    )


def _stock_deciles(t):
    ranked = order.rank_groups(stored(lagged(t, "prices"), "lagged_return"), "RET", 10, "rank")
    return ranked.withColumn("percentile_range", values.band_label(C("rank"), config.DECILE_LABELS))


@query(
    "d11_stock_decile_summary",
    f"percentile_range:s avg_ret:f9 avg_lag_ret:f9 {NEWS_KINDS} {SHARE_KINDS}",
    f"""SELECT {DECILE_CASE} AS percentile_range, avg(RET) AS avg_ret, avg(lagged_return) AS avg_lag_ret, {NEWS_SQL}, {SHARE_SQL}
        FROM ({sas_rank('RET', 10, 'lagged')}) GROUP BY 1""",
    ["lagged"],
)
def _(t):
    return aggregates.stock_band_summary(_stock_deciles(t), "percentile_range")


@query(
    "d11_stock_decile_news_only",
    f"percentile_range:s avg_ret:f9 avg_lag_ret:f9 {NEWS_KINDS} {SHARE_KINDS}",
    f"""SELECT {DECILE_CASE} AS percentile_range, avg(RET) AS avg_ret, avg(lagged_return) AS avg_lag_ret, {NEWS_SQL}, {SHARE_SQL}
        FROM ({sas_rank('RET', 10, 'lagged')}) WHERE total > 0 GROUP BY 1""",
    ["lagged"],
)
def _(t):
    return aggregates.stock_band_summary(aggregates.with_news(_stock_deciles(t)), "percentile_range")


COUNT_KINDS = "news_count:i num_obs:i avg_return:f9 avg_lagged_return:f9 volatility:f9 lag_volatility:f9 sprtrn:f9 sp_vol:f9"


def _count_sql(count: str, source: str, ret: str, market: str, where: str = "") -> str:
    return f"""SELECT {count} AS news_count, count(*) AS num_obs, avg({ret}) AS avg_return,
        avg(lagged_return) AS avg_lagged_return, stddev_samp({ret}) AS volatility,
        stddev_samp(lagged_return) AS lag_volatility, avg({market}) AS sprtrn, stddev_samp({market}) AS sp_vol
        FROM {source} {where} GROUP BY 1"""


for _count in ("total", "positive", "negative"):

    @query(f"d12_by_{_count}_count", COUNT_KINDS, _count_sql(_count, "lagged", "RET", "sprtrn"), ["lagged"])
    def _(t, count=_count):
        return aggregates.by_news_count(lagged(t), count)


@query(
    "d12_by_weekly_total_count",
    COUNT_KINDS,
    _count_sql("sum_total", "lagged_weekly", "sum_RET", "sum_sprtrn", "WHERE sum_total < 21"),
    ["lagged_weekly"],
)
def _(t):
    weekly = lagged_periods(t, "weekly")
    return aggregates.by_news_count(weekly, "sum_total", "sum_RET", "sum_sprtrn", config.NEWS_COUNT_LIMIT)


DESCRIBE = "count:i mean:f9 std:f9 min:f9 q25:f9 q50:f9 q75:f9 max:f9"
DESCRIBE_SQL = """count(RET) AS count, avg(RET) AS mean, stddev_samp(RET) AS std, min(RET) AS min,
    quantile_cont(RET, 0.25) AS q25, quantile_cont(RET, 0.5) AS q50, quantile_cont(RET, 0.75) AS q75, max(RET) AS max"""


@query("d13_describe", DESCRIBE, f"SELECT {DESCRIBE_SQL} FROM panel", ["panel"])
def _(t):
    return aggregates.describe(t.prices, "RET")


@query(
    "d13_describe_by_group",
    f"category:s {DESCRIBE}",
    f"""SELECT category, {DESCRIBE_SQL} FROM (SELECT RET, CASE WHEN negative = 1 THEN 'negative' WHEN positive = 1 THEN 'positive'
          ELSE '' END AS category FROM panel) GROUP BY 1""",
    ["panel"],
)
def _(t):
    category = labels.last_true([(C("positive"), "positive"), (C("negative"), "negative")])
    return aggregates.describe(t.prices.withColumn("category", category), "RET", ["category"])


DESCRIBED = ("PRC", "RET", "VOL", "sprtrn", "tomorrow_return", "10_day_ma")


@query(
    "d13_describe_columns",
    f"column:s {DESCRIBE.replace('f9', 'f4')}",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", {DESCRIBE_SQL.replace('RET', f'CAST("{c}" AS DOUBLE)')} FROM features""" for c in DESCRIBED
    ),
    ["features"],
)
def _(t):
    return aggregates.describe_columns(materialise(t.features().select(*DESCRIBED)), DESCRIBED)


@query(
    "d14_compounded_return",
    "TICKER:s year:i cum_ret:f",
    "SELECT TICKER, year(date) AS year, product(1 + RET) - 1 AS cum_ret FROM panel GROUP BY 1, 2",
    ["panel"],
)
def _(t):
    return t.prices.groupBy("TICKER", F.year("date").alias("year")).agg(aggregates.compounded_return("RET").alias("cum_ret"))


PERIOD_KINDS = (
    "TICKER:s date:d SICCD:i COMNAM:s market_cap:f4 SHROUT:f VOL:f PRC:f4 ASKHI:f BIDLO:f total:i negative:i positive:i "
    "sprtrn:f9 RET:f9"
)


@query("d15_weekly_resample", PERIOD_KINDS, "SELECT * FROM weekly", ["weekly"])
def _(t):
    return resample.resample(t.panel, "weekly")


@query("d16_monthly_resample", PERIOD_KINDS, "SELECT * FROM monthly", ["monthly"])
def _(t):
    return resample.resample(t.panel, "monthly")


ROLLUP_KINDS = (
    "TICKER:s start:d SICCD:i COMNAM:s mean_market_cap:f4 mean_SHROUT:f mean_VOL:f mean_PRC:f4 max_ASKHI:f min_BIDLO:f "
    "sum_total:i sum_negative:i sum_positive:i sum_sprtrn:f9 sum_RET:f9"
)


@query("d17_weekly_rollup", ROLLUP_KINDS, "SELECT * FROM rollup_weekly", ["rollup_weekly"])
def _(t):
    return resample.rollup(t.panel, "weekly")


@query("d17_monthly_rollup", ROLLUP_KINDS, "SELECT * FROM rollup_monthly", ["rollup_monthly"])
def _(t):
    return resample.rollup(t.panel, "monthly")


@query(
    "d18_market_rollup",
    "start:d sum_sprtrn:f9 sum_positive:i sum_negative:i sum_total:i",
    """SELECT start, arg_min(sum_sprtrn, TICKER) AS sum_sprtrn, sum(sum_positive) AS sum_positive,
              sum(sum_negative) AS sum_negative, sum(sum_total) AS sum_total FROM lagged_weekly GROUP BY 1""",
    ["lagged_weekly"],
)
def _(t):
    return resample.market_rollup(lagged_periods(t, "weekly"))


@query(
    "d18_weekly_market_deciles",
    f"percentile_range:s avg_sprtn:f9 {NEWS_KINDS}",
    f"""SELECT {DECILE_CASE} AS percentile_range, avg(sum_sprtrn) AS avg_sprtn, {NEWS_SQL} FROM ({sas_rank('sum_sprtrn', 10, '''(
          SELECT start, arg_min(sum_sprtrn, TICKER) AS sum_sprtrn, sum(sum_positive) AS positive,
              sum(sum_negative) AS negative, sum(sum_total) AS total FROM lagged_weekly GROUP BY 1)''')}) GROUP BY 1""",
    ["lagged_weekly"],
)
def _(t):
    ranked = order.rank_groups(materialise(resample.market_rollup(lagged_periods(t, "weekly"))), "sum_sprtrn", 10, "rank")
    banded = ranked.withColumn("percentile_range", values.band_label(C("rank"), config.DECILE_LABELS))
    return aggregates.market_band_summary(banded, "percentile_range", "sum_sprtrn")


@query(
    "d19_mode_per_date",
    "date:d mode:f9",
    """SELECT date, sprtrn AS mode FROM (SELECT date, sprtrn, count(*) AS n FROM panel GROUP BY 1, 2)
       QUALIFY row_number() OVER (PARTITION BY date ORDER BY n DESC, sprtrn) = 1""",
    ["panel"],
)
def _(t):
    """The raw market return of each date."""
    return aggregates.mode_per_group(t.panel, ["date"], "sprtrn")


DUMMIES = ("dummy_negative", "dummy_positive", "dummy_total")
CONTRAST_SQL = " UNION ALL ".join(
    f"""SELECT '{d}' AS dummy, avg(x) FILTER ({d} = 1) AS mean_with, avg(x) FILTER ({d} = 0) AS mean_without,
        stddev_samp(x) FILTER ({d} = 1) AS volatility_with, stddev_samp(x) FILTER ({d} = 0) AS volatility_without,
        avg(x) FILTER ({d} = 1) - avg(x) FILTER ({d} = 0) AS mean_difference,
        stddev_samp(x) FILTER ({d} = 1) - stddev_samp(x) FILTER ({d} = 0) AS volatility_difference
        FROM (SELECT *, ASKHI - PRC AS x FROM features)"""
    for d in DUMMIES
)
CONTRAST_KINDS = (
    "dummy:s mean_with:f mean_without:f volatility_with:f volatility_without:f mean_difference:f volatility_difference:f"
)


@query("d21_dummy_contrast", CONTRAST_KINDS, CONTRAST_SQL, ["features"])
def _(t):
    return aggregates.dummy_contrast(t.features().withColumn("x", C("ASKHI") - C("PRC")), "x", DUMMIES)


SHAPE_SQL = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column",
        sqrt(n * (n - 1)) / (n - 2) * (m3 / pow(m2, 1.5)) AS skewness,
        (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * (m4 / (m2 * m2) - 3) + 6) AS kurtosis
        FROM (SELECT CAST(count(x) AS DOUBLE) AS n, avg(pow(x - mu, 2)) AS m2, avg(pow(x - mu, 3)) AS m3, avg(pow(x - mu, 4)) AS m4
              FROM (SELECT CAST("{c}" AS DOUBLE) AS x, avg("{c}") OVER () AS mu FROM features))"""
    for c in NUMERIC
)


@query("d22_skew_kurtosis", "column:s skewness:f kurtosis:f", SHAPE_SQL, ["features"])
def _(t):
    return aggregates.shape(t.features(), NUMERIC)


@query(
    "d23_box_stats",
    "dummy_total:i q25:f9 q50:f9 q75:f9 iqr:f9 lower_limit:f9 upper_limit:f9",
    """SELECT *, q75 - q25 AS iqr, q25 - 1.5 * (q75 - q25) AS lower_limit, q75 + 1.5 * (q75 - q25) AS upper_limit FROM (
         SELECT dummy_total, quantile_cont(tomorrow_return, 0.25) AS q25, quantile_cont(tomorrow_return, 0.5) AS q50,
                quantile_cont(tomorrow_return, 0.75) AS q75 FROM features GROUP BY 1)""",
    ["features"],
)
def _(t):
    return aggregates.box_stats(t.features(), "tomorrow_return", ["dummy_total"])


def _histogram_sql(columns, bins: int) -> str:
    parts = [
        f"""SELECT '{c}' AS "column", b.bin, lo + b.bin * ((hi - lo) / {bins}) AS edge, count(x) AS n
            FROM (SELECT min("{c}") AS lo, max("{c}") AS hi FROM features)
            CROSS JOIN (SELECT unnest(range({bins})) AS bin) b
            LEFT JOIN (SELECT "{c}" AS x, least(CAST(floor(("{c}" - l) / (h - l) * {bins}) AS BIGINT), {bins - 1}) AS bin
                       FROM features CROSS JOIN (SELECT min("{c}") AS l, max("{c}") AS h FROM features)) v ON v.bin = b.bin
            GROUP BY ALL"""
        for c in columns
    ]
    return " UNION ALL ".join(parts)


@query("d24_histogram_return", "column:s bin:i edge:f n:i", _histogram_sql(["RET"], 50), ["features"])
def _(t):
    return aggregates.histogram(t.features("daily", "prices"), ["RET"], 50)


@query("d24_histogram_all", "column:s bin:i edge:f n:i", _histogram_sql(NUMERIC, 30), ["features"])
def _(t):
    return aggregates.histogram(t.features(), NUMERIC, 30)


CORRELATED = NUMERIC + ["tomorrow_return", "yesterday_return", "30_day_ma"]
CORRELATION_SQL = "SELECT u.a, u.b, u.correlation FROM (SELECT unnest([" + ", ".join(
    f"""{{'a': '{a}', 'b': '{b}', 'correlation': corr("{a}", "{b}")}}"""
    for i, a in enumerate(CORRELATED) for b in CORRELATED[i + 1:]
) + "]) AS u FROM features WHERE " + " AND ".join(f'"{c}" IS NOT NULL' for c in CORRELATED) + ")"


@query("d25_correlations", "a:s b:s correlation:f", CORRELATION_SQL, ["features"])
def _(t):
    return aggregates.correlations(t.features(), CORRELATED)


@query(
    "d26_sign_confusion",
    "actual:s predicted:s n:i",
    """SELECT CASE WHEN tomorrow_return > 0 THEN 'Positive' ELSE 'Negative' END AS actual,
              CASE WHEN pred_forest > 0 THEN 'Positive' ELSE 'Negative' END AS predicted, count(*) AS n
       FROM scored WHERE tomorrow_return IS NOT NULL AND pred_forest IS NOT NULL GROUP BY 1, 2""",
    ["scored"],
)
def _(t):
    return aggregates.sign_confusion(t.scored, "tomorrow_return", "pred_forest")


@query(
    "d27_quadrants",
    "quadrant:s n:i",
    """SELECT 'Upper Right' AS quadrant, count(*) FILTER (lasso_pred > 0 AND tomorrow_return > 0) AS n FROM scored
       UNION ALL SELECT 'Upper Left', count(*) FILTER (lasso_pred > 0 AND tomorrow_return < 0) FROM scored
       UNION ALL SELECT 'Lower Right', count(*) FILTER (lasso_pred < 0 AND tomorrow_return > 0) FROM scored
       UNION ALL SELECT 'Lower Left', count(*) FILTER (lasso_pred < 0 AND tomorrow_return < 0) FROM scored""",
    ["scored"],
)
def _(t):
    return aggregates.quadrants(t.scored, "tomorrow_return", "lasso_pred")


@query(
    "d28_class_agreement",
    "agreement:s n:i",
    """SELECT CASE WHEN log_pred = 'Positive' AND tomorrow_return > 0 THEN 'Both Positive'
                   WHEN log_pred = 'Negative' AND tomorrow_return < 0 THEN 'Both Negative'
                   WHEN log_pred = 'Positive' AND tomorrow_return < 0 THEN 'One Positive and One Negative'
                   WHEN log_pred = 'Negative' AND tomorrow_return > 0 THEN 'One Negative and One Positive'
                   ELSE 'Other' END AS agreement, count(*) AS n FROM scored GROUP BY 1""",
    ["scored"],
)
def _(t):
    return aggregates.class_agreement(t.scored, "log_pred", "tomorrow_return")


@query(
    "d29_category_counts_by_sign",
    "column:s value:s sign:s n:i",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", CAST({c} AS VARCHAR) AS value,
            CASE WHEN tomorrow_return >= 0 THEN 'positive' ELSE 'negative' END AS sign, count(*) AS n
            FROM scored WHERE tomorrow_return IS NOT NULL AND {c} IS NOT NULL GROUP BY 2, 3"""
        for c in ("TICKER", "SICCD", "proper", "log_pred")
    ),
    ["scored"],
)
def _(t):
    return aggregates.category_counts_by_sign(t.scored, ("TICKER", "SICCD", "proper", "log_pred"), "tomorrow_return")




# ---- the same summaries through the study functions, for periods --------------------------

PERIOD_VIEW = """(SELECT TICKER, start AS date, SICCD, mean_market_cap AS market_cap, sum_RET AS RET, sum_sprtrn AS sprtrn,
    sum_total AS total, sum_positive AS positive, sum_negative AS negative, lagged_return FROM lagged_{freq})"""


def of_study(t, universe: str, freq: str, table: str):
    return study.return_summaries(t.panel, universe, freq)[table]()


@query(
    "d08_industry_weekly_news_only",
    f"industry:i num_firms:i cum_ret:f {NEWS_KINDS} {SHARE_KINDS} tot_per_comp:f pos_per_comp:f neg_per_comp:f",
    f"""SELECT SICCD // 10 AS industry, count(DISTINCT TICKER) AS num_firms, sum(RET) AS cum_ret, {NEWS_SQL}, {SHARE_SQL},
               sum(total) / count(DISTINCT TICKER) AS tot_per_comp, sum(positive) / count(DISTINCT TICKER) AS pos_per_comp,
               sum(negative) / count(DISTINCT TICKER) AS neg_per_comp
        FROM {PERIOD_VIEW.format(freq='weekly')} WHERE total > 0 GROUP BY 1""",
    ["lagged_weekly"],
)
def _(t):
    return of_study(t, "nasdaq", "weekly", "industries_news")


@query(
    "d09_size_summary_weekly",
    f"size_group:s sum_ret:f {NEWS_KINDS} {SHARE_KINDS}",
    f"""SELECT CASE grp WHEN 0 THEN '0-20%' WHEN 1 THEN '20-40%' WHEN 2 THEN '40-60%' WHEN 3 THEN '60-80%' ELSE '80-100%' END
               AS size_group, sum(RET) AS sum_ret, {NEWS_SQL}, {SHARE_SQL}
        FROM ({sas_rank('market_cap', 5, PERIOD_VIEW.format(freq='weekly'))}) GROUP BY 1""",
    ["lagged_weekly"],
)
def _(t):
    return of_study(t, "nasdaq", "weekly", "sizes")


@query(
    "d09_size_summary_daily_ten_groups",
    f"size_group:s sum_ret:f {NEWS_KINDS} {SHARE_KINDS}",
    f"""SELECT CASE grp WHEN 0 THEN 'Smallest' WHEN 9 THEN 'Largest' ELSE (10 * grp) || '-' || (10 * grp + 10) || '%' END
               AS size_group, sum(RET) AS sum_ret, {NEWS_SQL}, {SHARE_SQL}
        FROM ({sas_rank('market_cap', 10, 'lagged')}) GROUP BY 1""",
    ["lagged"],
)
def _(t):
    return of_study(t, "sp500", "daily", "sizes")


for _freq in ("weekly", "monthly"):

    @query(
        f"d11_stock_deciles_{_freq}",
        f"percentile_range:s avg_ret:f9 avg_lag_ret:f9 {NEWS_KINDS} {SHARE_KINDS}",
        f"""SELECT {DECILE_CASE} AS percentile_range, avg(RET) AS avg_ret, avg(lagged_return) AS avg_lag_ret, {NEWS_SQL}, {SHARE_SQL}
            FROM ({sas_rank('RET', 10, PERIOD_VIEW.format(freq=_freq))}) GROUP BY 1""",
        [f"lagged_{_freq}"],
    )
    def _(t, freq=_freq):
        return of_study(t, "dowjones", freq, "stock_deciles")


@query(
    "d12_by_monthly_positive_count",
    COUNT_KINDS,
    _count_sql("positive", PERIOD_VIEW.format(freq="monthly"), "RET", "sprtrn", "WHERE positive < 21"),
    ["lagged_monthly"],
)
def _(t):
    return of_study(t, "sp500", "monthly", "by_positive")


@query(
    "d18_monthly_market_deciles",
    f"percentile_range:s avg_sprtn:f9 {NEWS_KINDS}",
    f"""SELECT {DECILE_CASE} AS percentile_range, avg(sprtrn) AS avg_sprtn, {NEWS_SQL} FROM ({sas_rank('sprtrn', 10, f"""(
          SELECT date, arg_min(sprtrn, TICKER) AS sprtrn, sum(positive) AS positive,
              sum(negative) AS negative, sum(total) AS total FROM {PERIOD_VIEW.format(freq='monthly')} GROUP BY 1)""")}) GROUP BY 1""",
    ["lagged_monthly"],
)
def _(t):
    return of_study(t, "russell", "monthly", "market_deciles")
