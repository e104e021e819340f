"""A: sources, sinks and profiling. Files are landed from the given tables, then read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators.frames import preview, profile, slice_columns
from tidemark.plans.registry import query
from tidemark.session import scratch_path
from tidemark.sources import files

ORDERS = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderpriority string"
ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
ORDER_KINDS = "o_orderkey:i o_custkey:i o_orderstatus:s o_totalprice:f2 o_orderpriority:s"


@query("a01_csv_scan", ORDER_KINDS, f"SELECT {', '.join(ORDER_COLUMNS)} FROM orders")
def _(t):
    path = scratch_path(t.spark, "orders_csv")
    files.write_table(t["orders"].select(*ORDER_COLUMNS), path, "csv")
    return files.read_csv(t.spark, path, ORDERS)


@query(
    "a02_sharded_scan",
    "o_orderstatus:s n:i cents:i",
    """SELECT o_orderstatus, count(*) AS n, sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS cents
       FROM orders GROUP BY 1""",
)
def _(t):
    folder = scratch_path(t.spark, "order_shards")
    shard = F.pmod(F.xxhash64("o_orderkey"), F.lit(10))
    files.write_table(t["orders"].select(*ORDER_COLUMNS, shard.alias("shard")), folder, "csv", ["shard"])
    return (
        files.read_shards(t.spark, folder, "*.csv", ORDERS)
        .groupBy("o_orderstatus")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("cents"))
    )


@query(
    "a03_optional_files",
    "TICKER:s year:i count:i",
    """SELECT CAST(c_nationkey AS VARCHAR) AS TICKER, year(o_orderdate) AS year, count(*) AS count
       FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2""",
)
def _(t):
    """One landed file set per nation; 26 are asked for, the missing one is passed over."""
    folder = scratch_path(t.spark, "nation_reports")
    counts = t.pay.groupBy("TICKER", F.col("YEAR").alias("year")).agg(F.count(F.lit(1)).alias("count"))
    named = counts.withColumn("company", F.concat(F.lit("c"), F.col("TICKER")))
    files.write_table(named.repartition("company"), folder, "csv", ["company"])
    wanted = [f"{folder}/company=c{i}" for i in range(26)]
    return files.read_listed(t.spark, wanted, "TICKER string, year int, count bigint")


@query(
    "a04_partitioned_sink",
    "universe:s freq:s TICKER:s date:d RET:f total:i",
    """SELECT 'dowjones' AS universe, 'daily' AS freq, TICKER, date, RET, total FROM panel""",
    ["panel"],
)
def _(t):
    path = scratch_path(t.spark, "features")
    table = t.prices.select(
        F.lit("dowjones").alias("universe"), F.lit("daily").alias("freq"), "TICKER", "date", "RET", "total"
    )
    files.write_table(table, path, "parquet", ["universe", "freq"])
    return t.spark.read.schema(table.schema).parquet(path).filter(
        (F.col("universe") == "dowjones") & (F.col("freq") == "daily")
    )


@query(
    "a05_equal_shards",
    "doc_id:i shard:i",
    """SELECT doc_id, least(floor(i / length), 49) + 1 AS shard FROM (
         SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, floor(count(*) OVER () / 50) AS length
         FROM documents)""",
)
def _(t):
    return files.with_shard(t["documents"].select("doc_id"), "doc_id", 50)


@query(
    "a06_paged_json",
    "page:i id:i kind:s k:i",
    """SELECT event_id // 500 AS page, event_id AS id, event_type AS kind,
              CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""",
)
def _(t):
    records = files.read_pages(t.spark, _landed_pages(t), RECORD, one_page_per_file=False)
    return records.select("page", "id", "kind", F.from_json("props", "k bigint").k.alias("k"))


RECORD = "id bigint, kind string, props string"


def _landed_pages(t) -> str:
    """Pages of at most 500 records each, as the feed delivers them."""
    path = scratch_path(t.spark, "pages_json")
    record = F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), "props")
    pages = (
        t["events"].groupBy(F.floor(F.col("event_id") / 500).alias("page"))
        .agg(F.collect_list(record).alias("content"))
    )
    files.write_table(pages, path, "json")
    return path


@query(
    "a06_paged_stream",
    "page:i id:i kind:s k:i",
    """SELECT event_id // 500 AS page, event_id AS id, event_type AS kind,
              CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""",
)
def _(t):
    """The same pages, read as a stream that notes what it has read."""
    records = files.stream_pages(t.spark, _landed_pages(t), RECORD, files_at_once=4)
    landed = files.land_pages(records, scratch_path(t.spark, "pages"), scratch_path(t.spark, "pages_state"))
    return landed.select("page", "id", "kind", F.from_json("props", "k bigint").k.alias("k"))


@query(
    "a07_column_profile",
    "column:s non_null:i rows:i",
    """SELECT u."column", u.non_null, u.rows FROM (
         SELECT unnest([{'column': 'TICKER', 'non_null': count(TICKER), 'rows': count(*)},
                        {'column': 'date', 'non_null': count(date), 'rows': count(*)},
                        {'column': 'RET', 'non_null': count(RET), 'rows': count(*)},
                        {'column': 'tomorrow_return', 'non_null': count(tomorrow_return), 'rows': count(*)},
                        {'column': '30_day_ma', 'non_null': count("30_day_ma"), 'rows': count(*)}]) AS u
         FROM features)""",
    ["features"],
)
def _(t):
    return profile(t.features().select("TICKER", "date", "RET", "tomorrow_return", "30_day_ma"))


@query(
    "a08_preview",
    "TICKER:s date:d PRC:f RET:f",
    "SELECT TICKER, date, PRC, RET FROM panel ORDER BY date, TICKER LIMIT 20",
    ["panel"],
)
def _(t):
    return preview(t.prices, [F.col("date"), F.col("TICKER")], 20)


@query("a09_positional_slice", "s_name:s s_nationkey:i", "SELECT s_name, s_nationkey FROM supplier")
def _(t):
    return slice_columns(t["supplier"], 1, 3)
