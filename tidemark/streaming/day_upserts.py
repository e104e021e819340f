"""News counts per ticker and day that late headlines may still correct.

Each (ticker, day) keeps its counts and the ids it has counted as state that expires when nothing has come for a while; the tickers of a
day are dealt to buckets, each one value of the store. Every batch hands on the days it touched, whole; a reader takes the latest version of each day. A headline that comes days late thus corrects
its day, which a watermark would not allow, and the state stays as small as the days that are still open.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.functions.labels import label_counts, normalise_label
from tidemark.streaming.news_counts import utc_day

# the processor runs on executors, where the package need not be installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

COUNTS = ("positive", "negative", "total")
#: How long a day is kept open after its last headline.
OPEN_FOR_MS = 14 * 24 * 3600 * 1000
#: Buckets the tickers of a day are dealt to, and ids of a ticker and day kept with its counts.
BUCKETS = 512
INLINE_IDS = 1_000
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class DayCounts(StatefulProcessor):
    """Counts of the tickers of one day and bucket; an id counts once per ticker.

    Each call of the state store is a round trip to the JVM, far dearer than a row, so all tickers of a bucket are one value, read and
    written once a batch: parallel lists of the tickers, when each last changed, their counts, how many ids each has, and these ids one
    after another. Only a ticker with more than `inline_ids` ids on a day keeps the others one by one.
    """

    def __init__(self, open_for_ms: int = OPEN_FOR_MS, inline_ids: int = INLINE_IDS) -> None:
        self.open_for_ms, self.inline_ids = open_for_ms, inline_ids

    def init(self, handle: StatefulProcessorHandle) -> None:
        counts = ", ".join(f"{c} array<bigint>" for c in COUNTS)
        self.bucket = handle.getValueState("bucket", f"tickers array<string>, changed array<bigint>, {counts}, sizes array<bigint>, ids array<bigint>", self.open_for_ms)
        self.seen = handle.getMapState("seen", "TICKER string, id bigint", "there boolean", self.open_for_ms)

    def _open_days(self, now: int) -> dict:
        """Of each ticker: when it changed, its counts and ids; without those that nothing has come for."""
        before = self.bucket.get()
        if before is None:
            return {}
        tickers, changed, *counts, sizes, ids = before
        days, at = {}, 0
        for ticker, moment, size, *sums in zip(tickers, changed, sizes, *counts):
            if now - moment <= self.open_for_ms:
                days[ticker] = [moment, sums, dict.fromkeys(ids[at : at + size])]
            at += size
        return days

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        now = timerValues.getCurrentProcessingTimeInMs()
        days, fresh = self._open_days(now), {}
        for row in rows:
            _, _, ticker, ident, *flags = row
            day = days.get(ticker)
            if ident is not None and day is not None:  # a headline without an id cannot be told from others and counts each time
                if ident in day[2] or (len(day[2]) >= self.inline_ids and self.seen.containsKey((ticker, ident))):
                    continue
            if day is None:
                day = days[ticker] = [now, [0] * len(COUNTS), {}]
            if ident is not None:
                if len(day[2]) < self.inline_ids:
                    day[2][ident] = None
                else:
                    self.seen.updateValue((ticker, ident), (True,))
            day[0], day[1] = now, [a + b for a, b in zip(day[1], flags)]
            fresh[ticker] = day
        if fresh:
            moments, sums, ids = zip(*days.values())
            self.bucket.update((list(days), list(moments), *map(list, zip(*sums)), [len(i) for i in ids], [i for some in ids for i in some]))
        for ticker, (_, counts, _) in fresh.items():
            yield Row(TICKER=ticker, enterdate=key[0], **dict(zip(COUNTS, counts)))

    def close(self) -> None:
        pass


@contextmanager
def _settings(spark: SparkSession) -> Iterator[None]:
    """Keyed state needs the store that can expire it, and expiry alone is no reason for a batch, or a run over what has landed would
    never end. The session's own settings come back afterwards."""
    wanted = {STORE: ROCKS, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    before = {name: spark.conf.get(name) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def day_versions(feed: DataFrame, time: str, key: str, ident: str, label: str, open_for_ms: int = OPEN_FOR_MS, inline_ids: int = INLINE_IDS) -> DataFrame:
    """A stream of whole days: a row for every (ticker, day) that a batch changes."""
    flagged = feed.withColumns(label_counts(normalise_label(F.col(label)))).select(
        utc_day(time).alias("enterdate"), F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(BUCKETS)).cast("int").alias("bucket"),
        F.col(key).cast("string").alias("TICKER"), F.col(ident).cast("bigint").alias("ident"), *[F.col(c).cast("bigint").alias(c) for c in COUNTS],
    )
    schema = "TICKER string, enterdate date, " + ", ".join(f"{c} bigint" for c in COUNTS)
    return flagged.groupBy("enterdate", "bucket").transformWithState(
        DayCounts(open_for_ms, inline_ids), schema, outputMode="Update", timeMode="ProcessingTime"
    )


def run_upserts(versions: DataFrame, out: str, checkpoint: str) -> None:
    """Process what has landed. A batch's days go to a folder of their own, so a batch that runs twice replaces itself."""

    def write(days: DataFrame, batch: int) -> None:
        days.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    with _settings(versions.sparkSession):
        versions.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def latest_days(spark: SparkSession, out: str) -> DataFrame:
    """The latest version of every day."""
    schema = "TICKER string, enterdate date, " + ", ".join(f"{c} bigint" for c in COUNTS) + ", batch int"
    whole = F.max_by(F.struct(*COUNTS), "batch").alias("row")
    return spark.read.schema(schema).parquet(out).groupBy("enterdate", "TICKER").agg(whole).select("enterdate", "TICKER", "row.*")
