"""WARC archives written and read as DataFrames; records are found by verifying chains of boundaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.session import materialise

MAGIC = "WARC/1.0\r\n"
HEADER_END = "\r\n\r\n"
RECORD_END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
#: Records in one archive file.
RECORDS_PER_FILE = 20000


def payload_digest(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a text's UTF-8 bytes: five hex digits make four base32 digits."""
    digits = F.sha1(payload.cast("binary"))
    return F.concat(*[
        F.translate(
            F.lpad(F.conv(F.substring(digits, 1 + 5 * at, 5), 16, 32), 4, "0"),
            "0123456789ABCDEFGHIJKLMNOPQRSTUV",
            "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
        )
        for at in range(8)
    ])


def write_archives(
    pages: DataFrame, folder: str, smallest_revisit: int = 0, date: str = "1970-01-01T00:00:00Z", records_per_file: int = RECORDS_PER_FILE
) -> None:
    """One record per row of `pages` (page_id, url, html) as uncompressed WARC files below `folder`.

    Among rows of equal payload (SHA-1 and length) of at least `smallest_revisit` bytes, those with the
    smallest page_id are responses; the others are revisits without a payload that refer to it. Only payloads that
    occur twice enter the lookup, and Spark sees its size before it chooses a join.

    A null html is an empty payload, a null url leaves the target out, white space in a url is
    percent-encoded. A row without a page_id is a response unless a row with an id has the same payload. An empty table
    writes no record. Other columns are not read.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"),
    )
    rows = rows.withColumn("digest", payload_digest(F.col("payload"))).withColumn("size", F.octet_length("payload"))
    copies = materialise(
        rows.where(F.col("size") >= smallest_revisit)
        .groupBy("digest", "size")
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .where((F.col("n") > 1) & F.col("first").isNotNull())
        .drop("n")
    )
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))

    def header(name: str, value: Column | str) -> Column:
        return F.concat(F.lit(f"{name}: "), F.lit(value) if isinstance(value, str) else value, F.lit("\r\n"))

    target = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A"), " ", "%20")
    record = F.concat(
        F.lit(MAGIC),
        header("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        header("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">"))),
        F.coalesce(header("WARC-Target-URI", target), F.lit("")),
        header("WARC-Date", date),
        header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(
            revisit,
            F.concat(header("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("first").cast("string"), F.lit(">"))), header("WARC-Profile", PROFILE)),
        ).otherwise(F.lit("")),
        header("Content-Type", "text/html; charset=utf-8"),
        F.lit("Content-Length: "),
        F.when(revisit, F.lit("0")).otherwise(F.col("size").cast("string")),
        F.lit(HEADER_END),
        F.when(revisit, F.lit("")).otherwise(F.col("payload")),
    )
    rows.join(copies, ["digest", "size"], "left").select(record.alias("value")).write.option("lineSep", RECORD_END).option(
        "maxRecordsPerFile", records_per_file
    ).text(folder)


def _field(name: str) -> Column:
    found = F.regexp_extract("head", f"(?mi)^{name}:[ \\t]*([^\\r\\n]*)", 1)
    return F.when(found != "", found)


def read_archives(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """The records of all WARC files below `folder`: header fields, payload_bytes, computed digest, and payload on request.

    1. The files are read in splits, cut at every occurrence of the magic line. Lengths, summed within a split and
       over the splits before it, give each piece's offset.
    2. Each piece is a candidate: its offset, and by its header the offset of its successor.
    3. Candidates that follow one another directly form runs. From the file's start the chain is
       followed by pointer jumping over runs, so a file without stray magic needs no round and others
       need the logarithm of their stray places. A magic line inside a payload is never reached.
    4. Pieces of a payload that held the magic line are put together again.

    A scan's result is stored, as offsets hold within one scan only. Without `payloads` it holds no payload text but
    for files with pieces that are no whole record, which are scanned once more.
    A record that runs past the end of its file is left out; so is what follows bytes that no record
    covers. A folder without records gives no rows.
    """
    if payloads:
        return _records(_pieces(spark, folder, True)).select(*_FIELDS, "payload")
    plain = _pieces(spark, folder, False)
    mixed = materialise(plain.where("not whole and bytes > 0").select("file").distinct())
    if mixed.isEmpty():
        return _records(plain).select(*_FIELDS)
    again = _pieces(spark, folder, True, mixed)
    return _records(plain.join(mixed, "file", "left_anti")).select(*_FIELDS).unionByName(_records(again).select(*_FIELDS))


_FIELDS = ("record_type", "page_id", "url", "refers_to", "declared_digest", "payload_bytes", "digest")


def _pieces(spark: SparkSession, folder: str, texts: bool, only: DataFrame | None = None) -> DataFrame:
    """What lies between two magic lines, one row each, with the place in its split and what its header says."""
    scanned = (
        spark.read.option("lineSep", MAGIC).schema("value string").text(folder)
        .select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("seq"))
    )
    if only is not None:
        scanned = scanned.join(only, "file", "left_semi")
    parsed = (
        scanned.withColumn("head", F.substring_index("value", HEADER_END, 1))
        .withColumn("bytes", F.octet_length("value").cast("long"))
        .withColumn("length", F.when(F.col("value").contains(HEADER_END) & F.col("head").rlike("(?mi)^WARC-Type:"), _field("Content-Length").try_cast("long")))
        .withColumn("needs", F.octet_length("head") + F.lit(8) + F.col("length"))  # 4 bytes end the header, 4 the record
        .withColumn("whole", F.coalesce((F.col("needs") == F.col("bytes")) & F.col("value").endswith(RECORD_END), F.lit(False)))
        .withColumn("text", F.when(F.col("whole"), F.expr("left(substring(value, char_length(head) + 5), char_length(value) - char_length(head) - 8)")))
    )
    return materialise(
        parsed.select(
            "file", "start", "seq", "bytes", "needs", "whole", F.when(F.col("length").isNotNull(), F.col("head")).alias("head"),
            (F.when(~F.col("whole"), F.col("value")) if texts else F.lit(None).cast("string")).alias("piece"),
            payload_digest(F.col("text")).alias("digest"),
            (F.col("text") if texts else F.lit(None).cast("string")).alias("text"),
            F.octet_length("text").cast("long").alias("payload_bytes"),
        )
    )


def _records(stored: DataFrame) -> DataFrame:
    block = ["file", "start"]
    magic = len(MAGIC)
    narrow = stored.select("file", "start", "seq", "bytes", "needs", "whole")
    # a piece ends with the magic of the next one, except the last of its file
    sums = narrow.groupBy(*block).agg(F.sum(F.col("bytes") + magic).alias("covers"))
    before = F.sum("covers").over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    bases = sums.select(*block, F.coalesce(before, F.lit(0)).alias("base"))
    inside = Window.partitionBy(*block).orderBy("seq")
    placed = (
        narrow.withColumn("upto", F.sum(F.col("bytes") + magic).over(inside))
        .join(bases, block)
        .withColumn("at", F.col("base") + F.col("upto") - F.col("bytes") - magic)  # where the piece's text begins
        .where(F.col("at") > 0)  # the text before the first magic is no candidate
        .select("file", "seq", (F.col("at") - magic).alias("offset"), (F.col("at") + F.col("needs")).alias("successor"), (F.col("at") + F.col("bytes")).alias("until"))
    )
    order = Window.partitionBy("file").orderBy("offset")
    breaks = F.coalesce((F.lag("successor").over(order) != F.col("offset")), F.lit(True)).cast("int")
    candidates = materialise(placed.withColumn("run", F.sum(breaks).over(order)))
    reached = _reached_runs(candidates)
    real = candidates.join(reached, ["file", "run"]).where(F.col("offset") >= F.col("entry"))
    chain = materialise(real.select("file", "seq", "offset", "successor"))
    single = stored.where("whole").join(chain.select("file", "seq"), ["file", "seq"]).select("head", "digest", "payload_bytes", "text")
    # pieces that are no record of their own belong to the last record that began before them
    owner = F.last(F.when(F.col("_real"), F.col("offset")), ignorenulls=True).over(order)
    cut = stored.where("not whole").select("file", "seq")
    owned = (
        candidates.join(chain.select("file", "seq", F.lit(True).alias("_real")), ["file", "seq"], "left")
        .withColumn("owner", owner)
        .withColumn("_end", F.max(F.when(F.col("_real"), F.col("successor"))).over(Window.partitionBy("file", "owner")))
        .where(F.col("owner").isNotNull() & (F.col("offset") < F.col("_end")))
    )
    broken = owned.join(cut.select("file", "seq").withColumn("_cut", F.lit(True)), ["file", "seq"], "left")
    broken = broken.join(
        broken.where(F.col("_cut") & F.col("_real")).select("file", "owner"), ["file", "owner"], "left_semi"
    )
    pieces = broken.join(stored.select("file", "seq", "piece", "text", "head", "bytes"), ["file", "seq"])
    whole_piece = F.coalesce("piece", F.concat("head", F.lit(HEADER_END), "text", F.lit(RECORD_END)))
    joined = (
        pieces.groupBy("file", "owner")
        .agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("offset", whole_piece.alias("p")))), lambda x: x["p"]), MAGIC).alias("value"),
            F.max("_end").alias("_end"), F.max("until").alias("_until"),
        )
        .where(F.col("_end") == F.col("_until"))
        .withColumn("head", F.substring_index("value", HEADER_END, 1))
        .withColumn("text", F.expr("left(substring(value, char_length(head) + 5), char_length(value) - char_length(head) - 8)"))
        .select("head", payload_digest(F.col("text")).alias("digest"), F.octet_length("text").cast("long").alias("payload_bytes"), "text")
    )
    records = single.unionByName(joined)
    return records.select(
        F.lower(_field("WARC-Type")).alias("record_type"),
        F.regexp_extract(_field("WARC-Record-ID"), "<urn:page:(-?[0-9]+)>", 1).try_cast("long").alias("page_id"),
        _field("WARC-Target-URI").alias("url"),
        F.regexp_extract(_field("WARC-Refers-To"), "<urn:page:(-?[0-9]+)>", 1).try_cast("long").alias("refers_to"),
        F.regexp_extract(_field("WARC-Payload-Digest"), "sha1:(\\w+)", 1).alias("declared_digest"),
        "payload_bytes", "digest", F.col("text").alias("payload"),
    )


def _reached_runs(candidates: DataFrame) -> DataFrame:
    """(file, run, entry): the runs on the chain from offset 0, and where the chain enters each."""
    runs = candidates.groupBy("file", "run").agg(F.min("offset").alias("first"), F.max_by("successor", "offset").alias("next"))
    first = runs.where(F.col("first") == 0).select("file", "run", F.col("first").alias("entry"))
    ends = runs.select("file", "run", F.col("next").alias("offset"))
    jumps = materialise(
        ends.join(candidates.select("file", "offset", F.col("run").alias("to"), F.col("offset").alias("entry")), ["file", "offset"]).select("file", "run", "to", "entry")
    )
    reached = materialise(first)
    while not jumps.isEmpty():
        ahead = reached.select("file", "run").join(jumps, ["file", "run"]).select("file", F.col("to").alias("run"), "entry")
        grown = materialise(reached.union(ahead).groupBy("file", "run").agg(F.min("entry").alias("entry")))
        jumps = materialise(
            jumps.select("file", "run", F.col("to").alias("mid")).join(jumps.select("file", F.col("run").alias("mid"), "to", "entry"), ["file", "mid"]).select("file", "run", "to", "entry")
        )
        reached = grown
    return reached


def archive_round_trip(pages: DataFrame, folder: str) -> DataFrame:
    """Write `pages`, read them back, and give page_id, payload_bytes, payload_digest, record_type and refers_to.

    A revisit's size and digest are those of the response it refers to, which must bear the digest that the
    revisit declares.
    """
    write_archives(pages, folder)
    records = materialise(read_archives(pages.sparkSession, folder, payloads=False).drop("url"))
    full = records.where(F.col("record_type") == "response").groupBy(F.col("page_id").alias("refers_to"), F.col("digest").alias("declared_digest")).agg(
        F.max("payload_bytes").alias("full_bytes")
    )
    revisits = records.where(F.col("record_type") == "revisit").join(full, ["refers_to", "declared_digest"], "left").select(
        "page_id", F.col("full_bytes").alias("payload_bytes"), F.col("declared_digest").alias("payload_digest"), "record_type", "refers_to"
    )
    return records.where(F.col("record_type") == "response").select(
        "page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", F.col("refers_to")
    ).unionByName(revisits)
