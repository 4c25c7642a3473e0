"""WARC archives: writing them, and reading back only records on the chain from each file's start."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marquee.llm.shared import drop_stage, stage

LEAST_REVISIT = 100

# The WARC format's version line, line ends and record ends.
VERSION = "WARC/1.1"
MAGIC = "WARC/1."
LINE = "\r\n"
RECORD_END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
#: Files are split where a record may begin: a record's end and the magic.
SEPARATOR = RECORD_END + MAGIC


def _sha256(body: Column) -> Column:
    return F.sha2(body.cast("binary"), 256)


def records(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """One column ``value`` for each page: its whole record but for the last line feed.

    Of pages with equal payloads of at least ``least`` bytes, those with the smallest page_id are responses and
    the others revisits without payload that refer to it; pages with a smaller payload or without a page_id are responses.
    A null html is an empty payload, a null url has no target header.
    """
    body = F.coalesce(F.col("html").cast("string"), F.lit(""))
    page = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), body.alias("body"))
    page = page.select("*", F.octet_length("body").cast("long").alias("bytes"), _sha256(F.col("body")).alias("digest"))
    # Written first: where few payloads repeat, Spark then knows it and joins without moving the pages.
    first = stage(
        page.where((F.col("bytes") >= least) & F.col("page_id").isNotNull())
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .select("digest", "first"),
        "first",
    )
    page = page.join(first, "digest", "left")
    revisit = (F.col("page_id") != F.col("first")) & (F.col("bytes") >= least)
    page = page.withColumn("revisit", F.coalesce(revisit, F.lit(False)))
    http = F.lit(f"HTTP/1.1 200 OK{LINE}Content-Type: text/html; charset=utf-8{RECORD_END}")
    block = F.when(F.col("revisit"), http).otherwise(F.concat(http, "body"))
    header = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(LINE))
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    target = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    text = F.concat(
        F.lit(VERSION + LINE),
        header("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
        header("WARC-Record-ID", F.concat(F.lit("<urn:page:"), number("page_id"), F.lit(">"))),
        header("WARC-Date", F.lit(DATE)),
        F.coalesce(header("WARC-Target-URI", target), F.lit("")),
        F.when(
            F.col("revisit"),
            F.concat(
                header("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
                header("WARC-Refers-To", F.concat(F.lit("<urn:page:"), number("first"), F.lit(">"))),
            ),
        ).otherwise(F.lit("")),
        header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        header("X-Payload-Length", number("bytes")),
        header("Content-Type", F.lit("application/http; msgtype=response")),
        header("Content-Length", F.octet_length(block).cast("string")),
        F.lit(LINE),
        block,
        F.lit(RECORD_END[:-1]),
    )
    return page.select(text.alias("value"))


def write(pages: DataFrame, path: str, least: int = LEAST_REVISIT) -> None:
    """Write the archive files, one for each partition, as plain bytes by Spark's own committer."""
    records(pages, least).write.option("lineSep", RECORD_END[-1]).text(path)


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Staged: every place that looks like a record's start, with its successor's offset as its header gives it.

    ``file`` (a hash of its path), ``start, next`` and fields of the header; ``digest`` and ``size`` are of the payload
    where the record ends before the next candidate, and ``part`` is the digest of the bytes up to there. Each task
    reads its own byte range; the ranges' sizes, summed up, turn places in a range into offsets in the file.
    """
    lines = spark.read.option("lineSep", SEPARATOR).text(path)
    value = F.col("value").cast("binary")
    size = F.octet_length(value).cast("long")
    head = F.substring_index("value", RECORD_END, 1)
    field = lambda name: F.nullif(F.regexp_extract("head", rf"(?im)^{name}:[ \t]*(.*?)[ \t]*\r?$", 1), F.lit(""))
    lines = lines.select(
        F.xxhash64("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("range"),
        F.monotonically_increasing_id().alias("row"),
        size.alias("bytes"),
        _sha256(value).alias("part"),
        F.octet_length(head).cast("long").alias("head_bytes"),
        head.alias("head"),
        "value",
    )
    lines = lines.withColumn("content", F.regexp_extract("head", r"(?im)^Content-Length:[ \t]*([0-9]{1,15})[ \t]*\r?$", 1))
    lines = lines.withColumn("content", F.nullif("content", F.lit("")).cast("long"))
    whole = F.col("content") + F.col("head_bytes") + len(RECORD_END) <= F.col("bytes")
    http = F.expr("substring(cast(value as binary), int(head_bytes + 5), int(content))")
    lines = lines.withColumn("block", F.when(whole, http))
    payload = _payload("block")
    lines = lines.select(
        "file",
        "range",
        "row",
        "bytes",
        "part",
        "head_bytes",
        "content",
        (F.col("head_bytes") < F.col("bytes")).alias("closed"),
        F.substring("head", 1, len(MAGIC)).alias("magic"),
        field("WARC-Type").alias("kind"),
        field("WARC-Record-ID").alias("record"),
        field("WARC-Refers-To").alias("refers"),
        field("WARC-Payload-Digest").alias("stated_digest"),
        field("X-Payload-Length").cast("long").alias("stated_bytes"),
        _sha256(payload).alias("digest"),
        F.octet_length(payload).cast("long").alias("size"),
        whole.alias("whole"),
    )
    found = lines = stage(lines, "candidates")
    gap = len(SEPARATOR)
    inside = Window.partitionBy("file", "range").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    ranges = found.groupBy("file", "range").agg(F.sum(F.col("bytes") + gap).alias("n"))
    earlier = Window.partitionBy("file").orderBy("range")
    ranges = ranges.select(
        "file",
        "range",
        F.coalesce(F.sum("n").over(earlier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"),
        (F.sum("n").over(Window.partitionBy("file")) - gap).alias("end"),
    )
    found = found.withColumn("before", F.coalesce(F.sum(F.col("bytes") + gap).over(inside), F.lit(0))).join(
        ranges, ["file", "range"]
    )
    at = F.col("base") + F.col("before")
    # A candidate's own magic lies in the separator, but for the first one of a file.
    start = F.when(at == 0, 0).otherwise(at - len(MAGIC))
    follows = at + F.col("head_bytes") + F.col("content") + 2 * len(RECORD_END)
    right = (
        F.col("closed")
        & F.col("content").isNotNull()
        & (follows <= F.col("end"))
        & ((at > 0) | (F.col("magic") == MAGIC))
    )
    placed = found.select(
        "file",
        start.cast("long").alias("start"),
        F.when(right, follows).cast("long").alias("next"),
        *[c for c in found.columns if c not in ("file", "range", "row", "base", "before", "end", "magic", "closed")],
    )
    placed = stage(placed, "found")
    drop_stage(lines)
    return placed


def _payload(block: str) -> Column:
    """What follows the HTTP header of a record's block."""
    header = F.substring_index(F.col(block).cast("string"), RECORD_END, 1)
    return F.col(block).substr(F.octet_length(header) + 1 + len(RECORD_END), F.octet_length(block))


def reachable(found: DataFrame) -> DataFrame:
    """``file, start`` of the candidates that the chain of successors from a file's start reaches.

    Pointer jumping: in each round every reached candidate marks the one its jump leads to, and all jumps double
    their length, so that the rounds are as many as the logarithm of the most candidates in a file.
    """
    chain = stage(
        found.select("file", "start", F.col("next").alias("jump"), (F.expr("start = 0 and next is not null")).alias("reached")),
        "chain",
    )
    most = chain.groupBy("file").count().agg(F.max("count")).first()[0] or 0
    for _ in range(most.bit_length()):
        marks = chain.where("reached and jump is not null").select(
            "file", F.col("jump").alias("start"), F.lit(True).alias("mark")
        )
        jumps = chain.select("file", F.col("start").alias("jump"), F.col("jump").alias("after"))
        longer = stage(
            chain.join(jumps, ["file", "jump"], "left")
            .join(marks, ["file", "start"], "left")
            .select("file", "start", F.col("after").alias("jump"), (F.col("reached") | F.col("mark").isNotNull()).alias("reached")),
            "chain",
        )
        drop_stage(chain)
        chain = longer
    return chain.where("reached").select("file", "start")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives at ``path``: ``page_id, payload_bytes, payload_digest, record_type, refers_to``.

    Only records on the chain from their file's start count, so that record starts inside payloads are no
    records; a chain ends where a header is broken or a record runs beyond its file. Bytes and digest of a response are those of the
    payload read; a revisit states those of the payload it refers to. An empty archive gives no rows.
    """
    found = candidates(spark, path)
    chain = stage(reachable(found), "reachable")
    real = found.join(chain.withColumn("real", F.lit(True)), ["file", "start"], "left")
    real = real.where("real is null or next is not null")
    owner = F.last(F.when(F.col("real"), F.col("start")), ignorenulls=True).over(
        Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    )
    real = stage(real.withColumn("owner", owner), "records")
    drop_stage(found)
    # Payloads with magic inside are put together again: their parts are known by file and digest.
    split = real.where("real and not whole").select("file", F.col("start").alias("owner"), "head_bytes", "content")
    parts = real.select("file", "owner", "start", "part").join(split, ["file", "owner"])
    wanted = stage(parts.select("file", "part").distinct(), "parts")  # often empty or small: then no payload moves
    lines = spark.read.option("lineSep", SEPARATOR).text(path)
    bodies = (
        lines.select(F.xxhash64("_metadata.file_path").alias("file"), _sha256(F.col("value")).alias("part"), "value")
        .join(wanted, ["file", "part"])
        .dropDuplicates(["file", "part"])
    )
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "value"))), lambda x: x["value"]), SEPARATOR)
    again = (
        parts.join(bodies, ["file", "part"])
        .groupBy("file", "owner", "head_bytes", "content")
        .agg(joined.alias("value"))
        .withColumn("block", F.expr("substring(cast(value as binary), int(head_bytes + 5), int(content))"))
        .select(
            "file",
            F.col("owner").alias("start"),
            _sha256(_payload("block")).alias("again_digest"),
            F.octet_length(_payload("block")).cast("long").alias("again_size"),
        )
    )
    result = real.where("real").join(again, ["file", "start"], "left")
    revisit = F.col("kind") == "revisit"
    number = lambda c: F.nullif(F.regexp_extract(c, "^<urn:page:(-?[0-9]*)>$", 1), F.lit("")).cast("long")
    return result.select(
        number("record").alias("page_id"),
        F.when(revisit, F.col("stated_bytes")).otherwise(F.coalesce("size", "again_size")).alias("payload_bytes"),
        F.when(revisit, F.regexp_replace("stated_digest", "^sha256:", ""))
        .otherwise(F.coalesce("digest", "again_digest"))
        .alias("payload_digest"),
        F.col("kind").alias("record_type"),
        F.when(revisit, number("refers")).alias("refers_to"),
    )
