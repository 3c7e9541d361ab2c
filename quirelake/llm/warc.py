"""WARC archives: writing, reading, and transaction assembly through concurrent-to identifiers."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.llm import common

#: Equal payloads of at least this many bytes are stored once.
REVISIT_BYTES = 1000
#: Captures in one archive file, at most.
FILE_CAPTURES = 1000
#: Bytes of an archive that are unpacked at once.
PIECE = 1 << 20
#: Fixed, so that archives are reproducible.
DATE = "2024-01-01T00:00:00Z"
#: The profile of a revisit with an identical payload, fixed by the WARC standard.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
RECORD = "path string, record_no long, warc_type string, record_id string, concurrent_to string, refers_to string, target_uri string, warc_date string, content_type string, payload_digest string, payload_bytes long, payload binary"


def captures_of(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest and capture of every row: an id of its own for each, made of the page's id, the digest,
    the url and a number, which tells equal rows apart. Only repeated rows are gathered, in one row with a count, and dealt
    out again in blocks."""
    own = pages.select("page_id", F.regexp_replace("url", "[\\r\\n]+", " ").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    own = own.withColumn("digest", F.sha1("html")).withColumn("url_key", F.xxhash64("url"))
    keys = ["page_id", "digest", "url_key"]
    again = common.materialize(own.groupBy(*keys).count().where("count > 1"), "warc-repeated", narrow=True)
    single, number = own, F.lit(1).cast("long")
    if again.limit(1).count():
        few = common.small_or_not(again.select(*(F.col(k).alias(f"__{k}") for k in keys)), 128)
        same = own["page_id"].eqNullSafe(F.col("__page_id")) & (own["digest"] == F.col("__digest")) & (own["url_key"] == F.col("__url_key"))
        single = own.join(few, same, "left_anti").withColumn("number", number)
        many = own.join(few, same, "left_semi").groupBy(*keys).agg(F.first("url").alias("url"), F.first("html").alias("html"), F.count("*").alias("n"))
        many = many.withColumn("block", F.explode(F.expr("sequence(0L, (n - 1) div 1000)"))).repartition(F.xxhash64(*keys, "block"))
        many = many.withColumn("number", F.explode(F.expr("sequence(block * 1000 + 1, least(n, block * 1000 + 1000))")))
        single = single.unionByName(many.select(*single.columns))
    else:
        single = single.withColumn("number", number)
    return single.withColumn("capture", capture_id("page_id", "digest", "url_key", "number"))


def capture_id(page_id, digest, url_key, number):
    """digest:url:number:=page_id; nothing stands for a null page_id."""
    return F.concat(F.substring(digest, 1, 16), F.lit(":"), F.lower(F.hex(url_key)), F.lit(":"), F.col(number).cast("string") if isinstance(number, str) else number, F.lit(":"), F.coalesce(F.concat(F.lit("="), F.col(page_id).cast("string")), F.lit("")))


def page_of(record_id):
    """The page_id, as text, in a record id; null if it was null."""
    return F.when(record_id.rlike(":=.*>$"), F.regexp_extract(record_id, ":=(.*)>$", 1))


def refers(captures: DataFrame, at_least: int = REVISIT_BYTES) -> DataFrame:
    """digest, size, refers_to (a capture) for payloads that several captures have, if they are large enough: the one with
    the largest page_id, of several the one with the largest url key, and of equal rows the first."""
    big = captures.where(F.octet_length("html") >= at_least).select("page_id", "digest", "url_key", F.octet_length("html").alias("size"))
    last = big.groupBy("digest", "size").agg(F.max(F.struct("page_id", "url_key")).alias("last"), F.count("*").alias("n")).where("n > 1")
    return last.select("digest", "size", "last.*").select(F.col("digest").alias("__digest"), F.col("size").alias("__size"), capture_id("page_id", "digest", "url_key", F.lit("1")).alias("refers_to"))


def record(kind: str, uri, fields: list, content_type: str, body):
    """One WARC record as a string column; fields: (name, column) pairs, left out where null. The sink ends it with
    another line end, which completes the two that must follow a block."""
    head = [F.lit(f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Date: {DATE}\r\n")]
    for name, value in [*fields, ("WARC-Target-URI", uri)]:
        head.append(F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit("")))
    return F.concat(*head, F.lit(f"Content-Type: {content_type}\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n"))


def write_warc(pages: DataFrame, path: str, file_captures: int = FILE_CAPTURES) -> None:
    """Write each row of page_id, url, html as three records - request, response or revisit, metadata - into gzipped
    archives under path, all of a capture in one file.

    Every row is a capture of its own, rows that repeat an id, or all columns, too, and rows with a null id. Null html is
    an empty payload; url is cleaned of line ends, and left out if null. A revisit has its headers and no payload; of equal
    payloads the one with the largest page_id is the response (see refers() for ties). Very long payloads are written as
    they are. An empty table gives no archive or empty ones. Other columns are ignored."""
    own = captures_of(pages)
    there = common.small_or_not(common.materialize(refers(own), "warc-responses", narrow=True), 256)
    own = own.join(there, (own["digest"] == F.col("__digest")) & (F.octet_length(own["html"]) == F.col("__size")), "left")
    own = own.withColumn("refers_to", F.when(F.col("refers_to") != F.col("capture"), F.col("refers_to")))
    name = lambda kind, column: F.concat(F.lit(f"<urn:page:{kind}:"), column, F.lit(">"))
    me = name("capture", F.col("capture"))
    digest = F.concat(F.lit("sha1:"), F.col("digest"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("html").cast("string"), F.lit("\r\n\r\n"))
    shared = [("WARC-Record-ID", me), ("WARC-Payload-Digest", digest)]
    response = record("response", F.col("url"), shared, "application/http;msgtype=response", F.concat(http, "html"))
    revisit = record("revisit", F.col("url"), [*shared, ("WARC-Refers-To", name("capture", F.col("refers_to"))), ("WARC-Profile", F.lit(PROFILE))], "application/http;msgtype=response", http)
    request = record("request", F.col("url"), [("WARC-Record-ID", name("request", F.col("capture"))), ("WARC-Concurrent-To", me)], "application/http;msgtype=request", F.concat(F.lit("GET "), F.coalesce(F.col("url"), F.lit("/")), F.lit(" HTTP/1.1\r\n\r\n")))
    metadata = record("metadata", F.col("url"), [("WARC-Record-ID", name("metadata", F.col("capture"))), ("WARC-Concurrent-To", me)], "application/warc-fields", F.concat(F.lit("pageId: "), F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.lit("\r\n")))
    rows = own.select(F.concat(request, F.lit("\r\n"), F.when(F.col("refers_to").isNull(), response).otherwise(revisit), F.lit("\r\n"), metadata).alias("value"))
    rows.write.option("compression", "gzip").option("lineSep", "\r\n").option("maxRecordsPerFile", file_captures).text(path)


def unpacked(data: bytes) -> Iterator[bytes]:
    """An archive piece by piece; gzip members, one for the file or one for each record, are unpacked in turn."""
    view = memoryview(data)
    while bytes(view[:2]) == b"\x1f\x8b":
        unzip, rest = zlib.decompressobj(31), view
        while not unzip.eof:
            piece = unzip.decompress(rest, PIECE)
            rest = unzip.unconsumed_tail
            yield piece
            if not piece and not rest:
                break
        view = memoryview(unzip.unused_data)
    if len(view):
        yield bytes(view)


def parse_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of each record of an archive; only a record and a piece are held unpacked. What
    ends before its length is given as far as it goes."""
    buf, at, pieces = bytearray(), 0, unpacked(data)

    def more() -> bool:
        nonlocal at
        piece = next(pieces, None)
        if piece is None:
            return False
        if at > PIECE:
            del buf[:at]
            at = 0
        buf.extend(piece)
        return True

    while True:
        seen = 0  # bytes after at that hold no end of a head
        while (end := buf.find(b"\r\n\r\n", at + seen)) < 0:
            seen = max(0, len(buf) - at - 3)
            if not more():
                return
        head = buf[at:end].decode("utf-8", "replace").split("\r\n")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head[1:])}
        size = int(fields.get("content-length", "0"))
        at = end + 4
        while len(buf) < at + size + 4 and more():
            pass
        yield fields, bytes(buf[at : at + size])
        at += size + 4


def sha1_hex(field: str) -> str:
    """A digest field as lower-case hex; base32 and hex values are both in use."""
    value = field.rpartition(":")[2]
    return base64.b32decode(value.upper()).hex() if len(value) == 32 and set(value.upper()) <= set(BASE32) else value.lower()


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per record of all archives under path (RECORD). payload_digest is computed from the payload, for revisits
    taken from the header; the payload of a response is its HTTP body."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        common.lean()
        for pdf in it:
            for path, data in zip(pdf["path"], pdf["content"], strict=True):
                rows = []
                for i, (f, block) in enumerate(parse_archive(data)):
                    payload = block
                    if "msgtype=response" in f.get("content-type", ""):
                        payload = payload.partition(b"\r\n\r\n")[2]
                    revisit = f.get("warc-type") == "revisit"
                    digest = sha1_hex(f.get("warc-payload-digest", "")) if revisit else hashlib.sha1(payload).hexdigest()
                    rows.append((path, i, f.get("warc-type"), f.get("warc-record-id"), f.get("warc-concurrent-to"), f.get("warc-refers-to"), f.get("warc-target-uri"), f.get("warc-date"), f.get("content-type"), digest, None if revisit else len(payload), payload if with_payload else None))
                    if len(rows) == 500:
                        yield frame(rows)
                        rows = []
                if rows:
                    yield frame(rows)

    def frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=[x.split()[0] for x in RECORD.split(", ")])
        return out.assign(payload_bytes=out["payload_bytes"].astype("Int64"))

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gz").load(path).select("path", "content")
    return files.mapInPandas(run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: record_id, url, record_type, payload_digest, payload_bytes, payload, refers_to (a record id),
    and nested request, metadata.

    Requests and metadata meet their response or revisit through WARC-Concurrent-To, whichever of the two names the
    other. A revisit gets the size and payload of the response that it refers to, and null if that is not there. A
    capture without request or metadata has null there; of several, the one with the smallest record id is taken;
    repeated records count once; records that belong to no capture give no row."""
    main = records.where("warc_type in ('response', 'revisit')").dropDuplicates(["record_id"])
    side = records.where("warc_type in ('request', 'metadata')")
    back = main.where("concurrent_to is not null").select(F.col("concurrent_to").alias("record_id"), F.col("record_id").alias("named"))
    side = side.join(back, "record_id", "left").withColumn("capture", F.coalesce("named", "concurrent_to")).where("capture is not null")
    nested = lambda kind: F.min(F.when(F.col("warc_type") == kind, F.struct("record_id", "target_uri", "warc_date", "content_type", "payload_bytes", "payload")))
    side = side.groupBy("capture").agg(nested("request").alias("request"), nested("metadata").alias("metadata"))
    seen = main.where("warc_type = 'response'").select(F.col("record_id").alias("seen_id"), F.col("payload_bytes").alias("there_bytes"), F.col("payload").alias("there"))
    # what refers to nothing looks itself up, so that no null key gathers all responses
    out = main.join(side, main["record_id"] == side["capture"], "left").withColumn("seen_id", F.coalesce("refers_to", "record_id")).join(seen, "seen_id", "left")
    return out.select("record_id", F.col("target_uri").alias("url"), F.col("warc_type").alias("record_type"), "payload_digest", F.coalesce("payload_bytes", "there_bytes").alias("payload_bytes"), F.when(F.col("warc_type") == "revisit", F.col("there")).otherwise(F.col("payload")).alias("payload"), "refers_to", "request", "metadata")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.tune(spark)
    path, pages = common.new_path(spark, "warc"), common.table(spark, sf_dir, "pages")
    write_warc(pages, path)
    # a table, so that the archives are parsed once
    captures = assemble(common.materialize(read_warc(spark, path, with_payload=False), "warc-records"))
    number = lambda c: page_of(F.col(c)).cast(dict(pages.dtypes)["page_id"])
    return captures.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"), "url", F.col("request.target_uri").alias("request_uri"), F.col("metadata.payload_bytes").alias("metadata_bytes"))


QUERIES = {"op6_warc": op6_warc}
ORACLES = {
    "op6_warc": """
WITH p AS (SELECT page_id, regexp_replace(url, '[\\r\\n]+', ' ', 'g') AS url, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages),
q AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS last FROM p)
SELECT page_id, n AS payload_bytes, sha1(html) AS payload_digest, CASE WHEN n >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id <> last THEN last END AS refers_to, url, url AS request_uri, CAST(10 + length(CAST(page_id AS VARCHAR)) AS BIGINT) AS metadata_bytes
FROM q
""",
}
