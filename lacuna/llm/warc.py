"""WARC archives: written with payload digests and revisits, read back and assembled by transaction.

Every page becomes three records, compressed one by one: its response, or a revisit of the response
with an equal payload; the request; and metadata. Request and metadata name the response or revisit
they belong to in WARC-Concurrent-To. Reading joins them by that identifier, within their file, and
emits one nested row per capture; a revisit gets its payload's size and page through the record that
WARC-Refers-To names.

Of pages with equal payloads of at least ``least_bytes`` bytes, the one with the smallest page_id is
the response (rows that repeat its page_id are responses as well); all shorter ones are responses.
NULL html is the empty payload; a NULL url becomes urn:page:<page_id>; blanks and line ends in urls
are percent-encoded. A NULL page_id is read back as NULL and is the response only of a group without
other page_ids. Extra columns are ignored. An empty table gives no files and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.llm.base import keep, scratch_name, small_batches, table
from lacuna.llm.files import read_file, write_file
from lacuna.session import new_table_path

FILE_BYTES = 32 << 20
READ_BYTES = 16 << 10
DATE = "2024-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def urn(*parts: object) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(repr(parts).encode()).digest())}>"


def record(kind: str, record_id: str, uri: str, content_type: str, block: bytes, more: dict[str, str]) -> bytes:
    head = {"WARC-Type": kind, "WARC-Record-ID": record_id, "WARC-Date": DATE, "WARC-Target-URI": uri, **more, "Content-Type": content_type, "Content-Length": str(len(block))}
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n"
    gz = zlib.compressobj(1, zlib.DEFLATED, 31)
    return gz.compress(text.encode() + block + b"\r\n\r\n") + gz.flush()


def capture(page_id: int | None, url: str | None, payload: bytes, first: int | None, revisit: bool, nth: int) -> bytes:
    """The three records of a page; ``nth`` tells apart repeated rows of a file."""
    digest = payload_digest(payload)
    uri = (url or f"urn:page:{page_id}").replace(" ", "%20").replace("\r", "%0D").replace("\n", "%0A")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    named = {"WARC-Payload-Digest": f"sha1:{digest}"}
    if revisit:
        main = urn("revisit", page_id, digest, nth)
        more = named | {"WARC-Profile": REVISIT, "WARC-Refers-To": urn("response", first, digest, 0)}
        out = record("revisit", main, uri, "application/http;msgtype=response", http, more)
    else:
        main = urn("response", page_id, digest, nth)
        out = record("response", main, uri, "application/http;msgtype=response", http + payload, named)
    tied = {"WARC-Concurrent-To": main}
    get = f"GET {uri} HTTP/1.1\r\n\r\n".encode()
    fields = b"" if page_id is None else f"page-id: {page_id}\r\n".encode()
    out += record("request", urn("request", page_id, digest, nth), uri, "application/http;msgtype=request", get, tied)
    return out + record("metadata", urn("metadata", page_id, digest, nth), uri, "application/warc-fields", fields, tied)


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record of a file."""
    at, view = 0, memoryview(data)
    while at < len(data):
        gz, parts = zlib.decompressobj(31), []
        while not gz.eof and at < len(data):  # a window at a time: what follows the record is not copied whole
            window = view[at : at + READ_BYTES]
            parts.append(gz.decompress(window))
            at += len(window) - len(gz.unused_data)
        raw = b"".join(parts)
        head, _, rest = raw.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        yield fields, rest[: int(fields["Content-Length"])]


def write_archives(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Write all pages; the manifest has one row per file: folder, name, captures, bytes."""
    spark = df.sparkSession
    small_batches(spark)
    folder = new_table_path(spark, scratch_name("warc"))
    pages = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))
    pages = pages.withColumn("key", F.sha2("payload", 256))
    firsts = pages.filter(F.octet_length("payload") >= least_bytes).groupBy("key").agg(F.min("page_id").alias("first"))
    marked = pages.join(firsts, "key", "left")
    marked = marked.withColumn("revisit", (F.octet_length("payload") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("first")))

    def write(batches) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        held: list[bytes] = []
        size = 0
        seen: dict[tuple, int] = {}

        def flush() -> pa.RecordBatch:
            nonlocal held, size, number, seen
            name = f"part-{part:06d}-{number:06d}.warc.gz"
            size = write_file(folder, name, held)
            row = pa.RecordBatch.from_pylist([{"folder": folder, "name": name, "captures": len(held), "bytes": size}], schema=schema)
            held, size, number, seen = [], 0, number + 1, {}
            return row

        schema = pa.schema([("folder", pa.string()), ("name", pa.string()), ("captures", pa.int64()), ("bytes", pa.int64())])
        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, payload, first, revisit = (batch.column(c)[i].as_py() for c in ("page_id", "url", "payload", "first", "revisit"))
                again = (page_id, hash(payload))
                seen[again] = seen.get(again, -1) + 1
                held.append(capture(page_id, url, payload, first, revisit, seen[again]))
                size += len(held[-1])
                if size >= FILE_BYTES:
                    yield flush()
        if held:
            yield flush()

    written = marked.select("page_id", "url", "payload", "first", "revisit").mapInArrow(write, "folder string, name string, captures long, bytes long")
    return keep(written, "warc-manifest")


RECORD = "file string, kind string, record_id string, concurrent_to string, refers_to_id string, target_uri string, payload_digest string, payload_bytes long, payload binary, block string"


def read_archives(manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """One row per record of the files. Payloads are checked against their digests, and returned if
    asked for; ``block`` holds requests and metadata."""

    def read(batches) -> Iterator[pa.RecordBatch]:
        names = [f.split(" ")[0] for f in RECORD.split(", ")]
        kinds = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
        schema = pa.schema([(f.split(" ")[0], kinds[f.split(" ")[1]]) for f in RECORD.split(", ")])
        for batch in batches:
            for folder, name in zip(*(batch.column(c).to_pylist() for c in ("folder", "name"))):
                rows: list[dict] = []
                size = 0
                for head, block in records(read_file(folder, name)):
                    kind = head["WARC-Type"]
                    row = dict.fromkeys(names) | {"file": name, "kind": kind, "record_id": head["WARC-Record-ID"], "concurrent_to": head.get("WARC-Concurrent-To"), "refers_to_id": head.get("WARC-Refers-To"), "target_uri": head.get("WARC-Target-URI"), "payload_digest": head.get("WARC-Payload-Digest", "").removeprefix("sha1:") or None}
                    if kind == "response":
                        payload = block.partition(b"\r\n\r\n")[2]
                        if payload_digest(payload) != row["payload_digest"]:
                            raise ValueError(f"{name}: {row['record_id']} does not match its digest")
                        row["payload_bytes"] = len(payload)
                        row["payload"] = payload if payloads else None
                        size += len(payload) * payloads
                    elif kind != "revisit":
                        row["block"] = block.decode()
                    rows.append(row)
                    if len(rows) >= 3000 or size > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    files = manifest.select("folder", "name")
    return files.repartition(max(1, files.count())).mapInArrow(read, RECORD)


def captures(found: DataFrame) -> DataFrame:
    """One nested row per capture: page_id, record_type, payload_bytes, payload_digest, refers_to,
    and the structs main, request and metadata."""
    main = found.filter("kind IN ('response', 'revisit')").select("file", F.col("record_id").alias("main_id"), F.struct("kind", "record_id", "target_uri", "payload_digest", "payload_bytes", "payload", "refers_to_id").alias("main"))

    def tied(kind: str) -> DataFrame:
        return found.filter(F.col("kind") == kind).select("file", F.col("concurrent_to").alias("main_id"), F.struct("record_id", "target_uri", "block").alias(kind))

    joined = main.join(tied("request"), ["file", "main_id"], "left").join(tied("metadata"), ["file", "main_id"], "left")
    page = F.regexp_extract(F.col("metadata.block"), r"page-id: (-?[0-9]+)", 1)
    joined = joined.withColumn("page_id", F.when(page != "", page.cast("long")))
    origin = joined.filter("main.kind = 'response'").groupBy(F.col("main_id").alias("refers_to_id")).agg(F.min("page_id").alias("refers_to"), F.first("main.payload_bytes").alias("origin_bytes"))
    joined = joined.withColumn("refers_to_id", F.col("main.refers_to_id")).join(origin, "refers_to_id", "left")
    return joined.select(
        "page_id", F.col("main.kind").alias("record_type"), F.coalesce("main.payload_bytes", "origin_bytes").alias("payload_bytes"),
        F.col("main.payload_digest").alias("payload_digest"), "refers_to", "main", "request", "metadata",
    )


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's capture, read back from the archives."""
    found = keep(read_archives(write_archives(table(spark, sf_dir, "pages"))).drop("payload").withColumn("payload", F.lit(None).cast("binary")), "warc-records")
    return captures(found).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP10_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
g AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first, octet_length(encode(html)) AS bytes FROM p),
d AS (SELECT *, (SELECT string_agg(substr('0000000100100011010001010110011110001001101010111100110111101111',
        4 * (strpos('0123456789abcdef', substr(sha1(html), CAST(i AS INTEGER), 1)) - 1) + 1, 4), '' ORDER BY i) FROM range(1, 41) t(i)) AS bits FROM g)
SELECT page_id, CAST(bytes AS BIGINT) AS payload_bytes,
       (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
          16 * CAST(substr(bits, CAST(5 * k + 1 AS INTEGER), 1) AS INTEGER) + 8 * CAST(substr(bits, CAST(5 * k + 2 AS INTEGER), 1) AS INTEGER)
          + 4 * CAST(substr(bits, CAST(5 * k + 3 AS INTEGER), 1) AS INTEGER) + 2 * CAST(substr(bits, CAST(5 * k + 4 AS INTEGER), 1) AS INTEGER)
          + CAST(substr(bits, CAST(5 * k + 5 AS INTEGER), 1) AS INTEGER) AS INTEGER), 1), '' ORDER BY k) FROM range(0, 32) u(k)) AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM d
"""
