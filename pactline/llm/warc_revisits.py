"""WARC archives with revisit records.

Only headers (page id, URL, payload digest, payload bytes) are shuffled by digest; the largest page id of equal payloads is
the original, the others become revisit records that refer to it. Records with fresh headers are written as gzipped WARC/1.1
files of bounded size by Spark's text writer, whose line separator is the end of a record. The reader streams the archives
back by Content-Length alone (a payload may hold the separator, or begin or end in CR and LF) and resolves revisits by joining
originals. A file is one gzip stream, as Spark's writer makes it.

Defined cases: a null payload is empty; payloads below `min_bytes` are always responses; rows of equal id and payload are all
responses, or all revisits; a null id is never an original; line breaks in a URL are percent-encoded; an empty table writes
no archive and gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_path, slices

MIN_BYTES = 1000
ARCHIVE_RECORDS = 100_000
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def payload_headers(pages: DataFrame) -> DataFrame:
    """(page_id, url, digest, n) of every page; digest is the SHA-1 in hex, n the bytes of the payload."""
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("")), "\r", "%0D"), "\n", "%0A").alias("url"),
                        F.sha1(body).alias("digest"), F.octet_length(body).cast("long").alias("n"))


def plan_records(headers: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """(page_id, digest, n, original, original_url): original is set for revisits only; one row per page id and digest."""
    # partial maxima first: a payload shared by a third of all pages is one row per task here
    originals = (headers.where(F.col("n") >= min_bytes).groupBy("digest").agg(F.max(F.struct("page_id", "url")).alias("o"), F.count("*").alias("k"))
                 .where((F.col("k") > 1) & F.col("o.page_id").isNotNull()).select("digest", F.col("o.page_id").alias("o"), F.col("o.url").alias("o_url")))
    joined = headers.dropDuplicates(["page_id", "digest"]).join(originals, "digest", "left")
    again = F.col("o").isNotNull() & (F.col("n") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("o"))
    return joined.select("page_id", "digest", "n", F.when(again, F.col("o")).alias("original"), F.when(again, F.col("o_url")).alias("original_url"))


def _urn(page_id: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws(":", page_id.cast("string"), digest).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-"), F.substring(h, 13, 4), F.lit("-"),
                    F.substring(h, 17, 4), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))


def record_text() -> Column:
    """One record without the closing separator, from page_id, url, digest, n, original, original_url and html."""
    line = "\r\n"
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{line}Content-Type: text/html; charset=utf-8{line}Content-Length: "), F.col("n").cast("string"), F.lit(END))
    again = F.col("original").isNotNull()
    block = F.when(again, http).otherwise(F.concat(http, F.coalesce("html", F.lit(""))))
    head = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), F.when(again, "revisit").otherwise("response")),
            F.concat(F.lit("WARC-Record-ID: "), _urn(F.col("page_id"), F.col("digest"))), F.lit(f"WARC-Date: {DATE}"),
            F.concat(F.lit("WARC-Target-URI: "), F.col("url")), F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
            F.when(F.col("page_id").isNotNull(), F.concat(F.lit("X-Page-Id: "), F.col("page_id").cast("string"))),
            F.when(again, F.concat(F.lit(f"WARC-Profile: {PROFILE}{line}WARC-Refers-To: "), _urn(F.col("original"), F.col("digest")),
                                   F.lit(f"{line}WARC-Refers-To-Target-URI: "), F.col("original_url"),
                                   F.lit(f"{line}X-Refers-To-Page: "), F.col("original").cast("string"))),
            F.lit("Content-Type: application/http;msgtype=response"),
            F.concat(F.lit("Content-Length: "), F.octet_length(block.cast("binary")).cast("string"))]
    return F.concat(F.concat_ws(line, *head), F.lit(END), block)


def write_archives(pages: DataFrame, path: str, min_bytes: int = MIN_BYTES, archive_records: int = ARCHIVE_RECORDS) -> None:
    """Write one record per page below `path`. Payloads are shuffled once, to meet their plan; a file holds a partition of
    that join (its size is the session's advisory partition size) and at most `archive_records` records."""
    plan = plan_records(payload_headers(pages), min_bytes)
    body = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("u"), "html",
                        F.sha1(F.coalesce("html", F.lit("")).cast("binary")).alias("digest"))
    url = F.regexp_replace(F.regexp_replace("u", "\r", "%0D"), "\n", "%0A").alias("url")
    same = (body["page_id"].eqNullSafe(plan["page_id"])) & (body["digest"] == plan["digest"])
    rows = body.join(plan, same).select(body["page_id"], url, body["digest"], "n", "original", "original_url", "html")
    (rows.select(record_text().alias("value")).write.option("lineSep", END).option("compression", "gzip")
     .option("maxRecordsPerFile", archive_records).text(path))


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """(page_id, url, record_type, digest, refers_to, payload_bytes, payload_sha1[, payload]) of every record below `path`.

    The payload columns are null for revisits; `payload=False` leaves the bytes themselves out.
    """
    parts = spark.read.option("lineSep", END).text(path).select(F.col("value").cast("binary").alias("value"))
    names = ["page_id", "url", "record_type", "digest", "refers_to", "payload_bytes", "payload_sha1"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    if payload:
        names, kinds = [*names, "payload"], [*kinds, pa.binary()]
    sep = END.encode()

    def record(fields: dict[bytes, bytes], block: bytes) -> tuple:
        body = block.partition(sep)[2] if fields[b"warc-type"] == b"response" else None
        number = lambda k: int(fields[k]) if k in fields else None
        row = (number(b"x-page-id"), fields.get(b"warc-target-uri", b"").decode("utf-8", "replace"), fields[b"warc-type"].decode(),
               fields[b"warc-payload-digest"].decode().removeprefix("sha1:"), number(b"x-refers-to-page"),
               None if body is None else len(body), None if body is None else hashlib.sha1(body).hexdigest())
        return (*row, body) if payload else row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # pieces between separators, in file order, are the bytes of the files again once the separators are put back; lengths come
        # from the headers alone, as a payload may hold a separator or end in part of one
        held, fields, need = bytearray(), None, 0
        for b in slices(batches):
            out = []
            for v in b.column(0).to_pylist():
                held += v
                held += sep
                while True:
                    if fields is None:
                        while held[:1] in (b"\r", b"\n"):  # what a file's last piece had too much
                            del held[:1]
                        at = held.find(sep)
                        if at < 0:
                            break
                        lines = bytes(held[:at]).split(b"\r\n")
                        if not lines[0].startswith(b"WARC/"):
                            raise ValueError("not a record header")
                        fields = {k.lower(): x for k, _, x in (y.partition(b": ") for y in lines[1:])}
                        need = int(fields[b"content-length"])
                        del held[:at + len(sep)]
                    if len(held) < need + len(sep):
                        break
                    if held[need:need + len(sep)] != sep:
                        raise ValueError("a block is longer than its header says")
                    out.append(record(fields, bytes(held[:need])))
                    del held[:need + len(sep)]
                    fields = None
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)
        if fields is not None or held.strip(b"\r\n"):
            raise ValueError("the archive ends inside a record")

    sql = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}
    return parts.mapInArrow(run, ", ".join(f"{n} {sql[k]}" for n, k in zip(names, kinds, strict=True)))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Responses as they are, revisits with the payload columns of the response they refer to."""
    own = [c for c in records.columns if c.startswith("payload")]
    first = records.where("record_type = 'response'")
    originals = first.dropDuplicates(["page_id", "digest"]).select(F.col("page_id").alias("_o"), F.col("digest").alias("_d"), *[F.col(c).alias(f"_{c}") for c in own])
    again = records.where("record_type = 'revisit'").drop(*own)
    found = again.join(originals, (F.col("refers_to") == F.col("_o")) & (F.col("digest") == F.col("_d")), "left")
    rest = [c for c in records.columns if c not in own]
    return first.select(*rest, *own).union(found.select(*rest, *[F.col(f"_{c}").alias(c) for c in own]))


def archive_round_trip(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) as read back from freshly written archives."""
    path = shared_path(pages.sparkSession, "warc")
    write_archives(pages, path, min_bytes)
    got = resolve_revisits(read_archives(pages.sparkSession, path, payload=False))
    return got.select("page_id", "payload_bytes", F.col("payload_sha1").alias("payload_digest"), "record_type", "refers_to")
