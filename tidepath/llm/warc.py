"""WARC archives: a writer with payload deduplication, a streaming reader, and transaction assembly.

Archives are written and read by Spark's text source alone, so they may lie in any store that Spark
reaches. A record and the two line ends that close it are one "line" of the writer. Files are
gzip streams, which Spark does not split: one task reads a file from its start, record by record. A broken
record costs itself alone and is reported.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_stage, stage, stage_path

BREAK = "\r\n\r\n"
MARK = b"\r\n\r\nWARC/"
RECORD_SCHEMA = "record_id string, record_type string, target_uri string, warc_date string, content_type string, concurrent_to array<string>, refers_to string, header_digest string, http_head string, payload binary, reason string"
_ARROW = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("warc_date", pa.string()), ("content_type", pa.string()), ("concurrent_to", pa.list_(pa.string())), ("refers_to", pa.string()), ("header_digest", pa.string()), ("http_head", pa.string()), ("payload", pa.binary()), ("reason", pa.string())])


def base32_of_hex(digest: Column) -> Column:
    """Upper-case base32 of a hex string whose length is a multiple of 10."""
    parts = [F.lpad(F.conv(F.substring(digest, i, 10), 16, 32), 8, "0") for i in range(1, 41, 10)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def sha1_base32(payload: Column) -> Column:
    return base32_of_hex(F.sha1(payload))


def _record(record_type: str, record_id: Column, uri: Column, date: str, content_type: str, block: Column, *fields: Column) -> Column:
    head = [F.lit(f"WARC/1.1\r\nWARC-Type: {record_type}\r\nWARC-Record-ID: <"), record_id, F.lit(f">\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), uri, F.lit(f"\r\nContent-Type: {content_type}\r\nContent-Length: "), F.octet_length(block).cast("string")]
    return F.concat(*head, *fields, F.lit(BREAK), block)


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", file_bytes: int = 256 << 20) -> None:
    """Write a response or revisit record, a request and a metadata record for every row.

    Of rows with equal payloads of at least `least_bytes` bytes the one with the largest id (then the last of
    repeated rows) is the response, the others revisit it and carry no payload. Null payloads are empty; null
    urls are empty; line ends in urls become spaces. Rows that repeat get record ids of their own. A file has about
    `file_bytes` bytes before compression, by the mean size of a page. An empty table gives no record.
    """
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    pages = pages.select(
        F.monotonically_increasing_id().alias("row_id"), F.col(id_col).alias("page_id"), F.regexp_replace(F.coalesce(F.col(url_col), F.lit("")), r"[\r\n]", " ").alias("url"), html.alias("html"),
    ).withColumn("digest", sha1_base32(F.col("html").cast("binary"))).withColumn("bytes", F.octet_length("html"))
    # held until the archives are written, so as small as they are
    held = stage_path(pages.sparkSession, "warc-pages")
    pages.write.option("compression", "zstd").parquet(held)
    pages = pages.sparkSession.read.schema(pages.schema).parquet(held)
    groups = pages.filter(F.col("bytes") >= least_bytes).groupBy("digest", "bytes").agg(F.max(F.struct("page_id", "row_id")).alias("keep"))
    rows = pages.join(groups, ["digest", "bytes"], "left")

    def urn(kind: str, page: Column, row: Column) -> Column:
        return F.concat(F.lit("urn:capture:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(":"), row.cast("string"), F.lit(f":{kind}"))

    own = urn("response", F.col("page_id"), F.col("row_id"))
    keeper = urn("response", F.col("keep.page_id"), F.col("keep.row_id"))
    host = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    target = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    line = lambda name, value: F.concat(F.lit(f"\r\n{name}: "), value)
    digest = line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(BREAK))
    response = _record("response", own, F.col("url"), date, "application/http; msgtype=response", F.concat(http, F.col("html")), digest)
    revisit = _record("revisit", own, F.col("url"), date, "application/http; msgtype=response", http, digest, line("WARC-Refers-To", F.concat(F.lit("<"), keeper, F.lit(">"))), F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    joint = line("WARC-Concurrent-To", F.concat(F.lit("<"), own, F.lit(">")))
    request = _record("request", urn("request", F.col("page_id"), F.col("row_id")), F.col("url"), date, "application/http; msgtype=request", F.concat(F.lit("GET "), F.when(target == "", F.lit("/")).otherwise(target), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit(BREAK)), joint)
    metadata = _record("metadata", urn("metadata", F.col("page_id"), F.col("row_id")), F.col("url"), date, "application/warc-fields", F.concat(F.lit("payloadBytes: "), F.col("bytes").cast("string"), F.lit("\r\n")), joint)
    again = F.col("keep").isNotNull() & (F.col("keep.row_id") != F.col("row_id"))
    records = rows.select(F.explode(F.array(F.when(again, revisit).otherwise(response), request, metadata)).alias("value"))
    mean = (pages.agg(F.avg("bytes")).first()[0] or 0) + 1_500  # with the heads of a capture's three records
    records.write.option("lineSep", BREAK).option("compression", "gzip").option("maxRecordsPerFile", max(3, int(3 * file_bytes / mean))).text(path)
    drop_stage(pages.sparkSession, held)


def _fields(head: bytes) -> dict[str, list[str]]:
    found: dict[str, list[str]] = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        found.setdefault(name.strip().lower().decode("latin-1"), []).append(value.strip().decode("utf-8", "replace"))
    return found


def _length(head: bytes) -> tuple[dict[str, list[str]], int | None]:
    """A record's fields and its Content-Length; None if it has none, or no number that can be one."""
    fields = _fields(head)
    given = fields.get("content-length", [""])[0]
    return fields, int(given) if given.isascii() and given.isdigit() and len(given) < 19 else None


def _row(fields: dict[str, list[str]], block: bytes, reason: str | None = None) -> dict:
    one = lambda k: fields.get(k, [None])[0]
    bare = lambda x: x.strip("<>") if x else x
    http, payload = b"", block
    if (one("content-type") or "").startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
    kind = one("warc-type")
    gone = reason is not None or kind == "revisit"
    return {"record_id": bare(one("warc-record-id")), "record_type": kind, "target_uri": one("warc-target-uri"), "warc_date": one("warc-date"), "content_type": one("content-type"), "concurrent_to": [bare(x) for x in fields.get("warc-concurrent-to", [])], "refers_to": bare(one("warc-refers-to")), "header_digest": (one("warc-payload-digest") or "").removeprefix("sha1:") or None, "http_head": http.decode("utf-8", "replace"), "payload": None if gone else payload, "reason": reason}


class _Assembler:
    """Records of one file from its pieces between marks.

    A payload may quote the mark, so a record that is too short for its Content-Length takes up the next pieces
    until it ends exactly where one does. If it would end inside a piece, or the file ends first, it was cut
    short: it is reported, and the piece after its first begins a record of its own.
    """

    def __init__(self, most: int):
        self.most, self.pieces, self.head, self.have = most, [], None, 0

    def _begin(self) -> None:
        head, stop, block = self.pieces[0].partition(b"\r\n\r\n")
        # where a block begins with what looks like a record, the mark has taken the end of the head
        self.head, self.have, self.used = (*_length(head), stop + block), len(block) if stop else -len(BREAK), 1

    def rows(self, end: bool = False) -> Iterator[dict]:
        while self.pieces:
            if self.head is None:
                self._begin()
            fields, need, block = self.head
            reason = "LENGTH" if need is None else "TOO_LONG" if need > self.most else None
            while reason is None and self.have < need and self.used < len(self.pieces):
                self.have += len(MARK) + len(self.pieces[self.used])
                self.used += 1
            if reason is None and self.have < need:
                if not end:
                    return
                reason = "TRUNCATED"
            whole = self.used == 1 or (need is not None and (self.have == need or (end and self.used == len(self.pieces) and self.have <= need + len(BREAK))))
            if reason is None and whole:
                yield _row(fields, MARK.join([block, *self.pieces[1 : self.used]])[len(BREAK) : len(BREAK) + need])
                del self.pieces[: self.used]
            else:
                yield _row(fields, b"", reason or "TRUNCATED")
                del self.pieces[0]
            self.head = None


def _records(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        held, at, file = 0, None, _Assembler(most)

        def rows() -> Iterator[dict]:
            nonlocal at, file
            for batch in batches:
                for name, piece in zip(batch.column(0), batch.column(1)):
                    if name.as_py() != at:
                        yield from file.rows(end=True)
                        at, file = name.as_py(), _Assembler(most)
                    file.pieces.append(piece.as_py())
                    yield from file.rows()
            yield from file.rows(end=True)

        for row in rows():
            out.append(row)
            held += len(row["payload"] or b"")
            if held > 4_000_000 or len(out) >= 2_000:
                yield pa.RecordBatch.from_pylist(out, schema=_ARROW)
                out, held = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=_ARROW)

    return run


def read_warc(spark: SparkSession, path: str, most_bytes: int = 1 << 30) -> DataFrame:
    """A row per record, read in order from gzip-compressed archives; Content-Length, not the record mark, decides where a payload ends.

    Only gzip files may be read this way: Spark would split plain ones, and a split could begin inside a
    payload. A broken record has its fields as far as they can be read, no payload, and a reason: TRUNCATED (it
    ends before its Content-Length), LENGTH (it has none, or one that is no number) or TOO_LONG (more than
    `most_bytes`, which bounds a task's memory); records after it are read as ever. Others have no reason.
    """
    lines = spark.read.option("lineSep", MARK.decode()).text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary")).mapInArrow(_records(most_bytes), RECORD_SCHEMA)


def assemble(records: DataFrame, carry: list[str]) -> DataFrame:
    """One nested row per capture: record_id, record_type, refers_to, the columns `carry`, request, n_requests, metadata, n_metadata.

    Request and metadata records find their capture through Concurrent-To: their own, the capture's, or that of
    a request for metadata that names the request. Of several the one with the smallest record id is nested
    and all are counted, so a capture with very many of them stays one bounded row. Records that name no
    capture present are not part of one; a capture without them has null there.
    """
    records = records.filter("reason is null")
    captures = records.filter(F.col("record_type").isin("response", "revisit", "resource"))
    others = records.filter(F.col("record_type").isin("request", "metadata"))
    named = others.select("record_id", F.explode("concurrent_to").alias("to"))
    named = named.unionByName(captures.select(F.explode("concurrent_to").alias("record_id"), F.col("record_id").alias("to")))
    heads = captures.select(F.col("record_id").alias("capture"))
    direct = named.join(heads, F.col("to") == F.col("capture"), "left_semi")
    via = named.join(heads, F.col("to") == F.col("capture"), "left_anti").join(direct.select(F.col("record_id").alias("mid"), F.col("to").alias("end")), F.col("to") == F.col("mid")).select("record_id", F.col("end").alias("to"))
    links = direct.unionByName(via).distinct()
    part = F.struct("record_id", "target_uri", "warc_date", "content_type", "http_head", F.col("payload").cast("string").alias("fields"))
    parts = links.join(others.select("record_id", "record_type", part.alias("part")), "record_id")
    kind = lambda k: F.col("record_type") == k
    parts = parts.groupBy(F.col("to").alias("record_id")).agg(
        F.min(F.when(kind("request"), F.col("part"))).alias("request"), F.count(F.when(kind("request"), 1)).alias("n_requests"), F.min(F.when(kind("metadata"), F.col("part"))).alias("metadata"), F.count(F.when(kind("metadata"), 1)).alias("n_metadata")
    )
    return captures.select("record_id", "record_type", "refers_to", *carry).join(parts, "record_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_requests", "n_metadata")})


def captures_digest(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, n_requests, n_metadata: one row per capture of an archive of write_warc.

    A revisit's digest and size are those of the response it refers to. The archives are parsed once: what is
    needed of their records is written before it is joined, payloads of captures as size and digest alone.
    """
    page = lambda c: F.regexp_extract(c, r"^urn:capture:(-?\d+):", 1)
    number = lambda c: F.when(page(c) != "", page(c)).cast("long")
    response = F.col("record_type") == "response"
    records = records.filter("reason is null").withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.when(response, sha1_base32(F.col("payload"))))
    records = stage(records.withColumn("payload", F.when(~response, F.col("payload"))), "records")
    whole = assemble(records, ["payload_bytes", "payload_digest"])
    sizes = records.filter(F.col("record_type") == "response").select(F.col("record_id").alias("first"), F.col("payload_bytes").alias("first_bytes"), F.col("payload_digest").alias("first_digest"))
    return whole.join(sizes, F.col("refers_to") == F.col("first"), "left").select(
        number("record_id").alias("page_id"), F.coalesce("payload_bytes", "first_bytes").alias("payload_bytes"), F.coalesce("payload_digest", "first_digest").alias("payload_digest"), "record_type", number("refers_to").alias("refers_to"), "n_requests", "n_metadata"
    )


def round_trip(pages: DataFrame) -> DataFrame:
    """Write pages as archives in the shared folder, read them back, assemble captures, give their digests."""
    spark = pages.sparkSession
    path = stage_path(spark, "warc")
    write_warc(pages, path)
    return captures_digest(read_warc(spark, path))
