"""WARC archives: a writer and a Python data source that reads headers first.

Writing stays in Spark's own text writer: a record is one string and every record ends with two line breaks, which is
the line separator, so archives go to any file system that Spark writes to, with its commit protocol. Files hold a bounded
number of records.

Reading lists files with their sizes and packs them into partitions. Filters on the header columns are pushed into the
source and are decided on the header block; payloads of records that fail, or of types that are not asked for, are
skipped over, not decoded. A file is read as a stream, one record in memory at a time.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, IsNull, StringStartsWith,
)

#: Header columns and the names they are read from.
HEADERS = {
    "record_type": "warc-type",
    "record_id": "warc-record-id",
    "target_uri": "warc-target-uri",
    "refers_to": "warc-refers-to",
    "payload_digest": "warc-payload-digest",
    "content_type": "content-type",
}
SCHEMA = ", ".join(f"{c} string" for c in HEADERS) + ", headers map<string,string>, payload binary"
RECORDS_PER_FILE = 100_000
PARTITION_BYTES = 64 << 20
BATCH_BYTES = 8 << 20
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def base32_sha1(data: Column) -> Column:
    """Upper-case base-32 SHA-1 of a binary or string column: 160 bits are 32 digits, eight from each 40 bits."""
    digest = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digest, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def record_id(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *parts))
    bits = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *bits), F.lit(">"))


def write_warc(records: DataFrame, path: str, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Write ``record_type, record_id, target_uri, refers_to, payload_digest, payload`` (string) and ``extra``, a map of
    further headers, as archives below ``path``. Null headers are left out, line breaks in them become blanks; a
    null payload, as in a revisit, is an empty block."""
    def header(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), F.translate(value, "\r\n", "  "), F.lit("\r\n"))

    is_http = F.col("record_type").isin("response", "revisit")
    block = F.when(F.col("payload").isNull(), "").when(is_http, F.concat(F.lit(_HTTP), "payload")).otherwise(F.col("payload"))
    content = F.when(is_http, "application/http; msgtype=response").otherwise("text/html; charset=utf-8")
    lines = [
        F.lit("WARC/1.1\r\n"),
        header("WARC-Type", F.col("record_type")),
        header("WARC-Record-ID", F.col("record_id")),
        header("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        header("WARC-Target-URI", F.col("target_uri")),
        header("WARC-Refers-To", F.col("refers_to")),
        header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        F.array_join(F.transform(F.map_entries("extra"), lambda e: header_of(e)), ""),
        header("Content-Type", content),
        header("Content-Length", F.octet_length("block").cast("string")),
        F.lit("\r\n"),
    ]
    text = F.concat(*[F.coalesce(x, F.lit("")) for x in lines], F.col("block"))
    (records.withColumn("block", block).select(text.alias("value"))
     .write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", records_per_file).option("compression", "gzip").text(path))


def header_of(entry: Column) -> Column:
    return F.concat(entry.key, F.lit(": "), F.translate(entry.value, "\r\n", "  "), F.lit("\r\n"))


class Files(InputPartition):
    def __init__(self, files: list[str]):
        self.files = files


class WarcSource(DataSource):
    """``spark.read.format("warc").load(path)``; option ``payload`` is "all" (default), "none" or a record type."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> "WarcReader":
        return WarcReader(dict(self.options))


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.payload = options["path"], options.get("payload", "all")
        self.partition_bytes = int(options.get("partitionbytes", options.get("partitionBytes", PARTITION_BYTES)))
        self.pushed: list = []

    def pushFilters(self, filters) -> Iterator:
        """Keep what a header block decides; hand the rest back to Spark."""
        for f in filters:
            known = len(f.attribute) == 1 and f.attribute[0] in HEADERS
            if known and isinstance(f, (EqualTo, In, IsNotNull, IsNull, StringStartsWith)):
                self.pushed.append(f)
            else:
                yield f

    def partitions(self) -> list[Files]:
        """Files, largest first, packed up to ``partition_bytes``; an archive has no safe place to be split at."""
        system, root = _system(self.path)
        info = system.get_file_info(root)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.type == pafs.FileType.File else system.get_file_info(pafs.FileSelector(root, recursive=True))
        files = sorted((f for f in found if f.type == pafs.FileType.File and f.base_name[0] not in "._" and f.size), key=lambda f: (-f.size, f.path))
        parts, size = [], self.partition_bytes
        for f in files:
            if size + f.size > self.partition_bytes:
                parts.append(Files([]))
                size = 0
            parts[-1].files.append(f.path)
            size += f.size
        return parts

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([*((c, pa.string()) for c in HEADERS), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])
        system, _ = _system(self.path)
        rows, held = [], 0
        for name in partition.files:
            for headers, payload in records(system, name, self.wanted, self.payload):
                rows.append({c: headers.get(h) for c, h in HEADERS.items()} | {"headers": list(headers.items()), "payload": payload})
                held += len(payload or b"") + 500
                if held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    def wanted(self, headers: dict[str, str]) -> bool:
        for f in self.pushed:
            value = headers.get(HEADERS[f.attribute[0]])
            ok = (value is None if isinstance(f, IsNull) else value is not None and (
                isinstance(f, IsNotNull) or isinstance(f, EqualTo) and value == f.value
                or isinstance(f, In) and value in f.value or isinstance(f, StringStartsWith) and value.startswith(f.value)))
            if not ok:
                return False
        return True


def _system(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), path
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(path)


def records(system: pafs.FileSystem, name: str, wanted, payloads: str) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """Headers (lower-case names; a repeated name keeps its last value) and payload of each wanted record of a file."""
    packed = name.endswith(".gz")
    stream = io.BufferedReader(system.open_input_stream(name, compression="gzip") if packed else system.open_input_file(name), 1 << 20)
    with stream:
        while line := stream.readline():
            if not line.strip():
                continue  # between records
            if not line.startswith(b"WARC/"):
                raise ValueError(f"{name}: no record starts with {line[:40]!r}")
            headers, last = {}, ""
            while (line := stream.readline().rstrip(b"\r\n")):
                text = line.decode("utf-8", "replace")
                if text[0] in " \t" and last:
                    headers[last] += " " + text.strip()
                else:
                    last, _, value = text.partition(":")
                    last = last.strip().lower()
                    headers[last] = value.strip()
            length = int(headers["content-length"])
            keep = wanted(headers)
            if keep and payloads in ("all", headers.get("warc-type")):
                block = stream.read(length)
                if len(block) < length:
                    raise ValueError(f"{name}: a record ends early")
                yield headers, _payload(headers, block)
                continue
            if packed:
                while length:
                    length -= len(stream.read(min(length, 1 << 20))) or length
            else:
                stream.seek(length, io.SEEK_CUR)
            if keep:
                yield headers, None


def _payload(headers: dict[str, str], block: bytes) -> bytes:
    if headers.get("content-type", "").startswith("application/http"):
        return block.partition(b"\r\n\r\n")[2]
    return block


def read_warc(spark: SparkSession, path: str, payload: str = "all") -> DataFrame:
    """Rows of all archives below ``path``; see ``WarcSource``. Header filters put on it are pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("payload", payload).load(path)


def page_records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Records for ``write_warc`` from ``page_id, url, html``.

    Of pages with equal payloads of at least ``min_bytes`` bytes, that with the smallest id is the response and the
    others revisit it, without a block; smaller ones are all responses. A null page is an empty payload. Null ids sort
    last; rows that repeat the response's id are responses too. Payloads are equal by SHA-256 and length. An empty
    table gives no records.
    """
    body = F.coalesce(F.col("html"), F.lit(""))
    keyed = pages.select("page_id", "url", body.alias("payload"), F.unhex(F.sha2(body, 256)).alias("key"))
    first = keyed.groupBy("key").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = keyed.join(first, "key", "left").withColumn("bytes", F.octet_length("payload"))
    revisit = F.col("n").isNotNull() & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")) & (F.col("bytes") >= min_bytes)
    own = lambda c: record_id(F.coalesce(F.col(c).cast("string"), F.lit("null")), F.hex("key"))
    return rows.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        own("page_id").alias("record_id"),
        F.col("url").alias("target_uri"),
        F.when(revisit, own("first")).alias("refers_to"),
        base32_sha1(F.col("payload")).alias("payload_digest"),
        F.when(~revisit, F.col("payload")).alias("payload"),
        F.map_filter(F.create_map(
            F.lit("X-Page-Id"), F.col("page_id").cast("string"),
            F.lit("X-Payload-Length"), F.col("bytes").cast("string"),
        ), lambda k, v: v.isNotNull()).alias("extra"),
    )


def page_archive(spark: SparkSession, path: str) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` (a page id) of every record below ``path``.

    Payloads are decoded for responses only, and their digests computed anew; revisits take theirs from the response
    they name. A revisit whose response is missing keeps the figures of its own header.
    """
    page = lambda c: F.col(c)["x-page-id"].cast("long")
    responses = read_warc(spark, path, "response").where("record_type = 'response'").select(
        "record_id", page("headers").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"),
        base32_sha1(F.col("payload")).alias("payload_digest"),
    )
    revisits = read_warc(spark, path, "none").where("record_type = 'revisit'").select(
        "refers_to", page("headers").alias("page_id"), F.col("headers")["x-payload-length"].cast("long").alias("n"),
        F.expr("substring(payload_digest, 6)").alias("d"),
    )
    named = responses.dropDuplicates(["record_id"]).select(
        F.col("record_id").alias("refers_to"), F.col("page_id").alias("first"), "payload_bytes", "payload_digest")
    again = revisits.join(named, "refers_to", "left").select(
        "page_id", F.coalesce("payload_bytes", "n").alias("payload_bytes"), F.coalesce("payload_digest", "d").alias("payload_digest"),
        F.lit("revisit").alias("record_type"), F.col("first").alias("refers_to"))
    return responses.select(
        "page_id", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to")
    ).unionByName(again)
