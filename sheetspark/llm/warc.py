"""WARC archives as a Spark data source, reader and writer.

Reading: file partitions are planned on the driver (byte ranges, where the writer left an index). Each record's
header is parsed first; predicates on the record type and other header columns that Spark pushes down are tested on
it, and an unwanted record is skipped without decoding: its gzip member carries its own length in an extra field
(without that field the rest of the member is run through and dropped). With option payload=false no payload is
decoded at all.

Writing: every record is a gzip member; a task writes a file of its own name, and only the files of tasks that Spark
accepted enter the manifest, so lost or repeated tasks leave nothing that a reader sees.

Paths are folders or files of any file system that pyarrow or a plain local path can open.

Defined results of `archive_pages`: null html is an empty payload; a null url is written as an empty target; equal
rows are records of their own; every row that carries the largest page_id of a payload is a response; rows with a
null page_id revisit it, and are responses where no row of that payload has an id. Very large payloads are held whole,
one at a time, by the task that writes or reads them. Other columns are not read. An empty table gives an empty archive.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage

from .common import new_folder

REVISIT_BYTES = 1000
#: Least bytes between two places where reading may start; bytes of payloads in one batch.
RANGE, BATCH = 8 << 20, 4 << 20
#: Partitions of one read; ranges of an archive grow with it beyond RANGE times as many.
PARTITIONS = 50_000
#: Parts of a payload's rows in the join with payloads seen twice: no task meets all copies of one page.
SALTS = 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ_SCHEMA = "record_id string, record_type string, target_uri string, date string, payload_digest string, refers_to string, content_type string, declared_bytes long, payload_bytes long, payload_sha1 string, payload binary"
WRITE_SCHEMA = "record_id string, record_type string, target_uri string, date string, payload_digest string, refers_to string, payload_bytes long, payload binary"
#: Columns that come from the header alone, by header name.
HEADER = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "date": "warc-date", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to", "content_type": "content-type"}


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def bare_digest(value: str | None) -> str | None:
    """A digest header as lower-case hex without its algorithm; base-32 is decoded."""
    if not value:
        return None
    text = value.partition(":")[2] or value
    if len(text) == 32:
        return base64.b32decode(text.upper()).hex()
    return text.lower()


def member(data: bytes) -> bytes:
    """A gzip member whose extra field SL holds its own length and that of its content."""
    packer = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    size = 10 + 2 + 12 + len(body) + 8
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"SL", 8, size, len(data) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def _line(value: str | None) -> str:
    return " ".join((value or "").split("\n")).replace("\r", " ").strip()


def record(kind: str, record_id: str, uri: str | None, date: str, digest: str, refers_to: str | None, size: int, payload: bytes) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}", f"WARC-Target-URI: {_line(uri)}", f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class _Member:
    """Bytes of one gzip member, decoded only as far as they are asked for."""

    def __init__(self, source, start: int):
        self.source, self.start = source, start
        self.length = None
        source.seek(start)
        head = source.read(12)
        if head[3:4] == b"\x04" and len(head) == 12:
            extra = source.read(int.from_bytes(head[10:12], "little"))
            if extra[:2] == b"SL" and len(extra) >= 12:
                self.length = int.from_bytes(extra[4:8], "little")
        source.seek(start)
        self.inflate, self.data = zlib.decompressobj(31), bytearray()

    def more(self, least: int) -> bool:
        got = False
        while not got and not self.inflate.eof:
            raw = self.inflate.unconsumed_tail or self.source.read(1 << 16)
            if not raw:
                return False
            out = self.inflate.decompress(raw, max(least, 1 << 12))
            self.data += out
            got = bool(out)
        return got

    def skip(self) -> int:
        """Where the next member starts."""
        if self.length:
            return self.start + self.length
        while not self.inflate.eof:
            raw = self.inflate.unconsumed_tail or self.source.read(1 << 16)
            if not raw:
                return self.source.tell()
            self.inflate.decompress(raw, 1 << 20)
        return self.source.tell() - len(self.inflate.unused_data)


class _Plain:
    """The same for a record that is not compressed."""

    def __init__(self, source, start: int):
        self.source, self.start, self.data = source, start, bytearray()
        self.total = 0
        source.seek(start)

    def more(self, least: int) -> bool:
        out = self.source.read(max(least, 1 << 12))
        self.data += out
        return bool(out)

    def skip(self) -> int:
        return self.start + self.total


def _headers(text: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    last = ""
    for line in text.split(b"\r\n")[1:]:
        if line[:1] in (b" ", b"\t") and last:
            out[last] += " " + line.strip().decode("utf-8", "replace")
            continue
        name, _, value = line.partition(b":")
        last = name.strip().decode("latin-1").lower()
        out[last] = value.strip().decode("utf-8", "replace")
    return out


def records(source, start: int, end: int, wanted, payload: bool) -> Iterator[dict]:
    """Records that begin in [start, end) and whose header satisfies wanted."""
    at = start
    while at < end:
        source.seek(at)
        magic = source.read(2)
        if not magic:
            return
        if magic != b"\x1f\x8b" and magic.isspace():
            at += 1 if magic[1:] not in b"\r\n\0" else 2
            continue
        part = _Member(source, at) if magic == b"\x1f\x8b" else _Plain(source, at)
        while b"\r\n\r\n" not in part.data:
            if not part.more(1 << 12):
                break
        head, found, rest = part.data.partition(b"\r\n\r\n")
        if not found:
            at = max(part.skip(), at + 1) if isinstance(part, _Member) else end
            continue
        fields = _headers(head)
        length = int(fields.get("content-length", 0) or 0)
        if isinstance(part, _Plain):
            part.total = len(head) + 4 + length
        row = {column: fields.get(name) for column, name in HEADER.items()}
        for column in ("record_id", "refers_to"):
            row[column] = row[column].strip("<>") if row[column] else None
        if not wanted(row):
            at = part.skip()
            continue
        http = "application/http" in (row["content_type"] or "")
        base = len(head) + 4
        while len(part.data) - base < length and (payload or http and b"\r\n\r\n" not in part.data[base:]):
            if not part.more(length - (len(part.data) - base) + 4 if payload else 1 << 12):
                break
        block = bytes(memoryview(part.data)[base : base + length])
        row["declared_bytes"] = length
        if http:
            own, _, block = block.partition(b"\r\n\r\n")
            row["declared_bytes"] = int(_headers(own).get("content-length", 0) or 0)
        row["payload_digest"] = bare_digest(row["payload_digest"])
        row["payload"], row["payload_bytes"], row["payload_sha1"] = (block, len(block), hashlib.sha1(block).hexdigest()) if payload and row["record_type"] != "revisit" else (None, None, None)
        yield row
        at = part.skip()


def _ranges(cuts: list[int], least: int) -> Iterator[tuple[int, int]]:
    """Neighbouring cuts joined until they are the least number of bytes apart."""
    start = cuts[0]
    for at in cuts[1:]:
        if at - start >= least or at == cuts[-1]:
            yield start, at
            start = at


@dataclass
class Range(InputPartition):
    file: str
    start: int
    end: int


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() != "false"
        self.equal: dict[str, set] = {}

    def pushFilters(self, filters):
        """Equality and membership on header columns are tested here for good; the rest stays with Spark."""
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if values is not None and column in HEADER and column != "payload_digest":
                self.equal[column] = self.equal[column] & values if column in self.equal else values
            else:
                yield f

    def partitions(self):
        store, path = _open(self.path)
        info = store.get_file_info(path)
        if info.type == pafs.FileType.File:
            return [Range(path, 0, info.size)]
        manifest = f"{path}/_MANIFEST"
        if store.get_file_info(manifest).type == pafs.FileType.File:
            with store.open_input_stream(manifest) as f:
                listed = [json.loads(x) for x in f.read().decode().splitlines()]
            least = max(RANGE, sum(x["cuts"][-1] for x in listed) // PARTITIONS)
            return [Range(f"{path}/{x['file']}", a, b) for x in listed for a, b in _ranges(x["cuts"], least)]
        files = store.get_file_info(pafs.FileSelector(path, recursive=True))
        return [Range(f.path, 0, f.size) for f in files if f.type == pafs.FileType.File and f.path.endswith((".warc", ".warc.gz"))]

    def read(self, partition):
        if partition is None:
            return
        store, _ = _open(self.path)
        kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
        fields = pa.schema([(name, kinds[kind]) for name, kind in map(str.split, READ_SCHEMA.split(", "))])
        wanted = lambda row: all(row[c] in values for c, values in self.equal.items())
        rows, size = [], 0
        with store.open_input_file(partition.file) as source:
            for row in records(source, partition.start, partition.end, wanted, self.payload):
                rows.append(row)
                size += (row["payload_bytes"] or 0) + 500
                if size >= BATCH:
                    yield pa.RecordBatch.from_pylist(rows, schema=fields)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=fields)


@dataclass
class Wrote(WriterCommitMessage):
    file: str
    cuts: list


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options):
        self.path = options["path"]

    def write(self, iterator):
        store, path = _open(self.path)
        store.create_dir(path, recursive=True)
        name = f"part-{uuid.uuid4().hex}.warc.gz"
        at, cuts = 0, [0]
        with store.open_output_stream(f"{path}/{name}", compression=None) as out:
            for batch in iterator:
                for row in batch.to_pylist():
                    data = member(record(row["record_type"], row["record_id"], row["target_uri"], row["date"], row["payload_digest"], row["refers_to"], row["payload_bytes"], row["payload"] or b""))
                    out.write(data)
                    at += len(data)
                    if at - cuts[-1] >= RANGE:
                        cuts.append(at)
        if cuts[-1] < at:
            cuts.append(at)
        return Wrote(name, cuts)

    def commit(self, messages):
        store, path = _open(self.path)
        store.create_dir(path, recursive=True)
        lines = [json.dumps({"file": m.file, "cuts": m.cuts}) for m in messages if m is not None and len(m.cuts) > 1]
        with store.open_output_stream(f"{path}/_MANIFEST", compression=None) as out:
            out.write("\n".join(sorted(lines)).encode())

    def abort(self, messages):
        store, path = _open(self.path)
        for m in messages:
            if m is not None:
                store.delete_file(f"{path}/{m.file}")


class WarcSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return READ_SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def page_records(pages: DataFrame, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """A record for each page: response, or revisit of the response with the same payload."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").alias("id"), F.col("url").cast("string").alias("target_uri"), payload.alias("html"))
    rows = rows.withColumns({"digest": F.sha1("html"), "payload_bytes": F.octet_length("html").cast("long")})
    narrow = rows.where(F.col("payload_bytes") >= REVISIT_BYTES).select("id", "digest")
    groups = narrow.groupBy("digest").agg(F.max("id").alias("keeper"), F.count(F.lit(1)).alias("n")).where("n > 1 and keeper is not null").drop("n")
    groups = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    narrow = narrow.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    again = narrow.join(groups, ["digest", "salt"]).where(~F.col("id").eqNullSafe(F.col("keeper"))).select(F.col("id").alias("rid"), F.col("digest").alias("rdigest"), "keeper").distinct()
    rows = rows.join(again, F.col("id").eqNullSafe(F.col("rid")) & (F.col("digest") == F.col("rdigest")), "left")
    urn = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.lit("")))
    revisit = F.col("rdigest").isNotNull()
    return rows.select(
        urn(F.col("id")).alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        "target_uri",
        F.lit(date).alias("date"),
        F.col("digest").alias("payload_digest"),
        F.when(revisit, urn(F.col("keeper"))).alias("refers_to"),
        "payload_bytes",
        F.when(~revisit, F.col("html").cast("binary")).alias("payload"),
    )


def archive_pages(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Writes the pages' records as an archive and reads it back: one row a page, from the archive alone."""
    spark = pages.sparkSession
    register(spark)
    path = path or new_folder(spark, "warc")
    page_records(pages).write.format("warc").mode("append").save(path)
    back = read_warc(spark, path).where(F.col("record_type").isin("response", "revisit"))
    page = lambda c: F.regexp_extract(c, r"^urn:page:(-?\d+)$", 1).try_cast("long")
    revisit = F.col("record_type") == "revisit"
    return back.select(
        page(F.col("record_id")).alias("page_id"),
        F.when(revisit, F.col("declared_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("payload_digest")).otherwise(F.col("payload_sha1")).alias("payload_digest"),
        "record_type",
        page(F.col("refers_to")).alias("refers_to"),
        "target_uri",
    )


ARCHIVE_SQL = f"""
WITH p AS (
  SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, strlen(coalesce(html, ''))::BIGINT AS n, sha1(coalesce(html, '')) AS digest FROM pages
), k AS (SELECT digest, max(page_id) AS keeper FROM p WHERE n >= {REVISIT_BYTES} GROUP BY digest)
SELECT p.page_id, n AS payload_bytes, p.digest AS payload_digest,
       CASE WHEN k.keeper IS NOT NULL AND p.page_id IS DISTINCT FROM k.keeper THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN k.keeper IS NOT NULL AND p.page_id IS DISTINCT FROM k.keeper THEN k.keeper END AS refers_to,
       trim(url) AS target_uri
FROM p LEFT JOIN k ON p.digest = k.digest AND p.n >= {REVISIT_BYTES}
"""
