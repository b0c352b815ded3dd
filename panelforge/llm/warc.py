"""WARC (6): a Python data source that reads and writes WARC archives.

Writing: one gzip member a record, with the ``sl`` extra field (compressed and plain length), so that a reader can step
over a record without inflating it. Every task writes files of its own name; each commit writes a manifest of its own, and
readers trust only files in the manifests, so tasks that were lost or ran twice leave no records and a later write adds to
the earlier ones (mode "overwrite" replaces them once its own manifest is there). Reading: one partition for each file of
the manifest (small files share one); record-type and header filters are pushed down and tested on the header block
alone, before a payload is inflated.

``archive`` decides response or revisit: of equal payloads the smallest page_id is the response. Defined results: null
html is an empty payload; null url is left out; a null page_id comes after all others. Fully repeated rows (same page_id,
same payload) are all responses when they hold the smallest id. Columns besides page_id, url, html are not archived.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, WriterCommitMessage

from panelforge.llm.common import Scratch, checked_broadcast, salt_of, ship

FILE_BYTES = 64 << 20
LEVEL = 4
MANIFEST = "_manifest-"
MIN_DEDUP_BYTES = 0
SCHEMA = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ATTRIBUTES = {"record_type": "warc-type", "page_id": "x-page-id", "url": "warc-target-uri", "payload_digest": "warc-payload-digest", "refers_to": "x-refers-to"}


def filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id) -> str:
    """A response's id follows from its page_id, so that revisits can name it; others are random."""
    return f"<urn:uuid:{uuid.uuid4() if page_id is None else uuid.uuid5(uuid.NAMESPACE_OID, str(page_id))}>"


def record(page_id, url, payload: bytes, refers_to, revisit: bool) -> bytes:
    """One record, not compressed."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(None if revisit else page_id)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
        head.append("WARC-Target-URI: " + uri)
        if uri != url:
            head.append("X-Given-URL: " + json.dumps(url))
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}"] + [f"X-Refers-To: {refers_to}", f"WARC-Refers-To: {record_id(refers_to)}"] * (refers_to is not None)
    head += [f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}", f"X-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = LEVEL) -> bytes:
    """A gzip member whose extra field sl says how long it is."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    n = 10 + 2 + 12 + len(body) + 8
    return b"\x1f\x8b\x08\x04" + b"\0" * 5 + b"\xff" + struct.pack("<H2sHII", 12, b"sl", 8, n, len(data) & 0xFFFFFFFF) + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def manifests(fs, root: str) -> list[str]:
    from pyarrow.fs import FileSelector

    return sorted(f.path for f in fs.get_file_info(FileSelector(root)) if f.base_name.startswith(MANIFEST))


def named(fs, manifest: str) -> list:
    """The [name, bytes] pairs of a manifest."""
    with fs.open_input_stream(manifest, compression=None) as f:
        return json.loads(f.read())


@dataclass
class Written(WriterCommitMessage):
    files: list


@dataclass
class Files(InputPartition):
    files: list


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool = False):
        self.path, self.overwrite = path, overwrite

    def write(self, iterator) -> Written:
        fs, root = filesystem(self.path)
        fs.create_dir(root, recursive=True)
        files, out, size = [], None, 0
        for batch in iterator:
            columns = [batch.column(batch.schema.get_field_index(c)) for c in ("page_id", "url", "html", "refers_to", "revisit")]
            for page_id, url, html, refers_to, revisit in zip(*columns, strict=True):
                if out is None:
                    files.append([f"{uuid.uuid4().hex}.warc.gz", 0])
                    out, size = fs.open_output_stream(f"{root}/{files[-1][0]}", compression=None), 0
                text = html.as_py()
                data = member(record(page_id.as_py(), url.as_py(), (text or "").encode(), refers_to.as_py(), bool(revisit.as_py())))
                out.write(data)
                size += len(data)
                files[-1][1] = size
                if size >= FILE_BYTES:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages) -> None:
        fs, root = filesystem(self.path)
        fs.create_dir(root, recursive=True)
        before = manifests(fs, root) if self.overwrite else []
        name = f"{MANIFEST}{uuid.uuid4().hex}.json"
        with fs.open_output_stream(f"{root}/.{name}", compression=None) as out:
            out.write(json.dumps([f for m in messages if m for f in m.files]).encode())
        fs.move(f"{root}/.{name}", f"{root}/{name}")
        for old in before:
            files = named(fs, old)
            fs.delete_file(old)
            for gone, _ in files:
                fs.delete_file(f"{root}/{gone}")

    def abort(self, messages) -> None:
        fs, root = filesystem(self.path)
        for m in messages:
            for name, _ in m.files if m else []:
                fs.delete_file(f"{root}/{name}")


def records(stream, wanted):
    """(header, payload block reader) of each record of an open file; unwanted ones are stepped over.

    wanted(header) is asked once the header block is inflated; the rest is inflated only when it says yes.
    """
    buffer, at, base = b"", 0, 0

    def fill(n: int) -> bool:
        nonlocal buffer, at, base
        while len(buffer) - at < n:
            more = stream.read(max(1 << 20, n - len(buffer) + at))
            if not more:
                return False
            base += at
            buffer, at = buffer[at:] + more, 0
        return True

    while fill(18):
        if buffer[at : at + 2] != b"\x1f\x8b":
            raise ValueError("not a gzip member")
        length = None
        if buffer[at + 3] & 4:
            n = struct.unpack_from("<H", buffer, at + 10)[0]
            fill(12 + n)
            extra = buffer[at + 12 : at + 12 + n]
            while len(extra) >= 4:
                k = struct.unpack_from("<H", extra, 2)[0]
                if extra[:2] == b"sl" and k == 8:
                    length = struct.unpack_from("<I", extra, 4)[0]
                extra = extra[4 + k :]
        z = zlib.decompressobj(31)
        data, fed = b"", 0
        while b"\r\n\r\n" not in data and not z.eof:
            piece = z.unconsumed_tail or buffer[at + fed : at + (min(fed + 65536, length) if length else fed + 65536)]
            if not z.unconsumed_tail:
                if not piece:
                    if not fill(fed + 1):
                        raise ValueError("a record is cut short")
                    continue
                fed += len(piece)
            data += z.decompress(piece, 2048)
        head, _, rest = data.partition(b"\r\n\r\n")
        header = {}
        for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            header[name.strip().lower()] = value.strip()
        take = wanted(header)
        if take or not length:
            parts = [rest]
            while not z.eof:
                piece = z.unconsumed_tail
                if not piece:
                    piece = buffer[at + fed : at + (length if length else fed + 65536)]
                    if not piece:
                        if not fill(fed + 1):
                            raise ValueError("a record is cut short")
                        continue
                    fed += len(piece)
                parts.append(z.decompress(piece))
            if take:
                yield header, b"".join(parts)[: int(header["content-length"])]
            at += fed - len(z.unused_data)
        else:
            ahead = at + length - len(buffer)
            if ahead > 0 and stream.seekable():
                stream.seek(base + at + length)
                base, buffer, at = base + at + length, b"", 0
            elif not fill(length):
                raise ValueError("a record is cut short")
            else:
                at += length


def url_of(header: dict) -> str | None:
    """The url as it was given: a WARC field cannot hold white space."""
    return json.loads(header["x-given-url"]) if "x-given-url" in header else header.get("warc-target-uri")


class HeaderReader(DataSourceReader):
    """Reads the records that the read's own predicates (option ``only``: column to values) leave."""

    def __init__(self, options):
        self.path = options["path"]
        self.payload = options.get("payload", "full")
        self.tests: list = [(_ATTRIBUTES[c], {str(v) for v in values}) for c, values in json.loads(options.get("only", "{}")).items()]

    def partitions(self):
        fs, root = filesystem(self.path)
        files = [f for m in manifests(fs, root) for f in named(fs, m)]
        packed, size = [], FILE_BYTES
        for name, n in sorted(files, key=lambda x: -x[1]):
            if size + n > FILE_BYTES // 8:
                packed.append([])
                size = 0
            packed[-1].append(name)
            size += n
        return [Files(p) for p in packed] or [Files([])]

    def wanted(self, header) -> bool:
        for name, values in self.tests:
            got = url_of(header) if name == "warc-target-uri" else header.get(name)
            if name == "warc-payload-digest" and got:
                got = got.removeprefix("sha1:")
            if got is None or values is not None and got not in values:
                return False
        return True

    def read(self, partition):
        fs, root = filesystem(self.path)
        rows: list = []
        size = 0
        for name in partition.files:
            with fs.open_input_file(f"{root}/{name}") as stream:
                for header, block in records(stream, self.wanted):
                    rows.append(self.row(header, block))
                    size += len(block)
                    if len(rows) >= 2000 or size >= 8 << 20:
                        yield batch_of(rows)
                        rows, size = [], 0
        if rows:
            yield batch_of(rows)

    def row(self, header, block):
        number = lambda name: int(header[name]) if name in header else None
        revisit = header["warc-type"] == "revisit"
        payload = None if revisit else block.partition(b"\r\n\r\n")[2]
        digest, n = header.get("warc-payload-digest", "").removeprefix("sha1:"), number("x-payload-length")
        if payload is not None and self.payload != "skip":
            digest, n = sha1_base32(payload), len(payload)
        return (number("x-page-id"), url_of(header), header["warc-type"], number("x-refers-to"), digest, n, payload if self.payload == "full" else None)


def batch_of(rows: list) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


class WarcReader(HeaderReader):
    """Takes Spark's filters as well. The frame of such a read must be used once: it keeps the filters of the use that was planned last."""

    def pushFilters(self, filters):
        for f in filters:
            name = _ATTRIBUTES.get(f.attribute[0]) if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if name and isinstance(f, EqualTo):
                self.tests.append((name, {str(f.value)}))
            elif name and isinstance(f, In):
                self.tests.append((name, {str(v) for v in f.value}))
            elif name and isinstance(f, IsNotNull):
                self.tests.append((name, None))
            yield f  # Spark checks again: a header may hold more than the column


class WarcSource(DataSource):
    """format("warc"): options path, payload (full; verify: inflate and check, return none; skip: headers only), only (a JSON object of
    column to values: record_type, page_id, url, payload_digest, refers_to) and pushdown (spark: Spark's filters too, for one use)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> HeaderReader:
        return (WarcReader if self.options.get("pushdown") == "spark" else HeaderReader)(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(WarcSource)


def plan(pages: DataFrame, least: int = MIN_DEDUP_BYTES) -> DataFrame:
    """page_id, url, html, refers_to, revisit. Digests are counted by (digest, salt), so a common payload meets in no one task."""
    html = F.coalesce("html", F.lit(""))
    digest = F.unhex(F.sha1(F.encode(html, "utf-8")))
    ids = pages.select(F.col("page_id").cast("long").alias("page_id"), digest.alias("digest")).where(F.octet_length(html) >= least)
    part = ids.groupBy("digest", salt_of("page_id").alias("salt")).agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    shared = part.groupBy("digest").agg(F.min("first").alias("first"), F.sum("n").alias("n")).where("n > 1").select("digest", "first")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", digest.alias("digest"))
    if shared.limit(500_001).count() <= 500_000:
        rows = rows.join(F.broadcast(shared), "digest", "left")
    else:
        salted = shared.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(63))))
        rows = rows.withColumn("salt", salt_of("page_id")).join(salted, ["digest", "salt"], "left")
    big = F.octet_length(html) >= least
    revisit = big & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.select("page_id", "url", "html", F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit"))


def write(pages: DataFrame, path: str, least: int = MIN_DEDUP_BYTES) -> None:
    register(pages.sparkSession)
    plan(pages, least).write.format("warc").mode("append").save(path)


def read(spark: SparkSession, path: str, payload: str = "full", only: dict[str, list] | None = None, pushdown: bool = False) -> DataFrame:
    """The archive's records. only (column to values) is judged on the headers: payloads of other records are stepped over.

    pushdown lets Spark hand its own filters to the source as well. Such a frame is for one use in one plan: Spark keeps one reader a
    frame, so of two uses with different filters one would get the other's rows. Without it a frame can be used in any way.
    """
    register(spark)
    options = {"payload": payload, "only": json.dumps(only or {})}
    if pushdown:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
        options["pushdown"] = "spark"
    return spark.read.format("warc").options(**options).load(path)


def op6_warc(spark, sf_dir: str) -> DataFrame:
    """Archives written, then read twice: responses with their payloads, revisits by their headers alone. Both tests are pushed down."""
    path = Scratch(spark).path("warc")
    write(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    found = read(spark, path, "verify", pushdown=True).where("record_type = 'response'").union(read(spark, path, "skip", pushdown=True).where("record_type = 'revisit'"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
with p as (select page_id, coalesce(html, '') as html from pages), f as (select html, min(page_id) as first from p group by html),
d as (select p.page_id, p.html, f.first, array_to_string(list_transform(string_split(sha1(p.html), ''), lambda c: printf('%04b', strpos('0123456789abcdef', c) - 1)), '') as bits from p join f on f.html = p.html)
select page_id, octet_length(encode(html)) as payload_bytes,
  array_to_string(list_transform(range(0, 160, 5), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * cast(bits[i + 1] as integer) + 8 * cast(bits[i + 2] as integer) + 4 * cast(bits[i + 3] as integer) + 2 * cast(bits[i + 4] as integer) + cast(bits[i + 5] as integer), 1)), '') as payload_digest,
  case when page_id = first then 'response' else 'revisit' end as record_type, case when page_id <> first then first end as refers_to
from d
"""
