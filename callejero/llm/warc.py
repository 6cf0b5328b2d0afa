"""WARC archives as a PySpark Python data source.

``df.write.format("warc")`` writes one gzip member per record; each member's header carries its
length (the "sl" field of the gzip extra area), and a commit writes a manifest of the finished
files, so files of failed or repeated tasks are never read. ``spark.read.format("warc")`` plans
one partition per file, or per ``split_bytes`` of a file's records. Predicates on the record type
and on header columns are pushed down: a WARC header is parsed first, and the payload of an
unwanted record is skipped (by the member's length where that is known, by seeking in a plain
``.warc``, else by inflating past it in small pieces). With ``payload`` set to "false" no payload
is decoded at all. Archives from elsewhere may be plain or hold many records in a member; such a
file is one partition.

Paths are opened through ``pyarrow.fs``, so any store that it knows will do.

Payloads of unique pages never move before they are written. Only digests are grouped; those that
repeat mark a bitmap of fixed size, and pages that hit it are looked up: a page known to be a
revisit is written without its payload, the others meet the revisits' keys in a join by digest
and page, so one page of many copies is no hot key.

Defined cases for ``archive``: a null html is an empty payload; a null url is left out; rows with
a null page_id sort last among equals; rows that share the smallest page_id of equal payloads are
all responses; line breaks in header values become spaces; other columns are ignored. For reading:
a number that cannot be read is null; a record without a usable Content-Length reaches to the end
of its member or file; fields that are no column are ignored.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, In, InputPartition, IsNotNull, IsNull, StringStartsWith, WriterCommitMessage

from .common import fresh_path, stored

SCHEMA = "record_id string, record_type string, page_id long, target_uri string, content_type string, payload_digest string, payload_bytes long, refers_to string, payload binary"
#: Column and WARC header field.
FIELDS = {
    "record_id": "WARC-Record-ID", "record_type": "WARC-Type", "page_id": "X-Page-ID", "target_uri": "WARC-Target-URI", "content_type": "Content-Type",
    "payload_digest": "WARC-Payload-Digest", "payload_bytes": "X-Payload-Length", "refers_to": "WARC-Refers-To",
}
NUMBERS = {"page_id", "payload_bytes"}
MANIFEST = "_manifest.json"
LISTS = re.compile(r"_manifest(-[0-9a-f]{32})?\.json")
PART = re.compile(r"part-[0-9a-f]{32}\.warc\.gz")
#: Payloads of fewer bytes are never revisits.
LEAST = 100
HEAD, CHUNK = 4096, 1 << 16
#: Parts of 32,768 bits in the bitmap of repeated digests (16 MB in all).
BITMAP_PARTS = 4096


def store(path: str):
    """The file system and inner path of a path or URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


def member(header: bytes, payload: bytes) -> bytes:
    """A gzip member of one record; its extra area holds the member's length and the raw length."""
    raw = header + payload + b"\r\n\r\n"
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    # The header is flushed on its own, so it can be read without the payload's bytes.
    body = deflate.compress(header) + deflate.flush(zlib.Z_SYNC_FLUSH) + deflate.compress(raw[len(header) :]) + deflate.flush()
    size = 10 + 2 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, size, len(raw) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04" + bytes(4) + b"\x00\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)


def record(row: dict) -> bytes:
    payload = row.get("payload") or b""
    lines = [b"WARC/1.1"]
    for column, field in FIELDS.items():
        if row.get(column) is not None:
            lines.append(f"{field}: {' '.join(str(row[column]).splitlines())}".encode())
    if row.get("record_type") == "revisit":
        lines.append(b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    lines += [b"WARC-Date: 1970-01-01T00:00:00Z", b"Content-Length: %d" % len(payload)]
    return member(b"\r\n".join(lines) + b"\r\n\r\n", payload)


def list_folder(filesystem, inner: str) -> list:
    from pyarrow import fs

    return filesystem.get_file_info(fs.FileSelector(inner, recursive=False))


@dataclass
class Written(WriterCommitMessage):
    file: str
    #: Offset of every so many records, and the file's length.
    marks: list[int]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, every: int, overwrite: bool = False) -> None:
        self.path, self.every, self.overwrite = path, every, overwrite

    def write(self, iterator) -> Written:
        filesystem, inner = store(self.path)
        filesystem.create_dir(inner, recursive=True)
        name, marks = f"part-{uuid.uuid4().hex}.warc.gz", []
        with filesystem.open_output_stream(f"{inner}/{name}", compression=None) as out:
            i = 0
            for batch in iterator:
                for values in zip(*(c.to_pylist() for c in batch.columns)):
                    if i % self.every == 0:
                        marks.append(out.tell())
                    out.write(record(dict(zip(batch.schema.names, values))))
                    i += 1
            marks.append(out.tell())
        return Written(name, marks)

    def commit(self, messages) -> None:
        filesystem, inner = store(self.path)
        filesystem.create_dir(inner, recursive=True)
        old = list_folder(filesystem, inner) if self.overwrite else []
        # One manifest a commit, so that an append leaves the earlier ones as they are.
        with filesystem.open_output_stream(f"{inner}/{MANIFEST.replace('.', f'-{uuid.uuid4().hex}.')}", compression=None) as out:
            out.write(json.dumps([[m.file, m.marks] for m in messages if m]).encode())
        done = {m.file for m in messages if m}
        for x in old:
            if x.base_name not in done and (LISTS.fullmatch(x.base_name) or x.base_name.endswith((".warc.gz", ".warc"))):
                filesystem.delete_file(x.path)

    def abort(self, messages) -> None:
        filesystem, inner = store(self.path)
        for m in messages:
            if m:
                filesystem.delete_file(f"{inner}/{m.file}")


@dataclass
class Span(InputPartition):
    file: str
    start: int
    end: int


def wanted(filters: list, row: dict) -> bool:
    for f in filters:
        value = row.get(f.attribute[0])
        if isinstance(f, EqualTo):
            ok = value is not None and value == f.value
        elif isinstance(f, EqualNullSafe):
            ok = value == f.value
        elif isinstance(f, In):
            ok = value is not None and value in f.value
        elif isinstance(f, IsNotNull):
            ok = value is not None
        elif isinstance(f, IsNull):
            ok = value is None
        else:
            ok = value is not None and value.startswith(f.value)
        if not ok:
            return False
    return True


def number(text: str | None) -> int | None:
    return int(text) if text is not None and re.fullmatch(r"[+-]?[0-9]{1,18}", text) else None


class Content:
    """The bytes of a gzip member, or of a plain file, from a place on."""

    def __init__(self, f, at: int, packed: bool) -> None:
        f.seek(at)
        self.f, self.inflate, self.ready = f, zlib.decompressobj(31) if packed else None, b""

    def more(self, size: int = CHUNK) -> bool:
        while self.inflate is None or not self.inflate.eof:
            chunk = self.f.read(size)
            if not chunk:
                return False
            if self.inflate:
                chunk = self.inflate.decompress(chunk)
            if chunk:
                self.ready += chunk
                return True
        return False

    def header(self) -> dict[str, str] | None:
        """The next record's fields by lower-case name; None where no record follows."""
        self.ready = self.ready.lstrip(b"\r\n")
        while not self.ready or b"\r\n\r\n" not in self.ready:
            if not self.more(HEAD):
                if self.ready.strip(b"\r\n"):
                    raise ValueError("a record's header does not end")
                return None
            self.ready = self.ready.lstrip(b"\r\n")
        head, _, self.ready = self.ready.partition(b"\r\n\r\n")
        return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])}

    def take(self, size: int | None) -> bytes:
        """The next ``size`` bytes, or all that are left."""
        pieces, held = [self.ready], len(self.ready)
        self.ready = b""
        while (size is None or held < size) and self.more():
            pieces.append(self.ready)
            held += len(self.ready)
            self.ready = b""
        out = b"".join(pieces)
        if size is not None:
            if held < size:
                raise ValueError("a record ends early")
            out, self.ready = out[:size], out[size:]
        return out

    def skip(self, size: int | None) -> None:
        """As ``take``, without holding them; a plain file is not read."""
        if self.inflate is None and size is not None:
            self.f.seek(size - len(self.ready), 1)
            self.ready = b""
            return
        while size is None or size > len(self.ready):
            size = None if size is None else size - len(self.ready)
            self.ready = b""
            if not self.more():
                return
        self.ready = self.ready[size:]

    def end(self) -> int:
        """Where the member ends, once all of it has been inflated."""
        return self.f.tell() - len(self.inflate.unused_data)


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool, split: int) -> None:
        self.path, self.payload, self.split, self.filters = path, payload, split, []

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (EqualTo, EqualNullSafe, In, IsNotNull, IsNull, StringStartsWith)) and len(f.attribute) == 1 and f.attribute[0] in FIELDS:
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[Span]:
        filesystem, inner = store(self.path)
        spans = []
        chosen = list_folder(filesystem, inner)
        manifests = [x.base_name for x in chosen if LISTS.fullmatch(x.base_name)]
        files = []
        for name in manifests:
            with filesystem.open_input_stream(f"{inner}/{name}", compression=None) as f:
                files += json.loads(f.read())
        # Parts that no manifest names were never committed; archives from elsewhere have none.
        files += [[x.base_name, [0, x.size]] for x in chosen if x.base_name.endswith((".warc.gz", ".warc")) and not (manifests and PART.fullmatch(x.base_name))]
        for name, marks in files:
            start = marks[0]
            for a, b in zip(marks, marks[1:]):
                if b - start >= self.split or b == marks[-1]:
                    if b > start:
                        spans.append(Span(name, start, b))
                    start = b
        return spans or [Span("", 0, 0)]

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        filesystem, inner = store(self.path)
        schema = pa.schema([(c, pa.int64() if c in NUMBERS else pa.string()) for c in FIELDS] + [("payload", pa.binary())])
        rows, held = [], 0
        with filesystem.open_input_file(f"{inner}/{partition.file}") as f:
            for row in self.records(f, partition):
                rows.append(row)
                held += len(row["payload"] or b"")
                if held > 1 << 22 or len(rows) >= 2048:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    def records(self, f, span: Span) -> Iterator[dict]:
        """The span's records that the filters let through."""
        if span.file.endswith(".warc"):
            yield from self.of(Content(f, span.start, False))
            return
        at = span.start
        while at < span.end:
            f.seek(at)
            head = f.read(20)
            content = Content(f, at, True)
            if head[3:4] == b"\x04" and head[12:14] == b"sl":  # one record whose length is known
                at += struct.unpack_from("<I", head, 16)[0]
                yield from self.of(content, single=True)
            else:
                yield from self.of(content)
                at = content.end()

    def of(self, content: Content, single: bool = False) -> Iterator[dict]:
        while (fields := content.header()) is not None:
            row = {c: fields.get(name.lower()) for c, name in FIELDS.items()}
            for c in NUMBERS:
                row[c] = number(row[c])
            size = number(fields.get("content-length"))
            size = None if size is None or size < 0 else size
            if wanted(self.filters, row):
                if self.payload:
                    row["payload"] = content.take(size)
                elif not single:
                    content.skip(size)
                yield {"payload": None} | row
            elif not single:
                content.skip(size)
            if single:
                return


class WarcSource(DataSource):
    """Options: path; payload ("true"); split_bytes (for reading); mark_every (records, for writing)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("payload", "true").lower() != "false", int(self.options.get("split_bytes", 32 << 20)))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], int(self.options.get("mark_every", 1024)), overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def marked(digest: Column, bits: Column) -> Column:
    """Whether a digest's bit is set in its part of the bitmap."""
    place = F.pmod(F.xxhash64(digest), F.lit(BITMAP_PARTS * 32768)) % 32768
    byte = F.conv(F.hex(F.substring(bits, F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, (place % 8).cast("int")) == 1


def as_records(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """A WARC record per page. Equal payloads of ``least`` bytes or more: the smallest page_id responds, the others revisit it."""
    html = F.coalesce(F.col("html"), F.lit(""))
    bare = pages.select("page_id", F.col("url").alias("target_uri"), F.encode(html, "UTF-8").alias("payload"))
    bare = bare.select("page_id", "target_uri", "payload", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("digest"))
    big = F.col("payload_bytes") >= least
    several = (F.max("page_id") > F.min("page_id")) | (F.count("page_id") < F.count("*"))
    groups = bare.where(big).groupBy("digest").agg(F.min("page_id").alias("first_id"), several.alias("several"))
    # Copies that all lack an id, or share one, respond each for itself.
    first = stored(groups.where("first_id IS NOT NULL AND several").drop("several"), "warc-first")

    place = F.pmod(F.xxhash64("digest"), F.lit(BITMAP_PARTS * 32768))
    bitmap = first.groupBy(F.floor(place / 32768).alias("part")).agg(F.expr(f"bitmap_construct_agg(pmod(xxhash64(digest), {BITMAP_PARTS * 32768}) % 32768)").alias("bits"))
    looked = bare.withColumn("part", F.floor(place / 32768)).join(F.broadcast(bitmap), "part", "left")  # BITMAP_PARTS rows of 4 KB at most
    hit = F.coalesce(big & F.col("bits").isNotNull() & marked(F.col("digest"), F.col("bits")), F.lit(False))
    looked = looked.withColumn("hit", hit).drop("part", "bits")

    again = looked.where("hit").drop("payload").join(first, "digest").where(~F.col("page_id").eqNullSafe(F.col("first_id")))
    again = stored(again.select("page_id", "target_uri", "payload_bytes", "digest", "first_id"), "warc-again")
    keys = again.select(F.col("digest").alias("_d"), F.col("page_id").alias("_p")).distinct()
    alone = looked.where("NOT hit").drop("hit")
    others = looked.where("hit").drop("hit").join(keys, (F.col("digest") == F.col("_d")) & F.col("page_id").eqNullSafe(F.col("_p")), "left_anti")

    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))

    def records(d: DataFrame, kind: str, first_id: Column, payload: Column) -> DataFrame:
        return d.select(
            F.coalesce(urn(F.col("page_id")), F.lit("<urn:page:>")).alias("record_id"), F.lit(kind).alias("record_type"), "page_id", "target_uri",
            F.lit("text/html; charset=utf-8" if kind == "response" else None).cast("string").alias("content_type"), F.concat(F.lit("sha256:"), "digest").alias("payload_digest"),
            "payload_bytes", urn(first_id).alias("refers_to"), payload.alias("payload"),
        )

    none = F.lit(None)
    responses = [records(d, "response", none.cast("long"), F.col("payload")) for d in (alone, others)]
    return responses[0].unionByName(responses[1]).unionByName(records(again, "revisit", F.col("first_id"), none.cast("binary")))


def archive(pages: DataFrame, path: str) -> None:
    """Write the pages as WARC files under ``path``."""
    register(pages.sparkSession)
    as_records(pages).write.format("warc").option("path", path).mode("append").save()


def read_archive(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("path", path).option("payload", str(payload).lower()).load()


def page_records(pages: DataFrame) -> DataFrame:
    """Write the pages, read the archive back, and tell what it holds of each page.

    Digest and length of a response are those of the payload read; a revisit has them, of the
    full payload, in its header, so revisits are read by a predicate on the type and without payloads.
    """
    path = fresh_path(pages.sparkSession, "warc")
    archive(pages, path)
    spark = pages.sparkSession
    full = F.coalesce("payload", F.lit(b""))
    responses = read_archive(spark, path).where("record_type = 'response'")
    responses = responses.select("page_id", F.octet_length(full).cast("long").alias("payload_bytes"), F.sha2(full, 256).alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    revisits = read_archive(spark, path, payload=False).where("record_type = 'revisit'")
    first = F.regexp_extract("refers_to", r"page:(-?\d+)>", 1).try_cast("long").alias("refers_to")
    return responses.unionByName(revisits.select("page_id", "payload_bytes", F.substring("payload_digest", 8, 64).alias("payload_digest"), "record_type", first))
