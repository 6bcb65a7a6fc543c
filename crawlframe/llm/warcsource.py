"""WARC archives as a PySpark data source that reads headers first.

``format("warc_records")`` writes one gzip member per record and reads them back.
Records with equal payloads are kept once: the others are ``revisit`` records that
name the record they repeat.

Writing: the task compresses each record on its own and notes the member's
compressed size in its gzip header (the ``sl`` field of the WARC standard), one
set of shards per record type. Files are committed by manifests.

Reading: the driver plans file partitions from the manifests and drops tasks whose
record types are not asked for; a read task drops shards the same way. Of every
record the header is inflated first and held against the pushed predicates on
record type and header fields. A record that is not wanted, or whose payload is
not (option ``payload`` = ``false``), is stepped over by its noted size without
inflating the rest; in archives of other programs, which lack that size, the rest
is inflated block by block and dropped. Gzip shards with many records per member
and plain ``.warc`` files are read too.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    In,
    IsNotNull,
    IsNull,
    StringStartsWith,
)

from crawlframe.operators.skew import shuffle_width
from crawlframe.session import fresh_path, written
from crawlframe.sources import manifests

NAME = "warc_records"
BLOCK = 1 << 16
BATCH_ROWS = 2000
BATCH_BYTES = 8 << 20
LEAST_BYTES = 0
ID_PREFIX = "urn:page:"

# Field names, the profile and media types of the WARC 1.1 standard.
FIELDS = {
    "record_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "target_uri": "WARC-Target-URI",
    "warc_date": "WARC-Date",
    "payload_digest": "WARC-Payload-Digest",
    "refers_to": "WARC-Refers-To",
    "profile": "WARC-Profile",
}
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MEDIA_TYPE = "application/http; msgtype=response"
# A field of this package: the full payload's size, which a revisit does not show otherwise.
SIZE_FIELD = "X-Payload-Length"

WRITTEN = "record_type string, record_id string, target_uri string, warc_date string, payload_digest string, payload_length bigint, refers_to string, payload binary"
READ = WRITTEN.replace("payload binary", "content_length bigint, payload binary")
PUSHED = tuple(name for name in FIELDS if name != "profile")


def _field(value: str) -> str:
    """A header value on one line; line breaks, which no header can hold, become %0D and %0A."""
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record_bytes(row: dict) -> bytes:
    """One record: WARC header, HTTP header, and the payload unless it is a revisit."""
    revisit = row["record_type"] == "revisit"
    body = b"" if revisit else row["payload"] or b""
    size = len(body) if row["payload_length"] is None else row["payload_length"]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    head = ["WARC/1.1"]
    for name, title in FIELDS.items():
        value = (SAME_PAYLOAD if revisit else None) if name == "profile" else row[name]
        if value is not None:
            if name in ("record_id", "refers_to"):
                value = f"<{value}>"
            elif name == "payload_digest":
                value = f"sha1:{value}"
            head.append(f"{title}: {_field(value)}")
    head += [f"{SIZE_FIELD}: {size}", f"Content-Type: {MEDIA_TYPE}", f"Content-Length: {len(http) + len(body)}", "", ""]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + http + body + b"\r\n\r\n"


def member(record: bytes, level: int) -> bytes:
    """The record as a gzip member that notes its own compressed and plain size."""
    press = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = press.compress(record) + press.flush()
    tail = struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)
    size = 10 + 2 + 12 + len(body) + len(tail)
    if size >= 1 << 32 or len(record) >= 1 << 32:  # too large for the field
        return b"\x1f\x8b\x08\0\0\0\0\0\0\xff" + body + tail
    extra = struct.pack("<H2sHII", 12, b"sl", 8, size, len(record))
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + extra + body + tail


class WarcRecords(DataSource):
    """Options. Write: ``shard_bytes`` (compressed size that closes a shard, 64 MiB), ``level`` (gzip, 6).
    Read: ``payload`` (``false``: leave it NULL), ``split_bytes`` (compressed bytes per task, 64 MiB)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return READ

    def writer(self, schema, overwrite: bool) -> RecordWriter:
        missing = {part.split()[0] for part in WRITTEN.split(", ")} - set(schema.fieldNames())
        if missing:
            raise ValueError(f"records lack the columns {sorted(missing)}")
        return RecordWriter(self.options, overwrite)

    def reader(self, schema) -> RecordReader:
        return RecordReader(self.options)


class RecordWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path = options["path"]
        self.limit = int(options.get("shard_bytes", 64 << 20))
        self.level = int(options.get("level", 6))
        self.overwrite = overwrite
        self.job = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> manifests.Task:
        task = TaskContext.get()
        files, root = manifests.place(self.path)
        manifests.prepare(files, root)
        attempt = f"{task.partitionId():06d}-{task.taskAttemptId()}"
        open_shards: dict[str, list] = {}
        done: list[manifests.File] = []

        def close(kind: str) -> None:
            out, name, size = open_shards.pop(kind)
            out.close()
            done.append(manifests.File(name, size, kinds=[kind]))

        for batch in iterator:
            for row in batch.to_pylist():
                kind = row["record_type"] or "response"
                data = member(record_bytes(row | {"record_type": kind}), self.level)
                if kind not in open_shards:
                    name = f"{kind}-{self.job}-{attempt}-{len(done) + len(open_shards):05d}.warc.gz"
                    open_shards[kind] = [files.open_output_stream(f"{root}/{name}", compression=None), name, 0]
                shard = open_shards[kind]
                shard[0].write(data)
                shard[2] += len(data)
                if shard[2] >= self.limit:
                    close(kind)
        for kind in list(open_shards):
            close(kind)
        return manifests.finish_task(files, root, self.job, attempt, done)

    def commit(self, messages: list) -> None:
        manifests.commit(self.path, self.job, messages, self.overwrite)

    def abort(self, messages: list) -> None:
        manifests.abort(self.path, self.job)


class Stream:
    """A shard, gzip or plain, of which the caller takes lines and blocks or steps over them."""

    def __init__(self, f):
        self.f = f
        self.raw = f.read(BLOCK)  # not yet inflated
        self.plain = bytearray()
        self.gzip = self.raw[:2] == b"\x1f\x8b"
        self.z = None
        self.jump: int | None = None  # where the next member starts, if this one tells

    def _start_member(self) -> bool:
        if len(self.raw) < 24:
            self.raw += self.f.read(BLOCK)
        if not self.raw.strip(b"\0"):  # the end, or padding
            return False
        at = self.f.tell() - len(self.raw)
        self.jump = None
        if len(self.raw) >= 24 and self.raw[3] & 4 and self.raw[10:16] == b"\x0c\x00sl\x08\x00":
            self.jump = at + struct.unpack_from("<I", self.raw, 16)[0]
        self.z = zlib.decompressobj(31)
        return True

    def _more(self) -> bool:
        """Add up to a block of plain bytes; False at the end of the shard."""
        if not self.gzip:
            block = self.raw or self.f.read(BLOCK)
            self.raw = b""
            self.plain += block
            return bool(block)
        while True:
            if self.z is None and not self._start_member():
                return False
            feed = self.raw or self.f.read(BLOCK)
            block = self.z.decompress(feed, BLOCK)
            self.raw = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
            if not (feed or block or self.z.eof):
                raise ValueError("gzip member is cut short")
            if self.z.eof:
                self.z = None
            if block:
                self.plain += block
                return True

    def head(self) -> bytes | None:
        """The next header block without its empty line, None at the end."""
        while True:
            while self.plain[:2] == b"\r\n":
                del self.plain[:2]
            at = self.plain.find(b"\r\n\r\n")
            if at > 0:
                found = bytes(self.plain[:at])
                del self.plain[: at + 4]
                return found
            if not self._more():
                if self.plain.strip():
                    raise ValueError("record header is cut short")
                return None

    def take(self, n: int) -> bytes:
        while len(self.plain) < n:
            if not self._more():
                raise ValueError("record is cut short")
        found = bytes(self.plain[:n])
        del self.plain[:n]
        return found

    def step_over(self, n: int) -> None:
        """Pass the rest of a record: by a seek where that is known, else block by block."""
        if self.gzip and self.jump is not None:
            if self.z is not None:
                self.f.seek(self.jump)
                self.raw, self.z = b"", None
            self.plain.clear()  # a member that notes its size holds one record
            return
        if not self.gzip and n > len(self.plain) + len(self.raw):
            self.f.seek(n - len(self.plain) - len(self.raw), 1)
            self.raw = b""
            self.plain.clear()
            return
        while n > len(self.plain):
            n -= len(self.plain)
            self.plain.clear()
            if not self._more():
                raise ValueError("record is cut short")
        del self.plain[:n]


def parsed_head(block: bytes) -> dict[str, str]:
    """Header fields by lower-case name; the first of a repeated one counts."""
    lines = block.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    found: dict[str, str] = {}
    for line in lines[1:]:
        name, _, value = line.partition(":")
        found.setdefault(name.strip().lower(), value.strip())
    return found


def columns_of(head: dict[str, str]) -> dict[str, object]:
    row: dict[str, object] = {name: head.get(title.lower()) for name, title in FIELDS.items()}
    for name in ("record_id", "refers_to"):
        if row[name] is not None:
            row[name] = row[name].removeprefix("<").removesuffix(">")
    if row["payload_digest"] is not None:
        row["payload_digest"] = row["payload_digest"].removeprefix("sha1:")
    size = head.get(SIZE_FIELD.lower())
    row["payload_length"] = int(size) if size is not None else None
    row["content_length"] = int(head["content-length"])
    return row


def holds(test: Filter, value: str | None) -> bool:
    if isinstance(test, IsNull):
        return value is None
    if value is None:
        return False
    if isinstance(test, EqualTo):
        return value == test.value
    if isinstance(test, In):
        return value in test.value
    if isinstance(test, StringStartsWith):
        return value.startswith(test.value)
    return True  # IsNotNull


class RecordReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() == "true"
        self.split = int(options.get("split_bytes", 64 << 20))
        self.tests: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Take over all tests of one header column that headers decide alone."""
        for test in filters:
            known = isinstance(test, (EqualTo, In, StringStartsWith, IsNotNull, IsNull))
            if known and len(test.attribute) == 1 and test.attribute[0] in PUSHED:
                self.tests.append(test)
            else:
                yield test

    def _types_fit(self, kinds: list[str]) -> bool:
        tests = [t for t in self.tests if t.attribute[0] == "record_type"]
        return not kinds or any(all(holds(t, kind) for t in tests) for kind in kinds)

    def partitions(self) -> list[manifests.Part]:
        return manifests.plan(self.path, self.split, (".warc.gz", ".warc"), lambda task: self._types_fit(task.kinds))

    def read(self, partition: manifests.Part) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        size = 0
        for files, path, entry in manifests.files_of(self.path, partition):
            if not self._types_fit(entry.kinds):
                continue
            with files.open_input_file(path) as f:
                for row in self.records(Stream(f)):
                    rows.append(row)
                    size += len(row["payload"] or b"")
                    if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                        yield batch_of(rows)
                        rows, size = [], 0
        yield batch_of(rows)

    def records(self, stream: Stream) -> Iterator[dict]:
        while (block := stream.head()) is not None:
            row = columns_of(parsed_head(block))
            row["payload"] = None
            if not all(holds(t, row[t.attribute[0]]) for t in self.tests):
                stream.step_over(row["content_length"])
                continue
            if self.payload:
                http = stream.take(row["content_length"])
                if row["record_type"] != "revisit":
                    row["payload"] = http.partition(b"\r\n\r\n")[2] if http.startswith(b"HTTP/") else http
            else:
                stream.step_over(row["content_length"])
            yield row


ARROW = pa.schema(
    [(c.split()[0], {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}[c.split()[1]]) for c in READ.split(", ")]
)


def batch_of(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{n: r[n] for n in ARROW.names} for r in rows], schema=ARROW)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcRecords)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def base32_sha1(payload: str) -> str:
    """SQL: the SHA-1 of a binary column as 32 upper-case base32 digits.

    Five bytes are eight digits; each fourth of the digest is turned to base 32
    and its digits 0-9A-V are renamed to A-Z2-7.
    """
    digits = "".join(f"{'||' if k else ''}lpad(conv(substr(h, {10 * k + 1}, 10), 16, 32), 8, '0')" for k in range(4))
    renamed = f"translate({digits}, '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')"
    return f"transform(array(sha1({payload})), h -> {renamed})[0]"


def records_of(pages: DataFrame, least_bytes: int = LEAST_BYTES, parts: int | None = None) -> DataFrame:
    """A record per row of ``pages`` (page_id, url, html), ready for :class:`WarcRecords`.

    Of rows whose payloads of at least ``least_bytes`` bytes are equal, that
    with the smallest page_id is the response and the others revisit it. NULL
    HTML is an empty payload; a NULL page_id counts as larger than any other;
    rows that repeat the smallest page_id are all responses, as are all of a
    payload that only rows without page_id have. Other columns are ignored.

    Equal payloads are found on digests and sizes alone, in one aggregate that
    combines before it shuffles. Payloads that at least 1/``parts`` of all rows
    share are few, so their first pages are broadcast; the rows of such payloads
    meet nothing in the join for the others, under keys of their own. Only
    repeated payloads take part in that join.
    """
    parts = parts or shuffle_width(pages)
    rows = pages.selectExpr("page_id", "url", "coalesce(encode(html, 'UTF-8'), X'') AS payload").selectExpr(
        "page_id", "url", f"{base32_sha1('payload')} AS digest", "cast(octet_length(payload) AS bigint) AS size", "payload"
    )
    groups = rows.groupBy("digest", "size").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    found = written(groups.filter(f"n > 1 AND size >= {least_bytes}"), "payloads")
    total = pages.count()
    hot = found.filter(F.col("n") * parts >= total).selectExpr("digest", "size", "first AS hot_first")
    cold = found.filter(F.col("n") * parts < total).selectExpr("concat(digest, '-', size) AS key", "first")
    known = rows.join(F.broadcast(hot), ["digest", "size"], "left").selectExpr(
        "*", "CASE WHEN hot_first IS NULL THEN concat(digest, '-', size) ELSE concat('hot-', xxhash64(page_id, url)) END AS key"
    )
    joined = known.join(cold, "key", "left").selectExpr("*", "coalesce(hot_first, first) AS original")
    again = "coalesce(page_id <> original, original IS NOT NULL)"
    return joined.selectExpr(
        f"CASE WHEN {again} THEN 'revisit' ELSE 'response' END AS record_type",
        f"concat('{ID_PREFIX}', coalesce(cast(page_id AS string), '')) AS record_id",
        "url AS target_uri",
        "date_format(timestamp_seconds(0), \"yyyy-MM-dd'T'HH:mm:ss'Z'\") AS warc_date",
        "digest AS payload_digest",
        "size AS payload_length",
        f"CASE WHEN {again} THEN concat('{ID_PREFIX}', original) END AS refers_to",
        f"CASE WHEN {again} THEN NULL ELSE payload END AS payload",
    )


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record in an archive.

    Responses are read with their payloads, and size and digest are those of the
    bytes found; revisits are read by their headers alone.
    """

    def number(column: str) -> str:
        return f"try_cast(substr({column}, {len(ID_PREFIX) + 1}) AS bigint)"

    whole = spark.read.format(NAME).load(path).filter("record_type = 'response'")
    heads = spark.read.format(NAME).option("payload", "false").load(path).filter("record_type = 'revisit'")
    shared = [f"{number('record_id')} AS page_id"]
    rest = ["record_type", f"{number('refers_to')} AS refers_to"]
    return whole.selectExpr(
        *shared, "cast(octet_length(payload) AS bigint) AS payload_bytes", f"{base32_sha1('payload')} AS payload_digest", *rest
    ).unionByName(heads.selectExpr(*shared, "payload_length AS payload_bytes", "payload_digest", *rest))


def archived(pages: DataFrame, path: str | None = None, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Write ``pages`` as an archive and read it back."""
    spark = pages.sparkSession
    register(spark)
    path = path or fresh_path(spark, "warc_records")
    records_of(pages, least_bytes).write.format(NAME).mode("append").save(path)
    return read_back(spark, path)
