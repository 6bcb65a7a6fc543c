"""``format("warc")``: write and read folders of gzip-compressed WARC shards, with an index by key.

``spark.dataSource.register(WarcDataSource)`` makes it known. Spark partitions
the records; each task writes or reads its own shards with Arrow batches. The
path may be on any file system that pyarrow reaches and all executors share.
Shards are committed by manifests (:mod:`crawlframe.sources.manifests`).

Records written with a string column ``key`` get an index: beside each shard a
table (key, offset, length) of its members, sorted by key, and the least and
largest key in the manifests. A filter on ``key`` then opens only tasks and
shards whose range it meets, and of these only the members that it matches; the
others are never inflated. Archives sorted by key (:func:`write_sorted`) make
those ranges narrow.

Columns: ``record`` holds a record's bytes; ``member`` and ``plain`` instead hold
its gzip member and its plain size. Write options: ``shard_bytes`` (a shard closes once more than this many
uncompressed bytes are in it, default 1 MiB), ``level`` (gzip level, default 9).
Read options: ``payload`` (``false`` leaves ``http`` NULL), ``split_bytes``
(compressed bytes per read task, default 64 MiB), ``index`` (``true`` gives the
index entries instead of the records).
"""

from __future__ import annotations

import gzip
import posixpath
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
    StringStartsWith,
)

from crawlframe.session import settings
from crawlframe.sources import manifests

SUFFIX = ".warc.gz"
INDEX = ".idx"
READ_SCHEMA = (
    "target_uri string, record_id string, warc_date string, content_length bigint, http binary, key string"
)
INDEX_SCHEMA = "key string, shard string, offset bigint, length bigint"
BATCH_ROWS = 2000
BATCH_BYTES = 8 * 2**20
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"

ARROW_INDEX = pa.schema([("key", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return INDEX_SCHEMA if self._index() else READ_SCHEMA

    def _index(self) -> bool:
        return self.options.get("index", "false").lower() == "true"

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        if not {"record", "member"} & set(schema.fieldNames()):
            raise ValueError("the warc writer needs a binary column named record")
        return WarcWriter(self.options, overwrite)

    def reader(self, schema) -> WarcReader:
        return IndexReader(self.options) if self._index() else WarcReader(self.options)


class _Shard:
    """A shard that is being written, and what its index will say."""

    def __init__(self, files: pafs.FileSystem, path: str):
        self.files, self.path = files, path
        self.out = files.open_output_stream(path, compression=None)
        self.plain = self.packed = 0
        self.entries: list[tuple[str | None, int, int]] = []

    def add(self, data: bytes, plain: int, key: str | None) -> None:
        self.out.write(data)
        self.entries.append((key, self.packed, len(data)))
        self.plain += plain
        self.packed += len(data)

    def close(self, indexed: bool) -> manifests.File:
        self.out.close()
        done = manifests.File(posixpath.basename(self.path), self.packed)
        if indexed:
            columns = zip(*sorted(self.entries, key=lambda e: (e[0] is not None, e[0] or "", e[1])))
            table = pa.table([pa.array(c, t) for c, t in zip(columns, ARROW_INDEX.types)], schema=ARROW_INDEX)
            with self.files.open_output_stream(self.path + INDEX, compression=None) as out:
                with pa.ipc.new_file(out, ARROW_INDEX) as writer:
                    writer.write_table(table)
            keys = [e[0] for e in self.entries if e[0] is not None]
            done.low, done.high = (min(keys), max(keys)) if keys else (None, None)
            done.kinds = ["index"]
        return done


class WarcWriter(DataSourceArrowWriter):
    """Tasks write shards under final names of their own; see :mod:`crawlframe.sources.manifests`."""

    def __init__(self, options: dict, overwrite: bool):
        self.path = options["path"]
        self.limit = int(options.get("shard_bytes", 2**20))
        self.level = int(options.get("level", 9))
        self.overwrite = overwrite
        self.job = uuid.uuid4().hex[:12]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> manifests.Task:
        task = TaskContext.get()
        files, root = manifests.place(self.path)
        manifests.prepare(files, root)
        done: list[manifests.File] = []
        shard: _Shard | None = None
        indexed = False
        for batch in iterator:
            indexed = "key" in batch.schema.names
            keys = batch.column("key").to_pylist() if indexed else [None] * batch.num_rows
            for (data, plain), key in zip(self._members(batch), keys):
                if shard is None:
                    name = f"archive_{self.job}_{task.partitionId():05d}_{task.taskAttemptId()}_{len(done):03d}{SUFFIX}"
                    shard = _Shard(files, posixpath.join(root, name))
                shard.add(data, plain, key)
                if shard.plain > self.limit:
                    done.append(shard.close(indexed))
                    shard = None
        if shard is not None:
            done.append(shard.close(indexed))
        return manifests.finish_task(files, root, self.job, f"{task.partitionId():05d}_{task.taskAttemptId()}", done)

    def _members(self, batch: pa.RecordBatch) -> Iterator[tuple[bytes, int]]:
        """Gzip members with their plain sizes, from records or packed before."""
        if "member" in batch.schema.names:
            yield from zip((m.as_py() for m in batch.column("member")), batch.column("plain").to_pylist())
        else:
            for value in batch.column("record"):
                record = value.as_py() or b""
                yield _member(record, self.level), len(record)

    def commit(self, messages: list[manifests.Task | None]) -> None:
        manifests.commit(self.path, self.job, messages, self.overwrite)

    def abort(self, messages: list[manifests.Task | None]) -> None:
        manifests.abort(self.path, self.job)


def _member(record: bytes, level: int) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


def _holds(test: Filter, key: str | None) -> bool:
    if key is None:
        return False
    if isinstance(test, EqualTo):
        return key == test.value
    if isinstance(test, In):
        return key in test.value
    if isinstance(test, StringStartsWith):
        return key.startswith(test.value)
    if isinstance(test, GreaterThan):
        return key > test.value
    if isinstance(test, GreaterThanOrEqual):
        return key >= test.value
    if isinstance(test, LessThan):
        return key < test.value
    if isinstance(test, LessThanOrEqual):
        return key <= test.value
    return True  # IsNotNull


def _meets(test: Filter, low: str, high: str) -> bool:
    """Whether a key between ``low`` and ``high`` can pass the test."""
    if isinstance(test, EqualTo):
        return low <= test.value <= high
    if isinstance(test, In):
        return any(v is not None and low <= v <= high for v in test.value)
    if isinstance(test, StringStartsWith):
        return high >= test.value and (low <= test.value or low.startswith(test.value))
    if isinstance(test, (GreaterThan, GreaterThanOrEqual)):
        return _holds(test, high)
    if isinstance(test, (LessThan, LessThanOrEqual)):
        return _holds(test, low)
    return True


PUSHED = (EqualTo, In, StringStartsWith, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, IsNotNull)


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() == "true"
        self.split = int(options.get("split_bytes", 64 * 2**20))
        self.tests: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Take over the tests of the key alone."""
        for test in filters:
            if isinstance(test, PUSHED) and test.attribute == ("key",):
                self.tests.append(test)
            else:
                yield test

    def _wanted(self, unit: manifests.Task | manifests.File) -> bool:
        """Whether a task or a shard can hold a wanted key; a range that is not known can."""
        return unit.low is None or unit.high is None or all(_meets(t, unit.low, unit.high) for t in self.tests)

    def partitions(self) -> list[manifests.Part]:
        return manifests.plan(self.path, self.split, SUFFIX, self._wanted)

    def read(self, partition: manifests.Part) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for files, path, entry in manifests.files_of(self.path, partition):
            if not self._wanted(entry):
                continue
            for row in self._rows(files, path, "index" in entry.kinds):
                rows.append(row)
                size += len(row[4] or b"")
                if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                    yield _batch(rows)
                    rows, size = [], 0
        yield _batch(rows)

    def _rows(self, files: pafs.FileSystem, path: str, indexed: bool) -> Iterator[tuple]:
        """Rows of a shard with their keys: all in order, or only those of the wanted members."""
        if self.tests:
            if not indexed:
                raise ValueError(f"{path} was written without keys, so a filter on key cannot find its records")
            yield from read_members(files, path, self._entries(files, path), self.payload)
            return
        keys = iter(k for k, _, _ in sorted(read_index(files, path), key=lambda e: e[1])) if indexed else None
        with files.open_input_stream(path, compression=None) as raw, gzip.GzipFile(fileobj=raw) as f:
            for row in _records(f, self.payload):
                yield (*row, next(keys) if keys else None)

    def _entries(self, files: pafs.FileSystem, path: str) -> list[tuple[str | None, int, int]]:
        return [e for e in read_index(files, path) if all(_holds(t, e[0]) for t in self.tests)]


class IndexReader(WarcReader):
    """The index entries, with the name of their shard."""

    def read(self, partition: manifests.Part) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.string(), pa.int64(), pa.int64()]
        names = ["key", "shard", "offset", "length"]
        for files, path, entry in manifests.files_of(self.path, partition):
            if "index" in entry.kinds and self._wanted(entry):
                rows = [(k, entry.name, at, n) for k, at, n in self._entries(files, path)]
                columns = list(zip(*rows)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def read_index(files: pafs.FileSystem, path: str) -> list[tuple[str | None, int, int]]:
    """(key, offset, length) of a shard's members, sorted by key."""
    with files.open_input_file(path + INDEX) as f:
        table = pa.ipc.open_file(f).read_all()
    return list(zip(*(table[c].to_pylist() for c in ARROW_INDEX.names)))


def read_members(
    files: pafs.FileSystem, path: str, entries: list[tuple[str | None, int, int]], payload: bool
) -> Iterator[tuple]:
    """The records of some members of a shard, in the order of the file."""
    if not entries:
        return
    with files.open_input_file(path) as f:
        for key, offset, length in sorted(entries, key=lambda e: e[1]):
            f.seek(offset)
            with gzip.GzipFile(fileobj=pa.BufferReader(f.read(length))) as one:
                for row in _records(one, payload):
                    yield (*row, key)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string()]
    names = [c.split()[0] for c in READ_SCHEMA.split(", ")]
    columns = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=t) for c, t in zip(columns, types)], names=names
    )


def _records(f, payload: bool) -> Iterator[tuple]:
    """Records of decompressed bytes, whether they were one member or many."""
    while line := f.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        fields: dict[str, str] = {}
        while (line := f.readline().strip()):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        length = int(fields["content-length"])
        block = f.read(length)
        if len(block) != length:
            raise ValueError("WARC record is cut short")
        yield (
            fields.get("warc-target-uri"),
            fields.get("warc-record-id"),
            fields.get("warc-date"),
            length,
            block if payload else None,
        )


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def pack_batch(batch: pa.RecordBatch, level: int) -> Iterator[pa.RecordBatch]:
    """A batch with its records as members, in pieces that close with more than ``BATCH_BYTES`` of records."""
    names = [name for name in batch.schema.names if name != "record"]
    start, members, plain, size = 0, [], [], 0
    for end, value in enumerate(batch.column(batch.schema.get_field_index("record")), 1):
        record = value.as_py() or b""
        members.append(_member(record, level))
        plain.append(len(record))
        size += len(record)
        if size > BATCH_BYTES or end == batch.num_rows:
            rest = [batch.column(name).slice(start, end - start) for name in names]
            packs = [pa.array(members, pa.binary()), pa.array(plain, pa.int64())]
            yield pa.RecordBatch.from_arrays([*rest, *packs], names=[*names, "member", "plain"])
            start, members, plain, size = end, [], [], 0


def packed(records: DataFrame, level: int = 9) -> DataFrame:
    """Records as gzip members (``member``, ``plain`` bytes) beside their other columns."""
    rest = [c for c in records.columns if c != "record"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from pack_batch(batch, level)

    schema = ", ".join(f"`{name}` {kind}" for name, kind in records.select(*rest).dtypes)
    return records.select(*rest, "record").mapInArrow(pack, f"{schema}, member binary, plain bigint")


def write_sorted(records: DataFrame, path: str, mode: str = "append", **options: object) -> None:
    """Write records with a ``key`` in the order of their keys, so that a key lies in few shards.

    Records are compressed where they are made; what moves is what the archive
    will hold. Range partitions also split by date and record, so a key with
    very many records is spread over tasks. Python gets few bytes at a time, so
    its memory does not depend on how many records a task has.
    """
    register(records.sparkSession)
    order = [c for c in ("key", "warc_date", "record_id") if c in records.columns]
    members = packed(records.select(*order, "record"), int(options.get("level", 9)))
    placed = members.repartitionByRange(*order).sortWithinPartitions(*order)
    with settings(records.sparkSession, {ARROW_BYTES: str(BATCH_BYTES)}):
        placed.select("key", "member", "plain").write.format("warc").mode(mode).options(**options).save(path)


def fetch_members(entries: DataFrame, path: str, payload: bool = True) -> DataFrame:
    """The records of index entries (key, shard, offset, length): each is read by one seek.

    Entries are dealt by shard and megabyte of it, so a shard with very many of
    them is read by several tasks.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = manifests.place(path)
        for batch in batches:
            by_shard: dict[str, list[tuple]] = {}
            for key, shard, offset, length in zip(*(batch.column(c).to_pylist() for c in range(4))):
                by_shard.setdefault(shard, []).append((key, offset, length))
            rows: list[tuple] = []
            size = 0
            for shard, some in by_shard.items():
                for row in read_members(files, posixpath.join(root, shard), some, payload):
                    rows.append(row)
                    size += len(row[4] or b"")
                    if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                        yield _batch(rows)
                        rows, size = [], 0
            yield _batch(rows)

    dealt = entries.selectExpr("key", "shard", "offset", "length", "offset DIV 1048576 AS _part")
    placed = dealt.repartition("shard", "_part").sortWithinPartitions("shard", "offset").drop("_part")
    return placed.mapInArrow(read, READ_SCHEMA)
