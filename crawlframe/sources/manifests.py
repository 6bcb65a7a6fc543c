"""Commit of many files by manifests: no renames, no work per file on the driver.

A task writes files under names that no other attempt uses and lists them in a
manifest of its own. The job's commit is one small file that names the manifests
of the attempts that count; it appears by a single rename. Readers start from the
commits, so files of failed or repeated attempts and of overwritten jobs are
never seen. :func:`vacuum` deletes those. Files that another program put into such a
folder are not seen either; a folder without commits is read by its listing.

Layout below the root: data files of any name; ``_tasks/<job>/<task>.json``, one
manifest per task; ``_commits/<job>.json``.
"""

from __future__ import annotations

import json
import posixpath
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import InputPartition, WriterCommitMessage

TASKS, COMMITS = "_tasks", "_commits"


@dataclass
class File:
    """One data file: name below the root, size, and what its writer wants to know of it when reading."""

    name: str
    size: int
    low: str | None = None
    high: str | None = None
    kinds: list[str] = field(default_factory=list)


@dataclass
class Task(WriterCommitMessage):
    """What a task tells the driver: its manifest and a summary of it, however many files it wrote."""

    manifest: str
    size: int
    files: int
    low: str | None
    high: str | None
    kinds: list[str]


@dataclass
class Part(InputPartition):
    """Work of one read task: slices of task manifests, or plain files of a folder without commits."""

    slices: list[tuple[str, int, int]]  # manifest, which slice, of how many
    plain: list[str]
    size: int = 0


def place(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def _dump(files: pafs.FileSystem, path: str, value: object) -> None:
    files.create_dir(posixpath.dirname(path), recursive=True)
    with files.open_output_stream(path, compression=None) as out:
        out.write(json.dumps(value).encode())


def _load(files: pafs.FileSystem, path: str) -> object:
    with files.open_input_stream(path, compression=None) as f:
        return json.loads(f.read())


def _range(found: list) -> tuple[str | None, str | None]:
    """Least and largest key; unknown as soon as one file does not tell."""
    if not found or any(f.low is None or f.high is None for f in found):
        return None, None
    return min(f.low for f in found), max(f.high for f in found)


def prepare(files: pafs.FileSystem, root: str) -> None:
    """Mark the folder as one that commits, before the first data file is in it."""
    files.create_dir(posixpath.join(root, COMMITS), recursive=True)


def finish_task(files: pafs.FileSystem, root: str, job: str, attempt: str, done: list[File]) -> Task:
    """Write a task's manifest after its files are closed; a task without files needs none."""
    if not done:
        return Task("", 0, 0, None, None, [])
    name = posixpath.join(TASKS, job, f"{attempt}.json")
    _dump(files, posixpath.join(root, name), [vars(f) for f in done])
    kinds = sorted({k for f in done for k in f.kinds})
    return Task(name, sum(f.size for f in done), len(done), *_range(done), kinds)


def commit(path: str, job: str, messages: list[Task | None], overwrite: bool) -> None:
    """Make the job's files visible; with ``overwrite`` those of earlier jobs vanish."""
    files, root = place(path)
    old = _commits(files, root) if overwrite else []
    target = posixpath.join(root, COMMITS, f"{job}.json")
    _dump(files, f"{target}.tmp", [vars(m) for m in messages if m and m.files])
    files.move(f"{target}.tmp", target)
    for before in old:
        files.delete_file(before)


def abort(path: str, job: str) -> None:
    """Forget the manifests of a job; without a commit they mean nothing anyway."""
    files, root = place(path)
    folder = posixpath.join(root, TASKS, job)
    if files.get_file_info(folder).type == pafs.FileType.Directory:
        files.delete_dir(folder)


def _commits(files: pafs.FileSystem, root: str) -> list[str]:
    found = files.get_file_info(pafs.FileSelector(posixpath.join(root, COMMITS), allow_not_found=True))
    return sorted(f.path for f in found if f.base_name.endswith(".json"))


def committed(path: str) -> list[Task] | None:
    """The tasks of all commits; None for a folder that another program wrote."""
    files, root = place(path)
    if files.get_file_info(posixpath.join(root, COMMITS)).type != pafs.FileType.Directory:
        return None
    return [Task(**t) for c in _commits(files, root) for t in _load(files, c)]


def plan(path: str, split: int, suffix: str, wanted=lambda task: True) -> list[Part]:
    """Read tasks of about ``split`` bytes.

    The driver sees one line per task that wrote, never one per file; ``wanted``
    drops tasks by their summary. The files of a large task are read in slices.
    Folders that other programs wrote have no commits and are listed.
    """
    tasks = committed(path)
    parts: list[Part] = []

    def put(size: int, entry: tuple | None = None, name: str | None = None) -> None:
        if not parts or parts[-1].size + size > split:
            parts.append(Part([], []))
        parts[-1].size += size
        if entry:
            parts[-1].slices.append(entry)
        if name:
            parts[-1].plain.append(name)

    if tasks is None:
        files, root = place(path)
        info = files.get_file_info(root)
        if info.type == pafs.FileType.File:
            found = [info]
        else:
            found = files.get_file_info(pafs.FileSelector(root, allow_not_found=True))
        for f in sorted(found, key=lambda f: f.path):
            if f.type == pafs.FileType.File and f.base_name.endswith(suffix):
                put(f.size, name=f.path)
    else:
        for task in filter(wanted, tasks):
            slices = max(1, min(task.files, -(-task.size // split)))
            for k in range(slices):
                put(task.size // slices, entry=(task.manifest, k, slices))
    return parts or [Part([], [])]


def files_of(path: str, part: Part) -> Iterator[tuple[pafs.FileSystem, str, File]]:
    """The files of a read task with their full paths; runs where the task runs."""
    files, root = place(path)
    for name in part.plain:
        yield files, name, File(name, 0)
    for manifest, k, slices in part.slices:
        for at, entry in enumerate(_load(files, posixpath.join(root, manifest))):
            if at % slices == k:
                f = File(**entry)
                yield files, posixpath.join(root, f.name), f


def vacuum(spark: SparkSession, path: str, suffixes: tuple[str, ...]) -> int:
    """Delete data files that no commit names; returns how many. Run it while nothing writes.

    The names that count are read from the manifests by tasks and joined with
    the listing; each task deletes its own share.
    """
    tasks = committed(path)
    if tasks is None:
        return 0
    files, root = place(path)
    width = spark.sparkContext.defaultParallelism

    def names(batches):
        import pyarrow as pa

        store, base = place(path)
        for batch in batches:
            for manifest in batch.column(0).to_pylist():
                listed = [f["name"] for f in _load(store, posixpath.join(base, manifest))]
                yield pa.RecordBatch.from_arrays([pa.array(listed, pa.string())], names=["name"])

    def delete(batches):
        import pyarrow as pa

        store, base = place(path)
        for batch in batches:
            gone = batch.column(0).to_pylist()
            for name in gone:
                store.delete_file(posixpath.join(base, name))
            yield pa.RecordBatch.from_arrays([pa.array([len(gone)], pa.int64())], names=["n"])

    present = [
        (f.base_name,)
        for f in files.get_file_info(pafs.FileSelector(root, allow_not_found=True))
        if f.type == pafs.FileType.File and f.base_name.endswith(suffixes)
    ]
    live = spark.createDataFrame([(t.manifest,) for t in tasks], "manifest string").repartition(width)
    keep = live.mapInArrow(names, "name string")
    data = spark.createDataFrame(present, "file string")
    # An index file lives as long as the data file that its name starts with.
    stale = data.selectExpr("file", f"regexp_replace(file, '\\\\.idx$', '') AS name").join(keep, "name", "left_anti")
    return stale.select("file").mapInArrow(delete, "n bigint").agg({"n": "sum"}).first()[0] or 0
