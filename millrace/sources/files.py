"""Python data sources: archives of CSV in zip files, and recordings as lines by UTC day.

`archives` reads <symbol>-<kind>-<period>.zip files of a folder, as a batch or as a stream of the files that come. Filters
on symbol, kind and period choose files before any is opened. `recordings` writes {"t":ns,"m":...} lines, gzipped, into
a folder for each UTC day; a file gets its name when the whole write (or the batch of a stream) commits.

Folders are URIs that pyarrow's file systems open (local, HDFS, S3, GCS), from every executor.
"""

from __future__ import annotations

import csv
import gzip
import io
import posixpath
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    DataSourceStreamWriter,
    DataSourceWriter,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)

#: Rows of a batch, and bytes of the zip files that one task reads (about; a file isn't split).
ROWS, TASK_BYTES = 10_000, 4 << 20

_TESTS = {
    EqualTo: lambda x, v: x == v,
    In: lambda x, v: x in v,
    GreaterThan: lambda x, v: x > v,
    GreaterThanOrEqual: lambda x, v: x >= v,
    LessThan: lambda x, v: x < v,
    LessThanOrEqual: lambda x, v: x <= v,
}


def register(spark: SparkSession) -> None:
    """Makes both sources known to a session, with filters handed to them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (ArchiveSource, RecordingSink):
        spark.dataSource.register(source)


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass(frozen=True)
class Archive:
    path: str
    size: int
    mtime_ns: int
    symbol: str
    kind: str
    period: str


def archives(path: str) -> list[Archive]:
    """The archives of a folder in order of their names; other files don't count."""
    system, root = opened(path)
    found = []
    for info in system.get_file_info(fs.FileSelector(root, recursive=True)):
        parts = info.base_name.removesuffix(".zip").split("-", 2)
        if info.base_name.endswith(".zip") and len(parts) == 3:
            found.append(Archive(info.path, info.size, info.mtime_ns or 0, *parts))
    return sorted(found, key=lambda a: a.path)


@dataclass
class Share(InputPartition):
    files: list[Archive]


def shares(found: Iterable[Archive]) -> list[Share]:
    """The files in runs of about TASK_BYTES."""
    out, size = [], 0
    for archive in found:
        if not out or size + archive.size > TASK_BYTES:
            out.append(Share([]))
            size = 0
        out[-1].files.append(archive)
        size += archive.size
    return out


def read_share(path: str, share: Share) -> Iterator[pa.RecordBatch]:
    system, _ = opened(path)
    for archive in share.files:
        with system.open_input_file(archive.path) as raw, zipfile.ZipFile(raw) as zipped, zipped.open(zipped.namelist()[0]) as member:
            held: list[list[str]] = []
            nth = 0
            for k, row in enumerate(csv.reader(io.TextIOWrapper(member, "utf-8", newline=""))):
                if not row or (k == 0 and not row[0][:1].isdigit()):
                    continue  # a header is a first line that doesn't begin with a digit
                held.append(row)
                if len(held) == ROWS:
                    yield _batch(archive, nth, held)
                    nth, held = nth + len(held), []
            if held:
                yield _batch(archive, nth, held)


def _batch(archive: Archive, nth: int, rows: list[list[str]]) -> pa.RecordBatch:
    n = len(rows)
    names = [pa.array([x] * n, pa.string()) for x in (archive.symbol, archive.kind, archive.period)]
    return pa.RecordBatch.from_arrays(
        [*names, pa.array(range(nth, nth + n), pa.int64()), pa.array(rows, pa.list_(pa.string()))], ["symbol", "kind", "period", "nth", "cells"]
    )


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path
        self.chosen: list[tuple[str, type, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            if type(f) in _TESTS and len(f.attribute) == 1 and f.attribute[0] in ("symbol", "kind", "period"):
                self.chosen.append((f.attribute[0], type(f), f.value))
            else:
                yield f

    def partitions(self) -> list[Share]:
        fits = lambda a: all(_TESTS[test](getattr(a, name), value) for name, test, value in self.chosen)
        return shares(filter(fits, archives(self.path)))

    def read(self, partition: Share | None) -> Iterator[pa.RecordBatch]:
        return read_share(self.path, partition) if partition else iter(())  # without files there is one task without a share


class ArchiveStreamReader(DataSourceStreamReader):
    """Files in order of their times of change; an offset is the last file's."""

    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:  # noqa: N802
        return {"mtime_ns": "0", "path": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        last = max(((a.mtime_ns, a.path) for a in archives(self.path)), default=(0, ""))
        return {"mtime_ns": str(last[0]), "path": last[1]}

    def partitions(self, start: dict, end: dict) -> list[Share]:
        place = lambda offset: (int(offset["mtime_ns"]), offset["path"])
        return shares(a for a in archives(self.path) if place(start) < (a.mtime_ns, a.path) <= place(end))

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        return read_share(self.path, partition)


class ArchiveSource(DataSource):
    """Rows of archives: symbol, kind, period (of the file's name), nth (of the row), cells (texts). Option: path."""

    @classmethod
    def name(cls) -> str:
        return "archives"

    def schema(self) -> str:
        return "symbol string, kind string, period string, nth bigint, cells array<string>"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["path"])

    def streamReader(self, schema) -> ArchiveStreamReader:  # noqa: N802
        return ArchiveStreamReader(self.options["path"])


# ---- recordings ----


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class _Lines:
    """Writes a task's lines under names that don't count yet, and names them or deletes them when all is known."""

    def __init__(self, path: str):
        self.path = path

    def put(self, rows: Iterable, name: str) -> Written:
        system, root = opened(self.path)
        out: dict[str, tuple[object, gzip.GzipFile, str, str]] = {}
        for row in rows:
            day = datetime.fromtimestamp(row["t"] // 1_000_000_000, UTC).date().isoformat()
            if day not in out:
                folder = posixpath.join(root, f"day={day}")
                system.create_dir(folder, recursive=True)
                waiting = posixpath.join(folder, f"_{name}-{uuid.uuid4().hex}.gz")
                raw = system.open_output_stream(waiting, compression=None)
                out[day] = raw, gzip.GzipFile(fileobj=raw, mode="wb"), waiting, posixpath.join(folder, f"{name}.jsonl.gz")
            out[day][1].write(f'{{"t":{row["t"]},"m":{row["m"]}}}\n'.encode())
        for raw, zipped, _, _ in out.values():
            zipped.close()
            raw.close()
        return Written([(waiting, final) for _, _, waiting, final in out.values()])

    def named(self, messages: list[Written | None]) -> None:
        system, _ = opened(self.path)
        for waiting, final in (f for m in messages if m for f in m.files):
            system.move(waiting, final)

    def deleted(self, messages: list[Written | None]) -> None:
        system, _ = opened(self.path)
        for waiting, _ in (f for m in messages if m for f in m.files):
            system.delete_file(waiting)


def _task() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


class RecordingWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.lines, self.run = _Lines(path), uuid.uuid4().hex

    def write(self, iterator: Iterator) -> Written:
        return self.lines.put(iterator, f"{self.run}-{_task()}")

    def commit(self, messages: list[Written | None]) -> None:
        self.lines.named(messages)

    def abort(self, messages: list[Written | None]) -> None:
        self.lines.deleted(messages)


class RecordingStreamWriter(DataSourceStreamWriter):
    """A batch that runs again after a failure replaces the names it gave before."""

    def __init__(self, path: str):
        self.lines = _Lines(path)

    def write(self, iterator: Iterator) -> Written:
        return self.lines.put(iterator, f"part-{_task()}")

    def commit(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803
        numbered = lambda final: posixpath.join(posixpath.dirname(final), f"batch-{batchId}-{posixpath.basename(final)}")
        self.lines.named([Written([(w, numbered(f)) for w, f in m.files]) for m in messages if m])

    def abort(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803
        self.lines.deleted(messages)


class RecordingSink(DataSource):
    """Writes t (bigint, ns) and m (the raw message in JSON). Option: path."""

    @classmethod
    def name(cls) -> str:
        return "recordings"

    def writer(self, schema, overwrite: bool) -> RecordingWriter:
        return RecordingWriter(self.options["path"])

    def streamWriter(self, schema, overwrite: bool) -> RecordingStreamWriter:  # noqa: N802
        return RecordingStreamWriter(self.options["path"])
