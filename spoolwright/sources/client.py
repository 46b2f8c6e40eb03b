"""Spool files written: by a process that logs, and by a Spark job."""

from __future__ import annotations

import logging
import os
import struct
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from datetime import datetime
from pathlib import Path

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from .. import codec

log = logging.getLogger(__name__)
LIFETIME_MS = 300_000


def publish(current: Path, folder: Path, now: datetime | None = None) -> Path:
    """Moves a finished file to the first free ``yyyyMMddTHHmmss[-k].saved``."""
    stem = (now or datetime.now()).strftime("%Y%m%dT%H%M%S")
    k = 0
    while True:
        to = folder / f"{stem}{f'-{k}' if k else ''}.saved"
        try:
            os.link(current, to)  # fails if the name is taken, unlike a rename
        except FileExistsError:
            k += 1
            continue
        current.unlink()
        return to


class LogWriterClient:
    """Appends records to ``current[-pid]`` in a folder and publishes it when it is old enough, which is looked at on
    each append, or when closed. Files that a crash left behind are published when a file is opened.

    Files are those of one process: another live process's current file is left alone if its name ends in its id.
    """

    def __init__(self, folder: str | Path, lifetime_ms: int = LIFETIME_MS, with_pid: bool = False, clock: Callable[[], float] = time.time):
        self.folder, self.lifetime_ms, self.clock = Path(folder), lifetime_ms, clock
        self.current = self.folder / (f"current-{os.getpid()}" if with_pid else "current")
        self._file, self._until, self._lock = None, 0.0, threading.Lock()

    def append(self, table: str, id: int | str | None, ts: int, text: str) -> None:
        """Adds a record; an int, a string or no identifier."""
        kind = 0 if id is None else 1 if isinstance(id, int) else 2
        row = codec.saved_record(table, kind, id if kind == 1 else None, id if kind == 2 else None, ts, text.encode())
        with self._lock:
            now = self.clock() * 1000
            if now >= self._until:
                self._close()
                self._until = now + self.lifetime_ms
                self.recover()
                self.folder.mkdir(parents=True, exist_ok=True)
                self._file = self.current.open("ab")
                self._file.write(struct.pack(">i", codec.SAVED_VERSION))
            self._file.write(row)

    def recover(self) -> None:
        """Publishes what was left behind: all current files whose process isn't alive."""
        for p in sorted(self.folder.glob("current*")) if self.folder.exists() else []:
            pid = p.name.partition("-")[2]
            if pid.isdigit() and int(pid) != os.getpid() and Path(f"/proc/{pid}").exists():
                continue
            log.warning("publishing a file left behind: %s", p)
            publish(p, self.folder, datetime.fromtimestamp(self.clock()))

    def _close(self) -> None:
        if self._file:
            self._file.close()
            publish(self.current, self.folder, datetime.fromtimestamp(self.clock()))
            self._file = None

    def close(self) -> None:
        with self._lock:
            self._close()
            self._until = 0.0

    def __enter__(self) -> LogWriterClient:
        return self

    def __exit__(self, *_) -> None:
        self.close()


SAVED_SCHEMA = "table_name string, id_kind tinyint, id_int int, id_str string, timestamp bigint, data binary"


def local_path(path: str) -> str:
    """A path as the operating system knows it; other file systems' are refused."""
    if "://" in path and not path.startswith("file://"):
        raise ValueError(f"spool files are written to mounted folders, not to {path}")
    return path.removeprefix("file://")


class SavedDataSource(DataSource):
    """``spark.read/write.format("saved")`` for spool files in a folder that all executors see at the same path. Reading
    through other file systems is ``files.read_saved``."""

    @classmethod
    def name(cls) -> str:
        return "saved"

    def schema(self) -> str:
        return SAVED_SCHEMA

    def reader(self, schema) -> SavedReader:
        return SavedReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> SavedWriter:
        if overwrite:
            raise ValueError("spool files are only ever added")
        return SavedWriter(self.options["path"], schema.fieldNames())


class SavedReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = local_path(path)

    def partitions(self) -> list[InputPartition]:
        found = sorted(str(p) for p in Path(self.path).rglob("*") if p.name.endswith((".saved", ".saved.gz")))
        return [InputPartition(p) for p in found]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from codec.read_saved(Path(partition.value).read_bytes(), partition.value)


class SavedWriter(DataSourceWriter):
    """Tasks write hidden files; the commit publishes those of successful tasks, an abort removes them."""

    def __init__(self, path: str, names: list[str]):
        self.path, self.names = local_path(path), names

    def write(self, rows: Iterator) -> WriterCommitMessage:
        folder = Path(self.path)
        folder.mkdir(parents=True, exist_ok=True)
        at = folder / f".task-{uuid.uuid4().hex}"
        n = 0
        with at.open("wb") as f:
            f.write(struct.pack(">i", codec.SAVED_VERSION))
            for r in rows:
                f.write(codec.saved_record(*[bytes(r[c]) if c == "data" else r[c] for c in ("table_name", "id_kind", "id_int", "id_str", "timestamp", "data")]))
                n += 1
        return Written(str(at), n)

    def commit(self, messages: list) -> None:
        for m in messages:
            if m is not None:
                publish(Path(m.path), Path(self.path)) if m.n else Path(m.path).unlink()

    def abort(self, messages: list) -> None:
        for m in messages:
            if m is not None:
                Path(m.path).unlink(missing_ok=True)


class Written(WriterCommitMessage):
    def __init__(self, path: str, n: int):
        self.path, self.n = path, n
