"""Small files through the Hadoop file system, versioned manifests and leases."""

from __future__ import annotations

import atexit
import json
import threading
import time
import uuid

from pyspark.sql import SparkSession


def fs_of(spark: SparkSession, path: str):
    """The file system of a path, and the path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes beside the path, then renames: there is a whole file or none. The path must not exist."""
    fs, p = fs_of(spark, path)
    part = fs_of(spark, f"{path}.{uuid.uuid4().hex}.part")[1]
    out = fs.create(part, False)
    out.write(bytearray(text.encode()))
    out.close()
    if not fs.rename(part, p):
        fs.delete(part, False)
        raise FileExistsError(path)


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = fs_of(spark, path)
    f = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(f)).decode()
    finally:
        f.close()


class Manifest:
    """What a folder's data consists of, as JSON in numbered files of which the last one counts. A new state is there
    from one rename on; until then, and after a crash, the one before is. Some old ones are kept for readers."""

    KEEP = 3

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def versions(self) -> list[int]:
        fs, p = fs_of(self.spark, self.folder)
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def read(self) -> dict | None:
        found = self.versions()
        return json.loads(read_text(self.spark, f"{self.folder}/{found[-1]:012d}.json")) if found else None

    def write(self, state: dict) -> None:
        found = self.versions()
        fs, p = fs_of(self.spark, self.folder)
        fs.mkdirs(p)
        write_text(self.spark, f"{self.folder}/{(found[-1] if found else 0) + 1:012d}.json", json.dumps(state))
        for v in found[: -(self.KEEP - 1)]:
            fs.delete(fs_of(self.spark, f"{self.folder}/{v:012d}.json")[1], False)


class Lease:
    """The right of one writer, a file that its holder keeps young. One that grows older than ``seconds`` was left behind
    by a holder that is no more, and is taken over. What a holder wants to be sure of, it ``check``s just before."""

    def __init__(self, spark: SparkSession, path: str, seconds: float = 120.0):
        self.spark, self.path, self.seconds = spark, path, seconds
        self.owner = uuid.uuid4().hex
        self._done = threading.Event()

    def take(self, wait: float) -> bool:
        """Whether it was got within ``wait`` seconds."""
        fs, p = fs_of(self.spark, self.path)
        until = time.time() + wait
        while True:
            try:
                out = fs.create(p, False)
                out.write(bytearray(self.owner.encode()))
                out.close()
                break
            except Exception:  # another's file
                if not self._free() and time.time() >= until:
                    return False
                time.sleep(min(0.5, max(0.01, until - time.time())))
        threading.Thread(target=self._stay_young, daemon=True).start()
        atexit.register(self.release)
        return True

    def _free(self) -> bool:
        """Moves a file that is too old out of the way; another who does the same at that moment finds it gone."""
        fs, p = fs_of(self.spark, self.path)
        try:
            seen = fs.getFileStatus(p).getModificationTime()
            if time.time() * 1000 - seen < self.seconds * 1000:
                return False
            gone = fs_of(self.spark, f"{self.path}.{self.owner}.left")[1]
            if not fs.rename(p, gone):
                return False
            if fs.getFileStatus(gone).getModificationTime() != seen:  # taken over by another in between
                fs.rename(gone, p)
                return False
            fs.delete(gone, False)
            return True
        except Exception:
            return False

    def _stay_young(self) -> None:
        while not self._done.wait(self.seconds / 4):
            try:
                fs, p = fs_of(self.spark, self.path)
                fs.setTimes(p, int(time.time() * 1000), -1)
            except Exception:
                pass  # ``check`` tells

    def check(self) -> None:
        try:
            mine = read_text(self.spark, self.path) == self.owner
        except Exception:
            mine = False
        if not mine or self._done.is_set():
            raise PermissionError(f"lost {self.path}")

    def release(self) -> None:
        self._done.set()
        atexit.unregister(self.release)
        try:
            if read_text(self.spark, self.path) == self.owner:
                fs, p = fs_of(self.spark, self.path)
                fs.delete(p, False)
        except Exception:
            pass  # it is gone, or grows old
