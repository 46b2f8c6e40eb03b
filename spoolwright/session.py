"""Session set-up, the shared folder, and size-checked broadcasts."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import fs_of

#: Rows up to which ``broadcast_if_small`` sends a side to every executor.
BROADCAST_ROWS = 200_000


def session(app: str = "spoolwright", master: str | None = None, **conf: object) -> SparkSession:
    """A session with what the engine relies on: UTC, adaptive execution, ANSI mode left on."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    for k, v in (base | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session; a temporary one is set only where
    that is unset, which is right for a single machine alone."""
    at = spark.conf.get("spark.checkpoint.dir", "") or spark.conf.get("spark.spoolwright.sharedDir", "")
    if not at:
        if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "local")):  # local-cluster has executors of its own
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="spoolwright-")
        spark.conf.set("spark.spoolwright.sharedDir", at)
    return at.rstrip("/")


def fresh_path(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that nobody uses."""
    return f"{shared_folder(spark)}/spoolwright/{what}-{uuid.uuid4().hex}"


_scratch: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch(spark: SparkSession):
    """What is materialised within the block is removed at its end; nothing that reads it may be left by then."""
    token = _scratch.set([])
    try:
        yield
    finally:
        for path in _scratch.get() or []:
            fs, p = fs_of(spark, path)
            fs.delete(p, True)
        _scratch.reset(token)


def materialise(df: DataFrame, what: str) -> DataFrame:
    """Cuts the lineage: writes ``df`` as a table in the shared folder and reads it. Survives the loss of executors."""
    spark = df.sparkSession
    path = fresh_path(spark, what)
    if (kept := _scratch.get()) is not None:
        kept.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``max_rows`` rows, else as it is (the join then shuffles).
    Counts ``df``; give it something that is cheap to compute twice, such as a materialised table."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


@contextmanager
def conf(spark: SparkSession, **values: object):
    """Sets SQL settings (dots written as ``__``) for the time of a block."""
    old = {}
    for k, v in values.items():
        k = k.replace("__", ".")
        old[k] = spark.conf.get(k, None)
        spark.conf.set(k, str(v).lower() if isinstance(v, bool) else str(v))
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table. Its times are UTC without a zone, so the session's zone is set to UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clear_shared(spark: SparkSession) -> None:
    """Removes everything this package wrote to the shared folder: results of queries that read from there are lost."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/spoolwright")
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
