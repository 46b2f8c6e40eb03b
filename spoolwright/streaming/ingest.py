"""Ingest of spool files as bounded micro-batches, exactly once."""

from __future__ import annotations

import hashlib
import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.store import LogStore
from ..sources.files import SAVED_GLOB, decode_saved
from ..session import fresh_path
from ..storage import fs_of as _fs

log = logging.getLogger(__name__)
#: Bytes of files in a batch, about; files stay whole.
BATCH_BYTES = 256 << 20


def update(store: LogStore, path: str, checkpoint: str | None = None, delete: bool = True, batch_bytes: int = BATCH_BYTES, trigger: dict | None = None) -> dict[str, int]:
    """Reads all spool files below ``path`` that weren't read yet, adds their records, and with ``delete`` removes each
    batch's files once its records are stored. Ends when nothing is left, or runs on with another ``trigger``.

    A batch that is read again adds nothing, since the store knows its records; so a crash between storing and deleting
    is harmless, and a bad file fails its batch, which then stores and deletes nothing. The state that finds duplicates
    is the store, which forgets nothing: old timestamps are always accepted.

    Which files were read is kept in ``checkpoint``. Unset, it is a folder of the store's own for this path where files
    stay, so that the next run reads only new ones, and one for this run alone where they are removed, as then those
    that are there are those to read, even under a name that was used before.
    """
    spark = store.spark
    counts = {"seen": 0, "added": 0, "duplicates": 0}

    def one(batch: DataFrame, batch_id: int) -> None:
        files = [r["path"] for r in batch.select("path").distinct().collect()]  # as many as a batch has files
        got = store.add_records(decode_saved(batch.select("path", "content")))
        for k, v in got.items():
            counts[k] += v
        log.info("batch %d: %s", batch_id, got)
        if delete:
            for f in files:
                fs, p = _fs(spark, f)
                fs.delete(p, False)

    store.create()
    lasting = f"{store.path}/ingest/{hashlib.sha256(path.encode()).hexdigest()[:16]}"
    at = checkpoint or (fresh_path(spark, "ingest") if delete else lasting)
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    stream = (
        spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", SAVED_GLOB)
        .option("recursiveFileLookup", "true").option("maxBytesPerTrigger", batch_bytes).load(path)
    )
    q = stream.writeStream.foreachBatch(one).option("checkpointLocation", at)
    try:
        q.trigger(**(trigger or {"availableNow": True})).start().awaitTermination()
    finally:
        if not checkpoint and delete:
            fs, p = _fs(spark, at)
            fs.delete(p, True)
    return counts


def convert(store: LogStore, legacy: DataFrame) -> dict[str, int]:
    """Adds the records of legacy logs (``files.read_legacy``). The logs stay where they are."""
    return store.add_records(legacy.select("path", "pos", *[c for c in legacy.columns if c not in ("path", "pos")]))


def added_and_duplicates(batch: DataFrame, store: DataFrame, key: list[str]) -> DataFrame:
    """Counts of a batch against a store without adding anything: seen, added, duplicates."""
    each = batch.groupBy(*key).agg(F.count(F.lit(1)).alias("__n"))
    known = store.select(*key).distinct().withColumn("__known", F.lit(True))
    each = each.join(known, key, "left")
    added = F.coalesce(F.sum(F.when(F.col("__known").isNull(), 1)), F.lit(0))
    seen = F.coalesce(F.sum("__n"), F.lit(0))
    return each.agg(seen.alias("seen"), added.cast("bigint").alias("added"), (seen - added).cast("bigint").alias("duplicates"))
