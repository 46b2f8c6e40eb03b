"""Queries of the general problems, p1 to p4."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.compaction import consolidate_spool
from ..operators.deliveries import first_deliveries, message_identity, repeated_deliveries
from ..functions.text import log_text
from ..operators.history import ATTRIBUTES, parse_updates, snapshots_of_updates, versions, versions_of_snapshots
from ..operators.tree_aggregate import tree_aggregate
from ..schema import KEY, id_key
from ..session import fresh_path, materialise, table
from . import adapters

#: A key is hot if its messages times this are all messages or more: 1 %.
HOT_PARTS = 100


def key_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages, first and last ts of each key; a message counts once."""
    records = table(spark, sf_dir, "records")
    messages = first_deliveries(records, message_identity(), F.col("record_seq"), [], [*KEY, "ts"])
    return tree_aggregate(
        messages, KEY, {"messages": ("count", F.lit(1)), "first_ts": ("min", "ts"), "last_ts": ("max", "ts")}
    )


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = materialise(key_stats(spark, sf_dir).select("table_name", id_key().alias("id_key"), "messages"), "key-stats")
    total = stats.agg(F.sum("messages")).first()[0] or 0  # one number
    return stats.where(F.col("messages") * HOT_PARTS >= F.lit(total)).select("table_name", "id_key")


def p1_key_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return key_stats(spark, sf_dir).select("table_name", id_key().alias("id_key"), "messages", "first_ts", "last_ts")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_deliveries(table(spark, sf_dir, "records"), message_identity(), "record_seq")


def p2_first_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other side of p2_found: one record_seq for each message."""
    records = table(spark, sf_dir, "records")
    return first_deliveries(
        records, message_identity(), F.col("record_seq"), [], ["record_seq", "table_name", "ts"]
    )


def consolidated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source records as the small files they come from, consolidated."""
    spool = adapters.scattered(table(spark, sf_dir, "source_records"), fresh_path(spark, "small-files"))
    return consolidate_spool(spark, spool, table(spark, sf_dir, "source_files"), fresh_path(spark, "spool"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consolidated(spark, sf_dir).where("small").select("table_name", "file_no").distinct()


def p3_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records in the consolidated files, without the bytes of their logs."""
    return consolidated(spark, sf_dir).select("table_name", "file_no", "pos", F.octet_length("log_bytes").alias("n_bytes"))


def p3_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each table the small files that held what counts of it, and the files that hold it now."""
    found = consolidated(spark, sf_dir).withColumn("at", F.input_file_name())
    return found.groupBy("table_name").agg(F.count_distinct("file_no").alias("files_before"), F.count_distinct("at").alias("files_after"))


def entity_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with the same key, ts and data count once, at their smallest record_seq. Notes that say nothing stay, as they
    change nothing; a filter on what is parsed would be pushed below the aggregation and parse every row twice."""
    rows = table(spark, sf_dir, "entity_records")
    once = rows.groupBy(*KEY, F.col("ts").alias("at"), "data").agg(F.min("record_seq").alias("seq"))
    return parse_updates(once.select("table_name", id_key().alias("id_key"), "at", "seq", "data"), log_text(F.col("data")))


def entity_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions(entity_updates(spark, sf_dir), ["table_name", "id_key"], ATTRIBUTES).where("kind <> 'deleted'")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = entity_versions(spark, sf_dir)
    return found.select("table_name", "id_key", "valid_from", F.coalesce("valid_to", F.lit(-1)).cast("bigint").alias("valid_to"))


def p4_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p4_found with the attributes of each version, and whether it began from nothing."""
    found = entity_versions(spark, sf_dir)
    return found.select("table_name", "id_key", "kind", *ATTRIBUTES, "valid_from", F.coalesce("valid_to", F.lit(-1)).cast("bigint").alias("valid_to"))


#: Snapshots are taken at so many times, the last one at the last ts.
SNAPSHOTS = 6


def p4_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The versions that complete periodic snapshots tell, with what was deleted: an entity the next snapshot lacks."""
    updates = materialise(entity_updates(spark, sf_dir), "entity-updates")
    lo, hi = updates.agg(F.min("at"), F.max("at")).first()
    times = [lo + (hi - lo) * i // SNAPSHOTS for i in range(1, SNAPSHOTS + 1)] if lo is not None else [0]
    taken = [(t, materialise(s, "snapshot")) for t, s in snapshots_of_updates(updates, ["table_name", "id_key"], ATTRIBUTES, times)]
    found = versions_of_snapshots(taken, ["table_name", "id_key"], ATTRIBUTES)
    return found.select("table_name", "id_key", "kind", *ATTRIBUTES, "valid_from", F.coalesce("valid_to", F.lit(-1)).cast("bigint").alias("valid_to"))


QUERIES = {
    "p1_found": p1_found,
    "p1_key_stats": p1_key_stats,
    "p2_found": p2_found,
    "p2_first_deliveries": p2_first_deliveries,
    "p3_found": p3_found,
    "p3_records": p3_records,
    "p3_files": p3_files,
    "p4_found": p4_found,
    "p4_versions": p4_versions,
    "p4_snapshots": p4_snapshots,
}
