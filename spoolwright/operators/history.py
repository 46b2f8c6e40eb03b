"""History of changing attributes: every version of an entity with the period it was valid.

Consecutive snapshots meet in null-safe full outer joins: an entity that only the later one has was inserted, one that
only the earlier one has was deleted, one that both have with other attributes was changed. The events of all pairs are
united, and ``lead`` makes periods of them. Snapshots are given as tables (``versions_of_snapshots``), or are folded from
a log of updates (``versions``): there an entity's n-th snapshot is its state after the n-th time it was told something,
an entity without attributes is absent from it, and one join holds all consecutive pairs.

An entity with a third of all rows must not become one task's window. The time of entities with more than
``rows_per_period`` rows is therefore cut into periods, of about so many rows of all such entities together, so that no
entity has more in one (but for rows of a single time). Folding, differencing and ``lead`` work within (entity,
period); what crosses a period's edge, the state an entity enters with and the time of its next event, is carried by
windows over one row for each such entity and period.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_small, conf, materialise

ROWS_PER_PERIOD = 250_000


def with_periods(df: DataFrame, entity: str, at: str, rows_per_period: int) -> DataFrame:
    """``df`` with ``period``: 0 for entities of at most ``rows_per_period`` rows, else from 1 in order of ``at``.
    ``df`` is read to count its entities and, if some have more rows, for quantiles of those."""
    sizes = df.groupBy(entity).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > rows_per_period)
    large = materialise(sizes, "large-entities")  # at most one for each rows_per_period rows
    n = large.agg(F.sum("__n")).first()[0]
    if not n:
        return df.withColumn("period", F.lit(0))
    large = broadcast_if_small(large.select(F.col(entity).alias("__e"), F.lit(True).alias("__large")))
    marked = df.join(large, F.col(entity) == F.col("__e"), "left").drop("__e")
    want = -(-n // rows_per_period)
    # as many quantiles as there are periods: one for each rows_per_period rows
    cuts = marked.where("__large").agg(F.percentile_approx(at, [i / want for i in range(1, want)], 10 * want)).first()[0] or []
    split = Bucketizer(splits=[float("-inf"), *sorted({float(x) for x in cuts}), float("inf")], inputCol="__at", outputCol="__p", handleInvalid="keep")
    cut = split.transform(marked.withColumn("__at", F.col(at).cast("double")))
    return cut.withColumn("period", F.when(F.col("__large"), F.col("__p").cast("int") + 1).otherwise(0)).drop("__at", "__p", "__large")


def _any_set(attributes: Sequence[str]) -> Column:
    return reduce(lambda x, y: x | y, [F.col(a).isNotNull() for a in attributes])


def _differences(before: DataFrame, after: DataFrame, on: Sequence[str], attributes: Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
    """Change events between two snapshots that are unique in ``on``, which never is null: ``on``, ``kind``, the attributes as they
    are now (null if deleted), and of ``carry`` the later snapshot's value, or the earlier one's for what was deleted.
    The three kinds are told apart in one pass over the join, which is their union."""
    meet = reduce(lambda x, y: x & y, [F.col(f"b.{c}").eqNullSafe(F.col(f"a.{c}")) for c in on])
    pair = before.withColumn("__in", F.lit(True)).alias("b").join(after.withColumn("__in", F.lit(True)).alias("a"), meet, "full_outer")
    differs = reduce(lambda x, y: x | y, [~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in attributes])
    kind = F.when(F.col("b.__in").isNull(), "inserted").when(F.col("a.__in").isNull(), "deleted").when(differs, "changed")
    out = pair.select(
        *[F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in [*on, *carry]], kind.alias("kind"), *[F.col(f"a.{a}").alias(a) for a in attributes]
    )
    return out.where("kind IS NOT NULL")


def snapshot_changes(before: DataFrame, after: DataFrame, key: Sequence[str], attributes: Sequence[str]) -> DataFrame:
    """``key``, ``kind`` (inserted, changed, deleted) and the attributes as ``after`` has them, of every entity that two
    complete snapshots tell differently.

    Defined cases: null keys are an entity; an entity that a snapshot has without any attribute, or lacks, isn't there;
    of several rows of an entity in a snapshot that with the greatest attributes counts; empty snapshots delete or
    insert all; extra columns are ignored.
    """

    def whole(df: DataFrame) -> DataFrame:
        rows = df.where(_any_set(attributes)).groupBy(F.struct(*key).alias("__e")).agg(F.max(F.struct(*attributes)).alias("__a"))
        return rows.select("__e", *[F.col(f"__a.{a}").alias(a) for a in attributes])

    events = _differences(whole(before), whole(after), ["__e"], attributes)
    return events.select(*[F.col(f"__e.{k}").alias(k) for k in key], "kind", *attributes)


def versions_of_snapshots(snapshots: Sequence[tuple[int, DataFrame]], key: Sequence[str], attributes: Sequence[str]) -> DataFrame:
    """``versions`` of complete snapshots, each with its time: the events of all consecutive pairs united, with the
    period until the entity's next. An entity has at most one event a snapshot, which bounds the window."""
    if not snapshots:
        raise ValueError("no snapshots")
    snapshots = sorted(snapshots, key=lambda s: s[0])
    before = snapshots[0][1].limit(0)
    events = []
    for at, after in snapshots:
        events.append(snapshot_changes(before, after, key, attributes).withColumn("valid_from", F.lit(at).cast("bigint")))
        before = after
    united = reduce(DataFrame.unionByName, events)
    return united.withColumn("valid_to", F.lead("valid_from").over(Window.partitionBy(*key).orderBy("valid_from"))).select(
        *key, "kind", *attributes, "valid_from", "valid_to"
    )


def snapshots_of_updates(updates: DataFrame, key: Sequence[str], attributes: Sequence[str], times: Sequence[int]) -> list[tuple[int, DataFrame]]:
    """The complete snapshots at some times, folded from a log of updates as ``versions`` takes it: of each attribute
    the latest that was said of it by then. Aggregated, with one state an entity and task, so a hot entity is no window."""
    out = []
    for t in times:
        told = updates.where(F.col("at") <= t)
        latest = [F.max_by(F.struct(F.col(a).alias("v")), F.when(F.col(f"set_{a}"), F.struct("at", "seq"))).alias(a) for a in attributes]
        out.append((t, told.groupBy(*key).agg(*latest).select(*key, *[F.col(f"{a}.v").alias(a) for a in attributes])))
    return out


def versions(updates: DataFrame, key: Sequence[str], attributes: Sequence[str], rows_per_period: int = ROWS_PER_PERIOD) -> DataFrame:
    """Change events with the period until the next: ``key``, ``kind`` (inserted, changed, deleted), the attributes,
    ``valid_from`` and ``valid_to`` (null if there is no later event).

    ``updates`` has the key, ``at`` (bigint), ``seq`` (order within a time), and for each attribute ``a`` the value
    ``a`` and the flag ``set_a``, whether the row says anything of it; a value of null unsets. A version begins when
    the attributes differ, null-safely, from those before, and at least one is set.

    Defined cases: null keys are an entity; rows without ``at`` cannot be placed and are left out; of rows with equal
    ``at`` and ``seq`` any may come last; a row that changes nothing makes no event; an empty table gives no rows;
    extra columns are ignored, whatever their names.
    """
    spark = updates.sparkSession
    # the entity is one column from here on, a struct that is never null, with nulls inside equal to nulls
    rows = updates.where(F.col("at").isNotNull()).select(
        F.struct(*key).alias("e"), "at", "seq", *[F.when(F.col(f"set_{a}"), F.struct(F.col(a).alias("v"))).alias(a) for a in attributes]
    )
    rows = with_periods(materialise(rows, "updates"), "e", "at", rows_per_period)
    group = ["e", "period"]

    # what an entity with several periods has been told when it enters one; a null struct: nothing said yet
    at_end = rows.where("period > 0").groupBy(*group).agg(
        *[F.max_by(a, F.when(F.col(a).isNotNull(), F.struct("at", "seq"))).alias(a) for a in attributes]
    )
    before = Window.partitionBy("e").orderBy("period").rowsBetween(Window.unboundedPreceding, -1)
    entry = at_end.select(*group, F.lit(None).cast("bigint").alias("at"), F.lit(None).cast("bigint").alias("seq"), *[F.last(a, ignorenulls=True).over(before).alias(a) for a in attributes])

    # folding to snapshots, the entry (without a time) being the first of its period
    order = Window.partitionBy(*group).orderBy("at", "seq")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    told = rows.select(*group, "at", F.col("seq").cast("bigint").alias("seq"), *attributes).unionByName(entry)
    told = told.select(*group, "at", F.lead("at").over(order).alias("until"), *[F.last(a, ignorenulls=True).over(so_far)["v"].alias(a) for a in attributes])
    ends = told.where(F.col("until").isNull() | ~F.col("until").eqNullSafe(F.col("at")))
    snaps = ends.withColumn("n", F.row_number().over(Window.partitionBy(*group).orderBy("at"))).where(_any_set(attributes))
    snaps = materialise(snaps, "snapshots")

    # each snapshot beside the one before it; both sides lie by (entity, period), which serves the join and the window
    with conf(spark, spark__sql__requireAllClusterKeysForCoPartition=False):
        laid = snaps.repartition(*group)
        earlier = laid.where("until IS NOT NULL").select(*group, (F.col("n") + 1).alias("n"), F.col("until").alias("at"), *attributes)
        events = _differences(earlier, laid.where("at IS NOT NULL").drop("until"), [*group, "n"], attributes, ["at"])
        nearest = F.lead("at").over(Window.partitionBy(*group).orderBy("at"))
        events = materialise(events.select(*group, "at", "kind", *attributes, nearest.alias("next_at")), "events")

    first = events.where("period > 0").groupBy(*group).agg(F.min("at").alias("first_at"))
    later = first.select("e", "period", F.lead("first_at").over(Window.partitionBy("e").orderBy("period")).alias("later_at"))
    later = broadcast_if_small(materialise(later, "later-events"))
    timed = events.join(later, group, "left")
    return timed.select(
        *[F.col(f"e.{k}").alias(k) for k in key], "kind", *attributes, F.col("at").alias("valid_from"), F.coalesce("next_at", "later_at").alias("valid_to")
    )


#: Attributes that the log tells of an entity.
ATTRIBUTES = ["tier", "state", "zone", "quota", "owner"]
#: What is trimmed: characters up to U+0020 and the Unicode blanks.
BLANKS = "".join(map(chr, [*range(0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def tidy(c: Column) -> Column:
    """A value as it is compared: trimmed, in lower case; empty is null."""
    return F.nullif(F.lower(F.btrim(c, F.lit(BLANKS))), F.lit(""))


def parse_updates(df: DataFrame, text: Column, attributes: Sequence[str] = ATTRIBUTES) -> DataFrame:
    """``df`` with ``op`` (full, patch, drop, or null for text that says nothing) and for each attribute its value and
    ``set_`` flag. Three notations: a JSON object with ``op``; ``op; a=v; b=v``; the operation on the first line,
    then lines ``a: v``. The last of repeated attributes counts."""
    ops = "full|patch|drop"
    t, said = F.col("__t"), F.col("__said")

    def entries(parts: Column, sign: str) -> Column:
        """Key and value of the parts behind the first that have the sign."""
        rest = F.filter(parts, lambda p, i: (i > 0) & F.contains(p, F.lit(sign)))
        return F.transform(
            rest,
            lambda p: F.struct(F.btrim(F.substring_index(p, sign, 1), F.lit(BLANKS)).alias("key"), F.substring(p, F.instr(p, F.lit(sign)) + 1, F.length(p)).alias("value")),
        )

    def last(name: str) -> Column:
        return F.try_element_at(F.filter(said, lambda e: e["key"] == name), F.lit(-1))

    # all notations become an operation and entries of key and value; each step is a projection of its own, so that
    # nothing is computed twice
    out = df.withColumn("__t", F.btrim(text, F.lit(BLANKS)))
    out = out.withColumn(
        "__said",
        F.when(t.startswith("{"), F.map_entries(F.from_json(t, "map<string, string>")))
        .when(t.rlike(rf"^(?i:{ops})[ \t]*(;[^\r\n]*)?$"), entries(F.split(t, ";"), "="))
        .when(t.rlike(rf"^({ops.upper()})[ \t]*\r?\n"), entries(F.split(t, "\r?\n"), ":")),
    )
    op = F.when(t.startswith("{"), last("op")["value"]).otherwise(F.regexp_extract(t, "^[A-Za-z]+", 0))
    op = F.when(said.isNotNull(), tidy(op))
    out = out.withColumns({"op": F.when(op.isin(*ops.split("|")), op), **{f"__{a}": last(a) for a in attributes}})
    keep = [c for c in df.columns if c != "op" and c not in attributes and not c.startswith("set_")]
    columns = []
    for a in attributes:
        columns += [
            F.when(F.col("op") != "drop", tidy(F.col(f"__{a}.value"))).alias(a),
            F.coalesce(F.col("op").isNotNull() & ((F.col("op") != "patch") | F.col(f"__{a}").isNotNull()), F.lit(False)).alias(f"set_{a}"),
        ]
    return out.select(*keep, "op", *columns)
