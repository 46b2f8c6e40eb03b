"""Queries p5 to p8. What SQL can express is in ``oracle``; tests/llm holds all against brute force."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialise, table
from .batch_dedup import AcceptedIndex, check_batch
from .leakage import leaks
from .oracle import SQL
from .packing import CAPACITY, pack, pack_documents
from .splitting import LEAST_FILL, LIMIT, split_documents
from .tokens import with_token_count


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = AcceptedIndex.build(table(spark, sf_dir, "records"))
    found = check_batch(index, table(spark, sf_dir, "new_records"))
    index.drop()
    return found


#: Deliveries in which ``p5_batches`` takes the new records, each of some consecutive batches.
DELIVERIES = 6


def p5_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The new records delivery after delivery, each against the index to which the ones before were appended, and which
    is opened anew each time."""
    index = AcceptedIndex.build(table(spark, sf_dir, "records"))
    new = table(spark, sf_dir, "new_records")
    numbers = sorted(r[0] for r in new.select("batch_no").distinct().collect() if r[0] is not None)
    last = numbers[-1] if numbers else None
    size, found = -(-len(numbers) // DELIVERIES) or 1, []
    for at in range(0, len(numbers), size):
        here = F.col("batch_no").isin(numbers[at : at + size])
        if numbers[at : at + size][-1] == last:  # what has no batch comes with the last ones
            here = here | F.col("batch_no").isNull()
        found.append(check_batch(AcceptedIndex.open(spark, index.path), new.where(here)))
    index.drop()
    return reduce(DataFrame.unionByName, found or [check_batch(index, new)])


def p6_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers are: one row."""
    packed = p6_packed(spark, sf_dir)
    return packed.agg(
        F.count_distinct("container").alias("containers"),
        F.sum("n_tokens").alias("tokens"),
        (F.sum("n_tokens") / (F.count_distinct("container") * CAPACITY)).alias("fill"),
    )


def p6_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What any right packing has: documents placed, containers that hold too much, gaps in the numbers of containers and
    of places, documents split that would have fit, documents that lost tokens, and whether containers are 95 % full."""
    sized = materialise(with_token_count(table(spark, sf_dir, "documents"), "doc_id", "text"), "sized")
    packed = materialise(pack(sized, "doc_id", "n_tokens"), "packed")
    each = packed.groupBy("container").agg(
        F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("k"), F.count_distinct("place").alias("places"), F.max("place").alias("last")
    )
    boxes = each.agg(
        F.count_if(F.col("n") > CAPACITY).alias("overfull"),
        (F.coalesce(F.max("container") + 1 - F.count(F.lit(1)), F.lit(0)) + F.count_if((F.col("k") != F.col("places")) | (F.col("k") != F.col("last") + 1))).alias("gaps"),
        F.coalesce(F.sum("n") >= 0.95 * CAPACITY * F.count(F.lit(1)), F.lit(True)).alias("full"),
    )
    whole = packed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum("n_tokens").alias("n"))
    docs = sized.join(whole.withColumnRenamed("n", "placed"), "doc_id", "left").agg(
        F.count("placed").alias("documents"),
        F.count_if((F.col("pieces") > 1) & (F.col("n_tokens") <= CAPACITY)).alias("split"),
        F.count_if(F.coalesce(F.col("placed") != F.col("n_tokens"), F.lit(True))).alias("lost"),
    )
    return docs.crossJoin(F.broadcast(boxes))  # one row beside one row


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tile of 13 words, or of all words of a shorter item."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("item_id", "doc_id")


def p7_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of which tiles of five words and more, in any order, cover at least 0.8."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), min_tile=5, seed_words=5, min_coverage=0.8)


def p8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_documents(table(spark, sf_dir, "documents"))


def p8_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What any right splitting has: for each document that is split, its text put together again from the pieces, and
    whether all pieces are within the limit, all but the last are half full, and each begins within the one before."""
    cut = materialise(p8_pieces(spark, sf_dir), "cut")
    before = Window.partitionBy("doc_id").orderBy("piece")  # the pieces of a document
    new = F.substring("text", F.coalesce(F.lag("stop").over(before), F.lit(0)) - F.col("start") + 1, 2**31 - 1)
    told = cut.withColumns({"new": new, "back": F.lag("stop").over(before) - F.col("start"), "next": F.lead("piece").over(before)})
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "new"))), lambda x: x["new"]), "")
    return told.groupBy("doc_id").agg(
        F.md5(joined.cast("binary")).alias("text_md5"),
        (F.max("n_tokens") <= LIMIT).alias("within"),
        F.every(F.col("next").isNull() | (F.col("n_tokens") >= LIMIT * LEAST_FILL)).alias("filled"),
        F.every((F.col("piece") == 0) | (F.col("back") > 0)).alias("overlapping"),
    )


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_pieces(spark, sf_dir).where("piece = 0").select("doc_id")


QUERIES = {
    "p5_found": p5_found,
    "p5_batches": p5_batches,
    "p6_packed": p6_packed,
    "p6_fill": p6_fill,
    "p6_checked": p6_checked,
    "p7_found": p7_found,
    "p7_coverage": p7_coverage,
    "p8_found": p8_found,
    "p8_pieces": p8_pieces,
    "p8_checked": p8_checked,
}

__all__ = ["QUERIES", "SQL"]
