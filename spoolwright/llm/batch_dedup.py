"""Each new batch against all that was accepted, by hashes that stay in bucketed tables.

The history is kept as hashes alone. A message's normalised content is its distinct words; of it are stored one exact
hash (16 bytes, over key and words) and the hashes of its parts (8 bytes each, over key and part). A log message is one
paragraph, whose hash would tell full copies alone, which the exact hash does; its parts are therefore its words.

* A batch is hashed once. Messages of equal hash are one class, found by hash aggregation.
* The classes go to the buckets of their keys; the bucketed tables are not shuffled, buckets that no class asks for
  aren't read, and no text of the history is. A bucket-local join by exact hash finds full copies. A bucket-local
  semi-join by part hash leaves of the history the parts that the batch shares, with how many their messages have, and
  from these the exact coverage of every pair is counted.
* A full copy doesn't settle which message is repeated: the answer is the oldest accepted message that is alike, and in
  a history, which may hold near copies, that can be an older one. It bounds what is searched for.
* Keys with more messages than a block takes are spread over several buckets by hash, and a new message of such a
  key goes to all of them, so a key with a third of all rows fills no task.
* In a batch, a message is held against those accepted before it, by halves: of any number of near copies each is
  compared with the few that were accepted. One row a message comes out, never the pairs.
* What is accepted is appended: its hashes, to the buckets of their keys. Buckets for keys that grew, and for all others
  as they grow together, come behind the old ones, so that a bucket's size is bounded and so is a batch's work in each.

The candidate search loses nothing: texts of ``n`` and ``m`` words with a share of at least ``t`` have at least
``ceil(t * n)`` words in common, so of any ``n - ceil(t * n) + k`` words of the one, the other has ``k`` or more. The
rarest words of the new message are taken, by their frequency in the bucket. Equal hashes of different words, one in
2**64 pairs, could tell a coverage wrong by a word.
"""

from __future__ import annotations

import hashlib
import uuid
from array import array
from collections.abc import Iterator
from fractions import Fraction
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import digest
from ..schema import KEY
from ..session import broadcast_if_small, conf, fresh_path, materialise
from ..storage import Manifest
from .words import record_text, word_set

SIMILARITY = Fraction(7, 10)
#: Weight of one key that a bucket takes; more is spread. A message weighs one, and one more for every 32 words.
BLOCK_ROWS = 50_000
#: Weight of a bucket, about.
BUCKET_ROWS = 25_000
#: Shared parts that make a candidate, where so many must be shared.
SEEDS = 3
#: Postings looked at in one go.
AT_ONCE = 4_000_000
#: Buckets that a batch may ask for by number; one that asks for more reads all.
ASKED = 10_000
#: Messages that are held against each other as they are; more are halved.
FEW = 64
#: Stands for the words of a text without any: such texts are copies of each other.
NO_WORDS = "\x00"


def _hash_of(word: str, known: dict[str, int]) -> int:
    if (n := known.get(word)) is None:
        if len(known) > 1_000_000:  # identifiers of all kinds; the words of the language come back soon
            known.clear()
        n = known[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
    return n


def contents(df: DataFrame, seq: str = "record_seq", collapse: bool = False) -> DataFrame:
    """``k`` (digest of the key), ``seq``, ``h`` (exact hash of key and content) and ``parts`` (hashes of key and part)
    of each row. With ``collapse``, copies within an Arrow batch leave as one row with the least ``seq``, so that a
    message that makes up a third of the rows isn't shuffled. Rows without ``seq`` are left out, as nothing could name
    them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for b in batches:
            ks, seqs, datas = (c.to_pylist() for c in b.columns)
            exact: list[bytes] = []
            texts: list[list[str]] = []
            for k, d in zip(ks, datas):
                words = sorted(word_set(record_text(d))) or [NO_WORDS]
                exact.append(hashlib.blake2b(k + " ".join(words).encode("utf-8", "surrogatepass"), digest_size=16).digest())
                texts.append(words)
            if collapse:
                least: dict[bytes, int] = {}
                for i, h in enumerate(exact):
                    if (j := least.get(h)) is None or seqs[i] < seqs[j]:
                        least[h] = i
                rows = list(least.values())
                ks, seqs, exact, texts = ([x[i] for i in rows] for x in (ks, seqs, exact, texts))
            parts, ends = array("Q"), [0]
            for words in texts:
                parts.extend([_hash_of(w, known) for w in words])
                ends.append(len(parts))
            keys = np.frombuffer(b"".join(k[:8] for k in ks), np.uint64)
            hashed = np.frombuffer(parts, np.uint64) ^ np.repeat(keys, np.diff(ends)) if ks else np.empty(0, np.uint64)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(hashed.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(ks, pa.binary()), pa.array(seqs, pa.int64()), pa.array(exact, pa.binary()), lists], ["k", "seq", "h", "parts"])

    rows = df.where(F.col(seq).isNotNull()).select(digest(*[F.col(c) for c in KEY]).alias("k"), F.col(seq).cast("bigint"), F.col("data"))
    return rows.mapInArrow(run, "k binary, seq bigint, h binary, parts array<bigint>")


def _weight() -> Column:
    return F.lit(1) + F.floor(F.size("parts") / 32)


class Layout:
    """Where messages of a key lie. A key of more weight than ``block_rows`` has blocks of its own, ``salts`` of them from
    bucket ``first`` on, over which its messages are spread by hash; all other keys share a set of buckets. A key that
    outgrows what it has gets more blocks behind all others, and when all others together outgrow theirs, there is
    another set for them; messages lie there from then on, and are looked for in the old ones as well. New ones are
    twice what is needed, so their number grows with the logarithm of the size."""

    def __init__(self, hot: DataFrame, cold: list[list[int]], after: int, block_rows: int, bucket_rows: int):
        """``hot`` has ``k, salts, first, last``; ``cold`` the sets of shared buckets, (first, count); ``after`` is the
        first bucket that isn't used."""
        self.hot, self.cold, self.next, self.block_rows, self.bucket_rows = hot, cold, after, block_rows, bucket_rows

    @classmethod
    def plan(cls, sizes: DataFrame, block_rows: int, bucket_rows: int) -> Layout:
        """``sizes`` has ``k`` and ``n``, a row for each key, and is materialised."""
        spark = sizes.sparkSession
        total = sizes.agg(F.sum("n")).first()[0] or 0
        n_cold = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // bucket_rows))
        large = sizes.where(F.col("n") > block_rows).select("k", F.ceil(F.col("n") / block_rows).cast("int").alias("salts"))
        before = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)  # over hot keys alone, a few
        hot = large.withColumn("first", (F.coalesce(F.sum("salts").over(before), F.lit(0)) + n_cold).cast("int")).withColumn("last", F.lit(True))
        hot = materialise(hot, "hot-keys")
        return cls(hot, [[0, n_cold]], n_cold + (hot.agg(F.sum("salts")).first()[0] or 0), block_rows, bucket_rows)

    @staticmethod
    def _in(cold: list[int]) -> Column:
        return (F.pmod(F.xxhash64("k"), F.lit(cold[1])) + cold[0]).cast("int")

    def grow(self, sizes: DataFrame, total: int) -> None:
        """Gives new blocks to the keys of ``sizes`` (``k`` and ``n``, a row for each key) that have more than their last
        blocks take, and new shared buckets if all keys together, ``total``, have twice what the last ones take."""
        had = self.hot.where("last").select("k", "salts")
        over = sizes.join(broadcast_if_small(had), "k", "left").where(F.col("n") > F.coalesce("salts", F.lit(1)) * self.block_rows)
        over = materialise(over, "outgrown")
        if not over.isEmpty():
            before = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)  # over keys that outgrew theirs, a few
            new = over.select("k", (2 * F.ceil(F.col("n") / self.block_rows)).cast("int").alias("salts"))
            new = new.withColumn("first", (F.coalesce(F.sum("salts").over(before), F.lit(0)) + self.next).cast("int")).withColumn("last", F.lit(True))
            shared = F.explode(F.array(*[self._in(c) for c in self.cold]))
            were_cold = over.where("salts IS NULL").select("k", F.lit(1).alias("salts"), shared.alias("first"), F.lit(False).alias("last"))
            kept = self.hot.join(over.select("k", F.lit(True).alias("out")), "k", "left").select("k", "salts", "first", (F.col("last") & F.col("out").isNull()).alias("last"))
            self.hot = materialise(kept.unionByName(were_cold).unionByName(new), "hot-keys")
            self.next += new.agg(F.sum("salts")).first()[0]
        if total > 2 * self.cold[-1][1] * self.bucket_rows:
            self.cold.append([self.next, -(-2 * total // self.bucket_rows)])
            self.next += self.cold[-1][1]

    def placed(self, rows: DataFrame) -> DataFrame:
        """Each message with its one bucket."""
        out = rows.join(broadcast_if_small(self.hot.where("last")), "k", "left")
        own = (F.col("first") + F.pmod(F.xxhash64("h"), F.col("salts"))).cast("int")
        return out.select(F.coalesce(own, self._in(self.cold[-1])).alias("bucket"), *rows.columns)

    def asked(self, rows: DataFrame) -> DataFrame:
        """Each message with every bucket that may hold something of its key."""
        out = rows.join(broadcast_if_small(self.hot), "k", "left")
        own = F.sequence(F.col("first"), F.col("first") + F.col("salts") - 1)
        return out.select(F.explode(F.coalesce(own, F.array(*[self._in(c) for c in self.cold]))).alias("bucket"), *rows.columns)


def similar_pairs(
    rows: np.ndarray, codes: np.ndarray, lens: np.ndarray, q_codes: np.ndarray, q_lens: np.ndarray, least: Fraction = SIMILARITY
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers (new, old) of all pairs whose contents share at least ``least`` of all their parts; no pair comes
    twice. Of the old ones, ``rows`` and ``codes`` are postings, row by part, of which those whose part no new one
    has may be missing, and one may come twice; ``lens`` are their numbers of parts. Of the new ones, the parts lie
    one after another in ``q_codes``, ``q_lens`` of each."""
    if not len(rows) or not len(q_lens):
        return
    uniq, inverse = np.unique(codes, return_inverse=True)
    held = np.unique(rows * len(uniq) + inverse)  # (row, part) of the old ones
    rows, inverse = held // len(uniq), held % len(uniq)
    counts = np.bincount(inverse, minlength=len(uniq))
    starts = np.concatenate(([0], np.cumsum(counts)[:-1]))
    postings = rows[np.argsort(inverse, kind="stable")]

    q_rows = np.repeat(np.arange(len(q_lens)), q_lens)
    at = np.minimum(np.searchsorted(uniq, q_codes), len(uniq) - 1)
    freq = np.where(uniq[at] == q_codes, counts[at], 0)
    order = np.lexsort((freq, q_rows))
    at, freq = at[order], freq[order]
    q_starts = np.concatenate(([0], np.cumsum(q_lens)[:-1]))
    num, den = least.numerator, least.denominator
    need = -(-q_lens * num // den)
    seeds = np.minimum(SEEDS, np.maximum(need, 1))
    prefix = np.arange(len(q_rows)) - q_starts[q_rows] < (q_lens - need + seeds)[q_rows]
    load = np.where(prefix, freq, 0)
    ends = np.cumsum(np.bincount(q_rows, load, len(q_lens)))
    first = 0
    while first < len(q_lens):
        done = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, done + AT_ONCE, side="right")))
        lo, hi = q_starts[first], q_starts[last - 1] + q_lens[last - 1]
        pick = np.flatnonzero(load[lo:hi]) + lo
        f = freq[pick]
        # all postings of the picked words, one after another
        shift = np.repeat(starts[at[pick]] - np.concatenate(([0], np.cumsum(f)[:-1])), f) if len(f) else np.empty(0, np.int64)
        old = postings[shift + np.arange(len(shift))]
        new = np.repeat(q_rows[pick], f)
        fits = (lens[old] * den >= q_lens[new] * num) & (q_lens[new] * den >= lens[old] * num)
        pair, hits = np.unique(new[fits] * len(lens) + old[fits], return_counts=True)
        new, old = pair // len(lens), pair % len(lens)
        good = hits >= seeds[new]
        new, old = new[good], old[good]
        for c in range(0, len(new), 100_000):
            a, b = new[c : c + 100_000], old[c : c + 100_000]
            n = q_lens[a]
            each = np.repeat(np.arange(len(a)), n)
            word = np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n) + q_starts[a][each]
            code = b[each] * len(uniq) + at[word]
            found = (freq[word] > 0) & (held[np.minimum(np.searchsorted(held, code), len(held) - 1)] == code)
            both = np.bincount(each, found, len(a)).astype(np.int64)
            yes = both * den >= num * (n + lens[b] - both)
            if yes.any():
                yield a[yes], b[yes]
        first = last


_BEST = pa.schema([("seq", pa.int64()), ("best", pa.int64())])
_NONE = np.iinfo(np.int64).max


def _parts(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """All parts of all rows, one after another, and the number of parts of each row."""
    lists = t.column("parts").combine_chunks()
    lists = lists if isinstance(lists, pa.ListArray) else pa.chunked_array(lists).combine_chunks()
    return np.asarray(lists.flatten()), np.asarray(lists.value_lengths())


def _best(seq: np.ndarray, best: np.ndarray) -> pa.Table:
    return pa.table([pa.array(seq, pa.int64()), pa.array(best, pa.int64(), mask=best == _NONE)], schema=_BEST)


def _oldest_match(index: pa.Table, batch: pa.Table) -> pa.Table:
    """For each new message the least seq that it repeats in this bucket, if less than what it is known to repeat."""
    new_seq, best = batch.column("seq").to_numpy(), batch.column("best").to_numpy().copy()
    seqs, first, rows = np.unique(index.column("seq").to_numpy(), return_index=True, return_inverse=True)
    lens = index.column("n").to_numpy()[first]
    hit = np.zeros(len(new_seq), bool)
    for new, old in similar_pairs(rows, index.column("p").to_numpy(), lens, *_parts(batch)):
        keep = (seqs[old] < best[new]) & (seqs[old] != new_seq[new])  # itself, if its batch is checked again
        np.minimum.at(best, new[keep], seqs[old[keep]])
        hit[new[keep]] = True
    return _best(new_seq[hit], best[hit])


def settle(seqs: np.ndarray, codes: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """For each message, in order of ``seqs``, the least accepted one before it that it repeats; accepted are those that
    repeat none. The first half is settled by itself; what of the second repeats nothing accepted there is then
    settled in the same way. An accepted message of the first half is older than all of the second, so the least is right."""
    ends = np.cumsum(lens)
    best = np.full(len(seqs), _NONE)

    def pick(who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = lens[who]
        at = np.repeat(ends[who] - n - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return codes[at], n

    def pairs(old: np.ndarray, new: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        (c, n), (q, m) = pick(old), pick(new)
        return similar_pairs(np.repeat(np.arange(len(old)), n), c, n, q, m)

    def go(who: np.ndarray) -> None:
        if len(who) <= FEW:
            earlier: dict[int, list[int]] = {}
            for new, old in pairs(who, who):
                for a, b in zip(new.tolist(), old.tolist()):
                    if b < a:
                        earlier.setdefault(a, []).append(b)
            for a in sorted(earlier):
                best[who[a]] = min((seqs[who[b]] for b in earlier[a] if best[who[b]] == _NONE), default=_NONE)
            return
        half, rest = who[: len(who) // 2], who[len(who) // 2 :]
        go(half)
        half = half[best[half] == _NONE]
        for new, old in pairs(half, rest):
            np.minimum.at(best, rest[new], seqs[half[old]])
        rest = rest[best[rest] == _NONE]
        if len(rest):
            go(rest)

    if len(seqs):
        go(np.arange(len(seqs)))
    return best


def _settle(t: pa.Table) -> pa.Table:
    t = t.sort_by("seq")
    seqs = t.column("seq").to_numpy()
    return _best(seqs, settle(seqs, *_parts(t)))


class AcceptedIndex:
    """The accepted messages' hashes in a folder: bucketed tables, and a manifest that tells of them. ``open`` reads the
    manifest alone. Appending what is there already changes no answer, so a batch that broke off is checked again."""

    def __init__(self, spark: SparkSession, path: str, layout: Layout, tables: list[dict], weight: int):
        self.spark, self.path, self.layout, self.tables, self.weight = spark, path, layout, tables, weight
        self._names: dict[str, str] = {}

    @classmethod
    def build(cls, history: DataFrame, path: str | None = None, block_rows: int = BLOCK_ROWS, bucket_rows: int = BUCKET_ROWS) -> AcceptedIndex:
        spark, path = history.sparkSession, path or fresh_path(history.sparkSession, "accepted")
        weight = F.lit(1) + F.floor(F.coalesce(F.octet_length("data"), F.lit(0)) / 256)
        sizes = history.groupBy(*KEY).agg(F.sum(weight).alias("__n")).select(digest(*[F.col(c) for c in KEY]).alias("k"), F.col("__n").alias("n"))
        sizes.write.parquet(f"{path}/sizes")
        sizes = spark.read.parquet(f"{path}/sizes")
        index = cls(spark, path, Layout.plan(sizes, block_rows, bucket_rows), [], sizes.agg(F.sum("n")).first()[0] or 0)
        index._write(contents(history, collapse=True))
        index._save()
        return index

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> AcceptedIndex:
        m = Manifest(spark, f"{path}/manifest").read()
        if m is None:
            raise FileNotFoundError(f"no index in {path}")
        hot = spark.read.schema("k binary, salts int, first int, last boolean").parquet(m["hot"])
        return cls(spark, path, Layout(hot, m["cold"], m["next"], m["block_rows"], m["bucket_rows"]), m["tables"], m["weight"])

    def _save(self) -> None:
        at, l = f"{self.path}/hot/{uuid.uuid4().hex}", self.layout
        l.hot.write.parquet(at)
        state = {"hot": at, "cold": l.cold, "next": l.next, "block_rows": l.block_rows, "bucket_rows": l.bucket_rows}
        Manifest(self.spark, f"{self.path}/manifest").write(state | {"tables": self.tables, "weight": self.weight})

    def append(self, rows: DataFrame) -> None:
        """Adds messages (``k, seq, h, parts``) to the buckets of their keys. Of what is there, the keys' sizes alone are
        read. The manifest is written last."""
        new = materialise(rows.groupBy("k").agg(F.sum(_weight()).alias("n")), "new-sizes")
        sizes = self.spark.read.schema("k binary, n bigint").parquet(f"{self.path}/sizes")
        held = sizes.join(broadcast_if_small(new.select("k")), "k", "left_semi")
        self.weight += new.agg(F.sum("n")).first()[0] or 0
        self.layout.grow(new.unionByName(held).groupBy("k").agg(F.sum("n").alias("n")), self.weight)
        new.coalesce(1).write.mode("append").parquet(f"{self.path}/sizes")
        self._write(rows)
        self._save()

    def _write(self, rows: DataFrame) -> None:
        most = int(self.spark.conf.get("spark.sql.sources.bucketing.maxBuckets"))
        if not self.tables or min(self.layout.next, most) > 2 * self.tables[-1]["n"]:  # buckets enough for another table
            self.tables.append({"path": f"{self.path}/hashes/{len(self.tables)}", "n": min(self.layout.next, most)})
        t = self.tables[-1]
        out = self.layout.placed(rows).select("bucket", "h", "seq", "parts").repartition(t["n"], "bucket")
        out.write.mode("append").format("parquet").bucketBy(t["n"], "bucket").option("path", t["path"]).saveAsTable(self._name(t, create=False))

    def _name(self, t: dict, create: bool = True) -> str:
        """The table's name in this session's catalogue, where it is entered when it is first asked for."""
        if t["path"] not in self._names:
            name = self._names[t["path"]] = f"accepted_{uuid.uuid4().hex}"
            there = self.spark._jvm.org.apache.hadoop.fs.Path(t["path"])
            if create or there.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(there):
                columns = "bucket INT, h BINARY, seq BIGINT, parts ARRAY<BIGINT>"
                self.spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (bucket) INTO {t['n']} BUCKETS LOCATION '{t['path']}'")
        return self._names[t["path"]]

    def held(self, buckets: list[int] | None = None) -> list[DataFrame]:
        """All accepted messages, or those of some buckets, of each table; files of other buckets aren't read."""
        found = [self.spark.table(self._name(t)) for t in self.tables]
        return found if buckets is None else [t.where(F.col("bucket").isin(buckets)) for t in found]

    def drop(self) -> None:
        """Forgets the tables' names; their files stay."""
        for name in self._names.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self._names = {}


def _against_history(index: AcceptedIndex, classes: DataFrame) -> DataFrame:
    """``seq`` and ``best``, the oldest accepted message that it repeats, of the classes that repeat one."""
    asked = materialise(index.layout.asked(classes), "asked")
    numbers = asked.select("bucket").distinct().limit(ASKED + 1).collect()
    buckets = sorted(r[0] for r in numbers) if len(numbers) <= ASKED else None
    found = []
    # the tables lie by bucket, and joins by bucket and hash leave them there
    with conf(index.spark, spark__sql__requireAllClusterKeysForCoPartition=False):
        for held, t in zip(index.held(buckets), index.tables):
            here = asked.repartition(t["n"], "bucket")
            copies = held.select("bucket", "h", F.col("seq").alias("old")).join(here.select("bucket", "h", "seq").hint("shuffle_hash"), ["bucket", "h"])
            copies = materialise(copies.where("old <> seq").groupBy("seq").agg(F.min("old").alias("best")), "copies")
            new = asked.join(copies, "seq", "left").select("bucket", "seq", F.coalesce("best", F.lit(_NONE)).alias("best"), "parts").repartition(t["n"], "bucket")
            shared = held.select("bucket", "seq", F.size("parts").alias("n"), F.explode("parts").alias("p"))
            wanted = here.select("bucket", F.explode("parts").alias("p"))
            shared = shared.join(wanted.hint("shuffle_hash"), ["bucket", "p"], "left_semi")
            older = shared.groupBy("bucket").cogroup(new.groupBy("bucket")).applyInArrow(_oldest_match, "seq bigint, best bigint")
            found.append(materialise(copies.unionByName(older).groupBy("seq").agg(F.min("best").alias("best")), "matched"))
    if len(found) == 1:
        return found[0]
    return materialise(reduce(DataFrame.unionByName, found).groupBy("seq").agg(F.min("best").alias("best")), "matched")


def _within_batch(fresh: DataFrame, block_rows: int, bucket_rows: int) -> DataFrame:
    """``seq`` and ``best`` (null: accepted) of messages that repeat nothing accepted so far.

    The messages of a key are settled in one task, in order. A key with more than a block of them is settled block by
    block: a round holds a block against what was accepted of the key's earlier ones, in a task each, and settles
    the rest. There are as many rounds as the largest key has blocks.
    """
    spark = fresh.sparkSession
    sizes = materialise(fresh.groupBy("k").agg(F.sum(_weight()).alias("n")), "fresh-sizes")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // bucket_rows))
    large = sizes.where(F.col("n") > block_rows).select("k", F.ceil(F.col("n") / block_rows).cast("int").alias("blocks"))
    large = materialise(large, "large-keys")
    if large.isEmpty():
        marked = fresh.withColumns({"large": F.lit(False), "starts": F.array().cast("array<bigint>")})
    else:
        # where a large key's blocks begin: quantiles of its seqs, as many as the largest key has blocks
        most = large.agg(F.max("blocks")).first()[0]
        of_large = fresh.select("k", "seq").join(broadcast_if_small(large), "k")
        starts = F.percentile_approx("seq", [i / most for i in range(1, most)], 100 * most).alias("starts")
        own = materialise(of_large.groupBy("k").agg(starts).withColumn("large", F.lit(True)), "block-starts")
        marked = fresh.join(broadcast_if_small(own), "k", "left")
    block = F.coalesce(F.size(F.filter("starts", lambda x: x <= F.col("seq"))), F.lit(0))
    marked = marked.select("k", "seq", "parts", block.alias("block"), F.pmod(F.xxhash64("k"), F.lit(groups)).cast("int").alias("g"), F.coalesce("large", F.lit(False)).alias("large"))
    marked = materialise(marked, "blocks")
    # a large key is a group of its own; others share groups
    group = [F.when(F.col("large"), F.col("k")).alias("own"), "g"]
    rounds = (marked.agg(F.max("block")).first()[0] or 0) + 1
    done: DataFrame | None = None
    for r in range(rounds):
        now = marked.where(F.col("block") == r).select("seq", "k", "parts", *group)
        if done is not None:
            so_far = marked.join(done.where("best IS NULL").select("seq"), "seq", "left_semi").where("large")
            old = so_far.select(F.col("k").alias("k"), F.col("block").alias("block"), F.col("seq").alias("seq"), F.size("parts").alias("n"), F.explode("parts").alias("p"))
            each = now.select("k", F.explode(F.sequence(F.lit(0), F.lit(r - 1))).alias("block"), "seq", F.lit(_NONE).alias("best"), "parts")
            hits = old.groupBy("k", "block").cogroup(each.groupBy("k", "block")).applyInArrow(_oldest_match, "seq bigint, best bigint")
            hits = materialise(hits.groupBy("seq").agg(F.min("best").alias("best")), "round")
            now = now.join(hits.select("seq"), "seq", "left_anti")
            done = done.unionByName(hits)
        settled = materialise(now.groupBy("own", "g").applyInArrow(_settle, "seq bigint, best bigint"), "settled")
        done = settled if done is None else done.unionByName(settled)
    return done


def check_batch(index: AcceptedIndex, batch: DataFrame, block_rows: int = BLOCK_ROWS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Holds ``batch`` (records with ``record_seq``) against the index and against itself, in order of record_seq;
    appends what is accepted to the index. Gives one row for each rejected message: ``accepted_seq``, the least of the
    accepted messages that it repeats, and ``new_seq``.

    Defined cases: messages of different keys never meet, null ids being an id like any other; null data is a text
    without words, and texts without words are copies of each other; rows without record_seq are left out; of a
    message that is in the batch several times all but the first are repeats; an empty batch or history gives no
    matches; extra columns are not read.
    """
    rows = materialise(contents(batch), "batch")
    classes = materialise(rows.groupBy("h", "k", "parts").agg(F.min("seq").alias("seq")), "classes")
    matched = _against_history(index, classes)
    fresh = materialise(classes.join(matched, "seq", "left_anti").select("k", "seq", "h", "parts"), "fresh")
    settled = _within_batch(fresh, block_rows, bucket_rows)
    accepted = materialise(fresh.join(settled.where("best IS NULL").select("seq"), "seq", "left_semi"), "accepted")
    best = matched.unionByName(settled.where("best IS NOT NULL"))

    # what repeats the history may repeat an accepted message of this batch that has a smaller number still
    least = accepted.agg(F.min("seq")).first()[0]
    open_ = classes.join(matched.where(F.col("best") > F.lit(least)), "seq") if least is not None else matched.limit(0)
    if not open_.isEmpty():
        layout = Layout.plan(materialise(accepted.groupBy("k").agg(F.sum(_weight()).alias("n")), "sizes"), block_rows, bucket_rows)
        old = layout.placed(accepted).select("bucket", "seq", F.size("parts").alias("n"), F.explode("parts").alias("p"))
        new = layout.asked(open_.withColumn("best", F.least("best", "seq")))
        older = old.groupBy("bucket").cogroup(new.groupBy("bucket")).applyInArrow(_oldest_match, "seq bigint, best bigint")
        best = materialise(best.unionByName(older), "best")

    best = best.groupBy("seq").agg(F.min("best").alias("best")).withColumnRenamed("seq", "first_seq")
    index.append(accepted)

    # every row of the batch: the first of its class by what the class repeats, the others at least by the first
    firsts = classes.select("h", F.col("seq").alias("first_seq"))
    members = rows.select("h", "seq").join(firsts, "h").select("seq", "first_seq").join(best, "first_seq", "left")
    out = members.withColumn("accepted_seq", F.coalesce("best", F.when(F.col("seq") != F.col("first_seq"), F.col("first_seq"))))
    return out.where("accepted_seq IS NOT NULL").select("accepted_seq", F.col("seq").alias("new_seq"))
