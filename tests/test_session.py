from pyspark.sql import functions as F

from spoolwright import session as ss
from spoolwright.functions import dates, ints, strings
from spoolwright.functions.text import cp1251, digest, log_text


def test_shared_folder_is_the_session_s(spark):
    assert ss.shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    a, b = ss.fresh_path(spark, "x"), ss.fresh_path(spark, "x")
    assert a != b and a.startswith(ss.shared_folder(spark))
    df = ss.materialise(spark.range(5).withColumn("n", F.lit(None).cast("string")), "t")
    assert df.count() == 5 and df.schema["n"].dataType.simpleString() == "string"
    assert "FileScan" in df._jdf.queryExecution().executedPlan().toString() or "Scan parquet" in df._jdf.queryExecution().executedPlan().toString()


def test_broadcast_only_if_small(spark):
    df = spark.range(20)
    plan = lambda d: d._jdf.queryExecution().logical().toString()
    assert "broadcast" in plan(ss.broadcast_if_small(df, 20)).lower()
    assert "broadcast" not in plan(ss.broadcast_if_small(df, 19)).lower()


def test_conf_is_put_back(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        with ss.conf(spark, spark__sql__shuffle__partitions=3, spark__some__thing=True):
            assert spark.conf.get("spark.sql.shuffle.partitions") == "3" and spark.conf.get("spark.some.thing") == "true"
            raise KeyError
    except KeyError:
        pass
    assert spark.conf.get("spark.sql.shuffle.partitions") == old and spark.conf.get("spark.some.thing", None) is None


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def test_texts(spark):
    every = bytes(range(256))
    assert one(spark, cp1251(F.lit(every)))[0] == every.decode("cp1251", "replace")
    word = "тестовая СТРОКА"
    assert one(spark, log_text(F.lit(word.encode())), log_text(F.lit(word.encode("cp1251")))) == (word, word)
    odd = "a�".encode()
    assert one(spark, log_text(F.lit(odd)), log_text(F.lit(odd), True), log_text(F.lit(None).cast("binary"))) == ("a�", odd.decode("cp1251"), None)


def test_digests_tell_apart(spark):
    n = F.lit(None).cast("string")
    pairs = [(F.lit("a"), F.lit("bc")), (F.lit("ab"), F.lit("c")), (F.lit(""), F.lit("abc")), (n, F.lit("abc")), (F.lit("abc"), n), (F.lit("-:"), F.lit("")), (n, n)]
    got = [bytes(x) for x in one(spark, *[digest(a, b) for a, b in pairs])]
    assert len(set(got)) == len(pairs) and all(len(g) == 16 for g in got)


def test_ints(spark):
    assert one(spark, ints.fold_timestamp(F.lit(2**40 + 5)), ints.fold_timestamp(F.lit(-1)), ints.wrap32(F.lit(2**31))) == (5 ^ 2**8, 0, -(2**31))
    assert one(spark, ints.pack_key(F.lit(1), F.lit(-1979199101)), ints.pack_key(F.lit(2), F.lit(-1979199101)), ints.pack_key(F.lit(2), F.lit(869112044))) == (-1979199101, -1979199101, 9459046636)
    assert one(spark, ints.reverse_bits32(F.lit(1)), ints.reverse_bits32(F.lit(0)), ints.reverse_bits32(F.lit(-1))) == (-(2**31), 0, -1)


def test_strings_and_dates(spark):
    assert one(spark, strings.zero_pad(F.lit(7), 3), strings.zero_pad(F.lit(12345), 3)) == ("007", "12345")
    assert one(spark, strings.maybe_chop_ending(F.lit("a.gz"), ".gz"), strings.maybe_chop_ending(F.lit("a"), ".gz")) == ("a", None)
    assert one(spark, strings.split_before(F.lit("a\\Eb\\Ec"), "\\E"), strings.split_before(F.lit("x"), "--"))[0] == ["a", "\\Eb", "\\Ec"]
    assert one(spark, dates.msk_day(F.lit(-10800001)), dates.msk_day(F.lit(86400000)), dates.http_date(F.lit(0))) == (0, 1, "Thu, 01 Jan 1970 00:00:00 GMT")
