import pytest
from pyspark.sql import functions as F

from spoolwright import arrays


def collected(spark, n):
    df = spark.range(n).select(F.lit(7).alias("key"), "id", (F.col("id") * 3).alias("v")).union(spark.sql("SELECT 8, 0L, 5L"))
    return arrays.collected(df.repartition(3), "key", "id", "v", arrays.encoding_of_long(F.col("v")))


def test_full_array(spark):
    rows = {r.key: r for r in collected(spark, arrays.MAX_SIZE).collect()}
    assert rows[7]["values"] == [3 * k for k in range(arrays.MAX_SIZE)] and rows[7].size == arrays.MAX_SIZE
    assert rows[8]["values"] == [5] and rows[7].encoding == "INT_LONG"


@pytest.mark.parametrize("read", [["key", "values"], ["encoding"], ["key"]])
def test_nothing_is_dropped_past_a_full_array(spark, read):
    with pytest.raises(Exception, match="more than 1024 values: key 7"):
        collected(spark, arrays.MAX_SIZE + 1).select(*read).collect()
