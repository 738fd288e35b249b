"""Ranks and running sums in two levels, against windows over whole keys."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspark import shared


def table(spark, n=3000):
    """A hot key, small keys, a null key, ties and repeated rows."""
    key = F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 50 == 1, F.lit(None)).otherwise(F.col("id") % 40)
    return spark.range(n).select(key.cast("long").alias("k"), (F.col("id") * 7919 % 101).alias("v"), F.when(F.col("id") % 11 > 0, F.col("id") * 31 % 17).alias("o"))


def test_ranks_of_a_hot_key_are_those_of_one_window(spark):
    rows = table(spark).withColumn("_extra", F.lit("x"))
    found = shared.ranked(rows, ["k"], [F.col("o").asc_nulls_first(), F.col("v")])
    expected = rows.withColumn("rank", F.row_number().over(Window.partitionBy("k").orderBy(F.col("o").asc_nulls_first(), "v")))
    assert found.columns == expected.columns
    assert sorted(map(str, found.collect())) == sorted(map(str, expected.collect()))


def test_a_hot_key_is_sorted_by_many_tasks(spark):
    found = shared.ranked(spark.range(4000).select(F.lit(1).alias("k"), F.col("id").alias("o")), ["k"], [F.col("o").desc()])
    assert found.where("rank != 4000 - o").isEmpty()
    tasks = found.groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in tasks) < 4000


def test_ranks_of_repeated_rows_are_all_different(spark):
    found = shared.ranked(spark.range(500).select(F.lit(1).alias("k"), F.lit(2).alias("o")), ["k"], [F.col("o")])
    assert sorted(r.rank for r in found.collect()) == list(range(1, 501))


def test_running_sums_by_blocks(spark):
    rows = table(spark, 700)
    rows = rows.withColumn("at", F.row_number().over(Window.partitionBy("k").orderBy("o", "v")))
    found = shared.running(rows, ["k"], "at", {"v": "total"}, width=7)
    expected = rows.withColumn("total", F.sum("v").over(Window.partitionBy("k").orderBy("at")))
    assert sorted(map(str, found.collect())) == sorted(map(str, expected.collect()))


def test_empty(spark):
    rows = table(spark, 10).where("false")
    assert shared.ranked(rows, ["k"], [F.col("o")]).isEmpty()
    assert shared.running(rows.withColumn("at", F.lit(1)), ["k"], "at", {"v": "total"}).isEmpty()
