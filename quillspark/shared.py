"""The folder that all executors share, lineage cut there, joins that split hot keys, and ranks and running sums in two levels."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PARTS = 1024  # a key of over one in PARTS rows is split, so at most PARTS keys are
FEW = 256  # rows of a key that are never split
_made: list[str] = []  # folders that new_folder has named, in order


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset, a new local folder in local mode and an error on a cluster."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not found:
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='quillspark-')}")
        found = spark.sparkContext.getCheckpointDir()
    return found


def session_dir(spark: SparkSession) -> str:
    """The folder of what this application writes on the way; `discard` deletes it."""
    return f"{shared_dir(spark)}/quillspark-{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession, kind: str) -> str:
    _made.append(f"{session_dir(spark)}/{kind}-{uuid.uuid4().hex}")
    return _made[-1]


def mark() -> int:
    """A point in time for `discard`."""
    return len(_made)


def discard(spark: SparkSession, since: int = 0, but: int = 0) -> None:
    """Delete what has been written on the way since a mark, or ever, but for the last ones. Results that read it and have not been written elsewhere are lost with it."""
    until = len(_made) - but
    for folder in _made[since:until]:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    del _made[since:until]


def cut(df: DataFrame) -> DataFrame:
    """df, computed once, written as a table in the shared folder and read from there.

    A checkpoint would keep the size estimates of its plan, which joins multiply: after some rounds of an iteration
    they are numbers of millions of digits. A table's size is that of its files.
    """
    folder = new_folder(df.sparkSession, "table")
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def spread_join(rows: DataFrame, side: DataFrame, key: str, counts: DataFrame, total: int, how: str = "inner") -> DataFrame:
    """rows joined (inner or left) with side, which has one row a key, so that no task holds much more than one in PARTS rows.

    counts has key and n, the number of rows of that key; total is the number of all rows. The rows of a hot key are dealt
    by a hash of their columns over salts, and its one side row is repeated for each. Hot keys go through the driver: they are at
    most PARTS, whatever the data, and are literals of the plan. A null key matches nothing.
    """
    limit = max(total / PARTS, FEW)
    hot = counts.where(F.col("n") > limit).select(key, "n").collect() if total > FEW else []
    if not hot:
        return rows.join(side, key, how)
    salts = math.ceil(max(r.n for r in hot) / limit)
    is_hot = F.col(key).isin([r[key] for r in hot])
    dealt = rows.withColumn("_salt", F.when(is_hot, F.pmod(F.xxhash64(*rows.columns), F.lit(salts))).otherwise(0).cast("int"))
    wide = side.withColumn("_salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return dealt.join(wide, [key, "_salt"], how).drop("_salt")


def ranked(rows: DataFrame, keys: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """rows with the place, from 1, of each within its keys; ties in any order, null keys are a key.

    Ranges of (keys, order) are dealt out, so a key of many rows is sorted by many tasks, none of which holds more than its range;
    a row's place is that within its range and the rows of its key in earlier ranges, of which there are at most two keys a range.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(parts, *keys, *order, "_row")
    dealt = cut(dealt.withColumn("_part", F.spark_partition_id()))
    spans = cut(dealt.groupBy("_part", *keys).agg(F.count("*").alias("_n")))
    several = spans.groupBy(*keys).agg(F.count("*").alias("_spans")).where("_spans > 1")
    spans = spans.join(several, _same(spans, several, keys), "left_semi")
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("_before", before).where("_before > 0").select(F.col("_part").alias("_of"), *keys, "_before")
    here = dealt.withColumn("_at", F.row_number().over(Window.partitionBy("_part", *keys).orderBy(*order, "_row")))
    joined = here.join(spans, (here["_part"] == spans["_of"]) & _same(here, spans, keys), "left")
    return joined.select(*(here[c] for c in rows.columns), (F.col("_at") + F.coalesce("_before", F.lit(0))).alias(name))


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    found = F.lit(True)
    for key in keys:
        found = found & left[key].eqNullSafe(right[key])
    return found


def running(rows: DataFrame, keys: list[str], at: str, sums: dict[str, str], width: int = 1024) -> DataFrame:
    """rows with the running sums of columns (sums: column to name) within their keys in the order of at, a place from 1.

    Blocks of width places are summed alone and each adds the sums of the blocks before it, so a task holds a block, or
    one row for each block of a key. Null keys are a key.
    """
    blocked = rows.withColumn("_block", F.floor((F.col(at) - 1) / F.lit(width)))
    totals = blocked.groupBy(*keys, "_block").agg(*(F.sum(c).alias(f"_{c}") for c in sums))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, F.col("_block").alias("_of"), *(F.sum(f"_{c}").over(earlier).alias(f"_{c}") for c in sums)).where("_of > 0")
    inner = Window.partitionBy(*keys, "_block").orderBy(at)
    here = blocked.select("*", *(F.sum(c).over(inner).alias(f"_own_{c}") for c in sums))
    joined = here.join(totals, (here["_block"] == totals["_of"]) & _same(here, totals, keys), "left")
    return joined.select(*(here[c] for c in rows.columns), *((F.col(f"_own_{c}") + F.coalesce(f"_{c}", F.lit(0))).alias(name) for c, name in sums.items()))
