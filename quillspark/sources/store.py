"""A store of records in versions: every commit names the files of one version, and one of two that want the same place fails.

Records live in buckets. A record's address is a hash of its source (32 bits) followed by a hash of its key (32 bits); a bucket is the records whose address ends
in given bits, as many bits as keep it below a bound of rows. A bucket that has grown beyond the bound is split by further bits
when it is next written, so buckets follow the store's size without ever being dealt anew, and one source of very many records
is split by its keys. A writer reads and writes only the buckets that its sources are in.

A commit is one small file, `_commits/<version>`, put in place by an operation that fails if it is there already. A writer that finds its version taken looks at
what has been committed since its own base: if that touched none of its buckets it takes the next version, else it raises Conflict and has to begin again from
the newest version (`retried` does). Files that lost are deleted; files of old versions stay until `vacuum`.

A commit's file has a line for each bucket, so it grows with the store by one line for each bucket of up to BUCKET_ROWS records.
"""

from __future__ import annotations

import json
import os
import uuid
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKET_ROWS = 262_144
FILE_ROWS = 32_768  # of a bucket's file, so that a writing task sorts no more
SOURCE_BITS = 32
MOST_BITS = 60
SOURCE = ("project_id", "source_path")


class Conflict(RuntimeError):
    """Another writer has committed a bucket that this one has read."""


def _fs(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def put_new(spark: SparkSession, path: str, content: str) -> bool:
    """Write a file whole; False, and nothing written, if it is there."""
    files, target = _fs(spark, path)
    jvm = spark.sparkContext._jvm
    draft = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.draft")
    files.mkdirs(target.getParent())
    out = files.create(draft, False)
    out.write(bytearray(content.encode()))
    out.close()
    try:
        if files.getScheme() == "file":  # a local rename would replace the target, a link does not
            os.link(urlparse(draft.toUri().toString()).path, urlparse(target.toUri().toString()).path)
        else:
            options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
            options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(draft, target, options)
        return True
    except FileExistsError:
        return False
    except Exception:
        if files.exists(target):
            return False
        raise
    finally:
        files.delete(draft, False)


def text_of(spark: SparkSession, path: str) -> str:
    files, target = _fs(spark, path)
    stream = files.open(target)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def versions(spark: SparkSession, folder: str) -> list[int]:
    files, path = _fs(spark, f"{folder}/_commits")
    return sorted(int(f.getPath().getName()) for f in files.listStatus(path) if f.getPath().getName().isdigit()) if files.exists(path) else []


class Version:
    """buckets: (bits, value) to the folders of its files; touched: those that the commit replaced; notes: what writers leave, carried on."""

    def __init__(self, number: int = 0, buckets=None, touched=(), notes=None, schema: str | None = None) -> None:
        self.number, self.buckets, self.touched, self.notes, self.schema = number, buckets or {(0, 0): []}, list(touched), notes or {}, schema

    def dumped(self) -> str:
        return json.dumps({"buckets": [[*k, v] for k, v in sorted(self.buckets.items())], "touched": self.touched, "notes": self.notes, "schema": self.schema})


def load(spark: SparkSession, folder: str, number: int | None = None) -> Version:
    """A version, the newest if no number is given; version 0 is the empty store."""
    number = number if number is not None else max(versions(spark, folder), default=0)
    if not number:
        return Version()
    found = json.loads(text_of(spark, f"{folder}/_commits/{number}"))
    return Version(number, {(b, v): paths for b, v, paths in found["buckets"]}, [tuple(t) for t in found["touched"]], found["notes"], found["schema"])


def source_hash(columns=SOURCE) -> Column:
    return F.xxhash64(*columns).bitwiseAND(F.lit((1 << SOURCE_BITS) - 1))


def address(key: list[str], columns=SOURCE) -> Column:
    return source_hash(columns).bitwiseOR(_shifted(F.xxhash64(*key).bitwiseAND(F.lit((1 << MOST_BITS - SOURCE_BITS) - 1)), F.lit(SOURCE_BITS)))


def _shifted(number: Column, bits: Column) -> Column:
    return F.call_function("shiftleft", number, bits.cast("int"))


def _mask(bits: Column) -> Column:
    return _shifted(F.lit(1).cast("long"), bits) - 1


def _frame(spark: SparkSession, buckets) -> DataFrame:
    return spark.createDataFrame([(b, v) for b, v in sorted(buckets)], "part_bits int, part_value long")


def buckets_of(version: Version, sources: DataFrame, columns=SOURCE) -> list[tuple[int, int]]:
    """The buckets that records of these sources are in or belong in."""
    held = _frame(sources.sparkSession, version.buckets).withColumn("low", F.least("part_bits", F.lit(SOURCE_BITS)))
    held = held.withColumn("ends", F.col("part_value").bitwiseAND(_mask(F.col("low"))))
    held = F.broadcast(held)
    asked = sources.select(*columns).distinct().select(source_hash(columns).alias("_hash"), F.explode(F.array(*(F.lit(x) for x in sorted({min(b, SOURCE_BITS) for b, _ in version.buckets})))).alias("low"))
    found = asked.withColumn("ends", F.col("_hash").bitwiseAND(_mask(F.col("low")))).join(held, ["low", "ends"])
    return [(r.part_bits, r.part_value) for r in found.select("part_bits", "part_value").distinct().collect()]  # at most the buckets of the commit's file


def read(spark: SparkSession, folder: str, version: Version | None = None, buckets=None) -> DataFrame | None:
    """The records of a version (the newest), or of some of its buckets; None if nothing has ever been stored."""
    version = version or load(spark, folder)
    if version.schema is None:
        return None
    schema = spark.createDataFrame([], version.schema).schema
    paths = [f"{folder}/{p}" for b in (version.buckets if buckets is None else buckets) for p in version.buckets[b]]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _placed(rows: DataFrame, key: list[str], buckets, columns=SOURCE) -> DataFrame:
    """rows with part_bits and part_value of the bucket, of these, that each is in."""
    lengths = F.array(*(F.lit(x) for x in sorted({b for b, _ in buckets})))
    named = rows.withColumn("_address", address(key, columns)).withColumn("part_bits", F.explode(lengths))
    named = named.withColumn("part_value", F.col("_address").bitwiseAND(_mask(F.col("part_bits"))))
    return named.join(F.broadcast(_frame(rows.sparkSession, buckets)), ["part_bits", "part_value"]).drop("_address")


def commit(
    spark: SparkSession, folder: str, base: Version, touched: list[tuple[int, int]], rows: DataFrame, key: list[str], notes: dict | None = None, columns=SOURCE, bucket_rows: int = BUCKET_ROWS,
    append: bool = False, keys: DataFrame | None = None, settle=None,
) -> Version:
    """Put rows in place of all records of the touched buckets of base, as a new version.

    Rows must belong in these buckets. Buckets that would hold over bucket_rows are split before they are written; that count needs the keys
    only, so what makes the rows' other columns runs once. With append the buckets keep what they have and get rows as further files, without being split.

    settle, if given, makes records of rows once all rows of a key are in one task, which they go to once; it gets rows and the columns by which they are dealt, which it must keep.
    keys are then the sources and keys of the records that it makes.
    """
    counted = (rows if keys is None else keys).select(*dict.fromkeys([*columns, *key]))
    counts = _placed(counted, key, touched, columns).groupBy("part_bits", "part_value").agg(F.count("*").alias("n")).collect()
    split = {(r.part_bits, r.part_value): r.n for r in counts}
    fresh: list[tuple[int, int]] = []
    for bits, value in touched:
        more = 0 if append else min(MOST_BITS - bits, max(0, -(-split.get((bits, value), 0) // bucket_rows) - 1).bit_length())
        fresh += [(bits + more, value | i << bits) for i in range(1 << more)]
    data = f"data/{uuid.uuid4().hex}"
    # a bucket of many rows, as one that further bits didn't part since its source is hot, is written by several tasks
    several, most = [], min(FILE_ROWS, bucket_rows)
    if any(n > most for n in split.values()):
        left = _placed(counted, key, fresh, columns).groupBy("part_bits", "part_value").agg(F.count("*").alias("n")).where(F.col("n") > min(FILE_ROWS, 2 * bucket_rows)).collect()
        several = [(r.part_bits, r.part_value, -(-r.n // most)) for r in left]
    dealt = ["part_bits", "part_value", "_file"]
    files_of = F.broadcast(spark.createDataFrame(several, "part_bits int, part_value long, _files int"))
    placed = _placed(rows, key, fresh, columns).join(files_of, dealt[:2], "left").withColumn("_file", F.pmod(F.xxhash64(*key, F.lit(1)), F.coalesce("_files", F.lit(1)))).drop("_files").repartition(*dealt)
    placed = settle(placed, dealt) if settle else placed
    fields = [f for f in placed.schema if f.name not in dealt]
    placed.drop("_file").write.partitionBy("part_bits", "part_value").option("compression", "zstd").parquet(f"{folder}/{data}")
    files, path = _fs(spark, f"{folder}/{data}")
    lengths = [d.getPath() for d in files.listStatus(path) if d.isDirectory()]
    there = {f"{data}/{d.getName()}/{v.getPath().getName()}" for d in lengths for v in files.listStatus(d)}
    new = {(b, v): [*(base.buckets[b, v] if append else []), p] if (p := f"{data}/part_bits={b}/part_value={v}") in there else base.buckets[b, v] if append else [] for b, v in fresh}
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    newest = base
    while True:
        kept = {b: paths for b, paths in newest.buckets.items() if b not in set(touched)}
        after = Version(newest.number + 1, {**kept, **new}, touched, {**newest.notes, **(notes or {})}, schema)
        if put_new(spark, f"{folder}/_commits/{after.number}", after.dumped()):
            return after
        newest = load(spark, folder)
        taken = {t for n in range(base.number + 1, newest.number + 1) for t in load(spark, folder, n).touched}
        if taken & set(touched) or newest.schema not in (None, schema):
            files.delete(_fs(spark, f"{folder}/{data}")[1], True)
            raise Conflict(f"version {newest.number} of {folder} has changed what version {base.number} was read for")


def retried(work, tries: int = 5):
    """work(), again from the start for each Conflict; the last one is raised."""
    for left in range(tries - 1, -1, -1):
        try:
            return work()
        except Conflict:
            if not left:
                raise


def vacuum(spark: SparkSession, folder: str, keep: int = 2) -> int:
    """Delete the files that only versions before the last `keep` name, and those versions; the number of deleted folders.

    Files that no version names yet may be a writer's that is about to commit; they stay.
    """
    numbers = versions(spark, folder)
    old, new = [load(spark, folder, n) for n in numbers[:-keep]], [load(spark, folder, n) for n in numbers[-keep:]]
    held = {p for v in new for paths in v.buckets.values() for p in paths}
    gone = {p for v in old for paths in v.buckets.values() for p in paths} - held
    files, _ = _fs(spark, folder)
    for path in [*gone, *(f"_commits/{v.number}" for v in old)]:
        files.delete(_fs(spark, f"{folder}/{path}")[1], True)
    return len(gone)
