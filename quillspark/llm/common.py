"""What the operators of this subpackage share."""

from __future__ import annotations

import sys
import types

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shared import FEW, PARTS, cut, discard, mark, new_folder, ranked, running, session_dir, spread_join  # noqa: F401

FILE_EDGES = 65_536
TOKENIZER_DIR = None  # None: the installed public_tokenizers package


def tokenizer_file(name: str, folder: str | None = TOKENIZER_DIR) -> str:
    """Path of a vocabulary file, in folder or in the installed package."""
    if folder:
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def per_worker(name: str, make):
    """A value kept for the life of a Python worker.

    Functions reach workers by value, so a module global would last for one task only.
    """
    store = sys.modules.setdefault("quillspark_worker_state", types.ModuleType("quillspark_worker_state"))
    if not hasattr(store, name):
        setattr(store, name, make())
    return getattr(store, name)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def parts(batches, rows: int = 500):
    """Record batches cut to few rows, so that little of one is held as Python values at a time."""
    for batch in batches:
        for begin in range(0, batch.num_rows, rows):
            yield batch.slice(begin, rows)


def byte_texts(column) -> list[bytes]:
    """An Arrow string column as UTF-8 bytes, null as empty."""
    import pyarrow as pa

    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def texts(column) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def nearest(groups: DataFrame) -> DataFrame:
    """groups (u, v) with m, the least of u and its v's. The v's of one u are read by one task only up to a bound; those of hubs, at most PARTS nodes, join their least salted."""
    total, least = groups.count(), F.least(F.min("v"), F.col("u"))
    limit = max(total / PARTS, FEW)
    hubs = groups.groupBy("u").agg(least.alias("m"), F.count("*").alias("n")).where(F.col("n") > limit).collect() if total > FEW else []
    is_hub = F.col("u").isin([r.u for r in hubs]) if hubs else F.lit(False)
    plain = groups.where(~is_hub).withColumn("m", F.least(F.min("v").over(Window.partitionBy("u")), F.col("u")))
    if not hubs:
        return plain
    found = F.create_map(*(x for r in hubs for x in (F.lit(r.u), F.lit(r.m))))
    return plain.unionByName(groups.where(is_hub).withColumn("m", F.element_at(found, F.col("u"))))


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """Connected components of an edge list: (node, component), component the smallest node reachable.

    Alternating large-star and small-star rounds. A round deals each edge out once for either star; a hub's edges stay where they are
    and meet its one minimum as a literal, so no node is gathered in one task, however many edges it has. Edges never grow in number, so few of them are written as
    few files, of at most FILE_EDGES each; a round's tables go when the next one's are there. Nodes without an edge are not returned. An empty edge list gives an empty result.
    """
    first = mark()
    pairs, seen = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct()), None
    files = max(1, -(-pairs.count() // FILE_EDGES))
    for _ in range(most_rounds):
        both = pairs.select("u", "v").unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = cut(nearest(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct().coalesce(files))
        small = nearest(large)
        pairs = cut(small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionByName(small.select("u", F.col("m").alias("v"))).distinct().coalesce(files))
        discard(pairs.sparkSession, first, but=1)
        state = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components not found after {most_rounds} rounds")
    roots = pairs.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
