"""SimHash near-deduplication with BK-trees.

A document's fingerprint is the bitwise majority of its shingles' XXH64. Distinct fingerprints are
dealt to shards by pairs of the four 16-bit blocks: fingerprints that differ in at most two bits agree
in two blocks, so every link lies within a shard. A shard of over SHARD fingerprints is split again
by thirds of its free bits (two differing bits leave one third equal) until it fits; three splits
leave at most ten free bits, so a shard is bounded whatever the data. Each shard's task builds a BK-tree and
looks every fingerprint up in it, following only edges within the radius; a union-find keeps a
spanning forest, so a group of n sends n - 1 links on and never its pairs. Components then close
the groups over all shards.

Trees are not broadcast whole: all trees together grow with the data. Each goes to the one task that holds its shard's
queries.

Defined results. Null text is the empty text. A text without words has fingerprint zero and is linked like any
other. Equal fingerprints are one class. A null id is smaller than any other id only if it is the
sole one: component ids ignore nulls. Repeated rows give repeated results. An empty table gives an empty result. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_texts, components, cut, read, spread_join

WORDS = 3
RADIUS = 2  # the sharding is exact up to this
SHARD = 1024
SEED = 42


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: bytes, words: int = WORDS) -> int:
    import numpy as np
    import xxhash

    found = text.lower().split()  # bytes: A-Z and ASCII white space only
    n = len(found)
    if not n:
        return 0
    whole = b" ".join(found)
    if n <= words:
        return xxhash.xxh64_intdigest(whole, SEED)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, n) + 1)
    starts = np.concatenate(([0], ends[: n - words]))
    of = xxhash.xxh64_intdigest
    hashes = np.array([of(whole[a:b], SEED) for a, b in zip(starts.tolist(), (ends[words - 1 :] - 1).tolist())], "<u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 8192):
        ones += np.unpackbits(hashes[i : i + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) of every row."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for begin in range(0, batch.num_rows, 2000):
                part = batch.slice(begin, 2000)
                found = [signed(fingerprint(t, words)) for t in byte_texts(part.column(1))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.int64())], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


class BKTree:
    """Nodes in insertion order; a node's children are keyed by their Hamming distance to it."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        at, new = 0, len(self.values)
        self.values.append(value)
        self.children.append({})
        while new:
            d = (self.values[at] ^ value).bit_count()
            below = self.children[at].setdefault(d, new)
            if below == new:
                return
            at = below

    def within(self, value: int, radius: int):
        """Nodes at a distance of at most radius."""
        stack = [0] if self.values else []
        while stack:
            at = stack.pop()
            d = (self.values[at] ^ value).bit_count()
            if d <= radius:
                yield at
            for edge, child in self.children[at].items():
                if d - radius <= edge <= d + radius:
                    stack.append(child)


def forest(values: list[int], radius: int):
    """A spanning forest of the links among values, as pairs of values."""
    tree, parent = BKTree(), []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for i, value in enumerate(values):
        parent.append(i)
        for j in tree.within(value & 0xFFFFFFFFFFFFFFFF, radius):
            a, b = root(i), root(j)
            if a != b:
                parent[b] = a
                yield value, values[j]
        tree.add(value & 0xFFFFFFFFFFFFFFFF)


def split_masks(levels: int) -> tuple[list[int], list[dict[int, list[int]]]]:
    """The first masks and, level by level, the finer masks that replace one whose shard is too large."""
    blocks = [0xFFFF << 16 * i for i in range(4)]
    masks = [a | b for a, b in combinations(blocks, 2)]
    finer, now = [], masks
    for _ in range(levels):
        step = {}
        for mask in now:
            free = [i for i in range(64) if not mask >> i & 1]
            thirds = [free[i::3] for i in range(3)]
            step[mask] = [mask | sum(1 << b for b in part) for part in thirds]
        finer.append(step)
        now = [m for found in step.values() for m in found]
    return masks, finer


def links(distinct: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """Links (a, b) among the distinct fingerprints in column fp that span their components within each shard."""
    if radius > RADIUS:
        raise ValueError(f"the sharding is exact for a radius of at most {RADIUS}")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = [pair for values in batch.column(0).to_pylist() for pair in forest(values, radius)]
            a, b = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    masks, finer = split_masks(3)
    rows = distinct.select("fp", F.explode(F.array(*(F.lit(signed(m)) for m in masks))).alias("mask"))
    out = None
    for step in [*finer, None]:
        keyed = rows.withColumn("bits", F.col("fp").bitwiseAND(F.col("mask")))
        heavy = None
        if step is not None:
            heavy = cut(keyed.groupBy("mask", "bits").count().where(F.col("count") > shard).select("mask", "bits"))
            if heavy.isEmpty():
                heavy = None
        light = keyed if heavy is None else keyed.join(heavy, ["mask", "bits"], "left_anti")
        groups = light.groupBy("mask", "bits").agg(F.sort_array(F.collect_list("fp")).alias("fps")).where(F.size("fps") > 1)
        found = groups.select("fps").mapInArrow(run, "a long, b long")
        out = found if out is None else out.unionByName(found)
        if heavy is None:
            return out
        table = F.create_map(*(x for m, parts in step.items() for x in (F.lit(signed(m)), F.array(*(F.lit(signed(p)) for p in parts)))))
        rows = keyed.join(heavy, ["mask", "bits"], "left_semi").select("fp", F.explode(F.element_at(table, F.col("mask"))).alias("mask"))
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id that links reach) of every row."""
    rows = cut(fingerprints(docs, id_col, text_col, words))
    distinct = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    linked = components(links(distinct, radius, shard))
    named = cut(distinct.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp")))
    found, total = named.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    least = named.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    classes = spread_join(named.select("fp", "component"), least.select("component", "component_id"), "component", least.select("component", "n"), found)
    return spread_join(rows, classes.select("fp", "component_id"), "fp", named.select("fp", "n"), total, "left").select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """The rows of docs whose id is the smallest of their component, with all their columns."""
    found = near_duplicates(docs, id_col, text_col, words, radius, shard)
    stays = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_stays")).distinct()
    return docs.join(stays, docs[id_col].cast("long").eqNullSafe(stays["_stays"]), "left_semi")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op3_simhash": op3_simhash}
SQL: dict[str, str] = {}
