"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard has VNODES points on a ring of 64-bit hashes; a row belongs to the first point at or after
its id's hash. Loads are bounded: a shard takes rows of its own arcs up to its capacity; the rest of
an arc continues clockwise to the next points whose shards have room. With slack 0 the capacities
add up to the number of rows, so counts are at most one apart; with slack e they are at most
ceil((1 + e) * rows / shards) and fewer rows move when a shard joins.

Only counts of arcs' rows go to the driver: at most shards * VNODES numbers, however large the table. They fix which ranks of an arc go
to which shard and slot. Rows are ranked by id, digest and size in ranges (`ranked`), so a hot arc, of one id that many rows repeat say, is no task's alone, and
where a row goes depends on the rows alone, not on how the table is stored.

Defined results. Null text has no bytes. A null id is hashed as the empty string. Rows that repeat an id sit at one
point of the ring and overflow clockwise like others. An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, ranked, read

SHARDS = 24
VNODES = 128
SEED = 42


def ring(shards: int, vnodes: int = VNODES) -> list[tuple[int, int]]:
    """(position, shard), clockwise. A further shard adds points and moves none."""
    import xxhash

    points = sorted((xxhash.xxh64_intdigest(f"shard {s} point {v}".encode(), SEED), s) for s in range(shards) for v in range(vnodes))
    return [(p - (1 << 64) if p >> 63 else p, s) for p, s in sorted((p ^ 1 << 63, s) for p, s in points) for p in [p ^ 1 << 63]]


def plan(points: list[tuple[int, int]], cells: dict[tuple[int, int], int], capacity: list[int]) -> list[tuple[int, int, int, int, int, int]]:
    """(arc, part, first rank, end rank, shard, slot of the first rank) for every run of rows that go to one shard; cells are counts by (arc, part of it)."""
    out, used = [], [0] * len(capacity)

    def put(arc, salt, first, n, shard):
        out.append((arc, salt, first, first + n, shard, used[shard]))
        used[shard] += n

    rest = []
    for arc, salt in sorted(cells):
        n, shard = cells[arc, salt], points[arc][1]
        own = min(n, capacity[shard] - used[shard])
        if own:
            put(arc, salt, 0, own, shard)
        if own < n:
            rest.append((arc, salt, own, n))
    for arc, salt, first, n in rest:
        at = arc
        while first < n:
            at = (at + 1) % len(points)
            shard = points[at][1]
            take = min(n - first, capacity[shard] - used[shard])
            if take:
                put(arc, salt, first, take, shard)
                first += take
    return out


def capacities(rows: int, shards: int, slack: float) -> list[int]:
    if slack:
        return [math.ceil((1 + slack) * rows / shards)] * shards
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def on_ring(rows: DataFrame, id_col: str, points: list[tuple[int, int]], name: str) -> DataFrame:
    """Adds the number of the row's arc (the point that it belongs to)."""
    positions = [p for p, _ in points]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        at = np.array(positions, np.int64)
        for batch in batches:
            arcs = np.searchsorted(at, batch.column(batch.num_columns - 1).to_numpy()) % len(at)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(arcs, pa.int32())], names)

    names = [*rows.columns, name]
    placed = rows.withColumn("_position", F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    schema = ", ".join([*(f"`{c}` {t}" for c, t in rows.dtypes), f"{name} int"])
    return placed.mapInArrow(run, schema)


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, vnodes: int = VNODES, slack: float = 0.0) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (gapless from 0 within the shard) of every row."""
    points = ring(shards, vnodes)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = on_ring(rows, "doc_id", points, "arc")
    placed = cut(ranked(rows, ["arc"], [F.col("doc_id"), F.col("text_crc32"), F.col("size")]))
    cells = {(r.arc, 0): r["count"] for r in placed.groupBy("arc").count().collect()}
    runs = plan(points, cells, capacities(sum(cells.values()), shards, slack))
    table = docs.sparkSession.createDataFrame([(arc, first, end, shard, slot) for arc, _, first, end, shard, slot in runs], "arc int, first_rank long, end_rank long, shard int, first_slot long")
    at = F.col("rank") - 1
    inside = (at >= F.col("first_rank")) & (at < F.col("end_rank"))
    # at most two runs for each arc and shard, whatever the table's size
    return placed.join(F.broadcast(table), "arc").where(inside).select("doc_id", "size", "text_crc32", "shard", (F.col("first_slot") + at - F.col("first_rank")).alias("slot"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = assign(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op6_sharding": op6_sharding}
SQL: dict[str, str] = {}
