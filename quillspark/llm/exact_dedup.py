"""Exact deduplication by Grace hashing.

Rows are normalised and hashed where they lie. Each input partition first folds its own
copies, so a text copied into a third of all rows leaves a partition once; the folded
texts are then partitioned by hash over the cluster. In either place a bucket that does not
fit the memory limit is partitioned again, to spill files, by further bits of the hash until it
fits an open-addressing table, which compares complete contents.

Defined results. Null text is the empty text. Only A-Z are lower-cased. A null id is smaller than
any other. Rows that repeat an id and text are the same row: all or none of them stay.
An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import os
import struct
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_texts, cut, parts, read, spread_join

MEMORY = 64 << 20  # bytes of distinct content that a table may hold
FANOUT_BITS = 4
NO_ID = -(1 << 63)
HEADER = "<32sqqI"


class ContentTable:
    """Open addressing with linear probing; equality is equality of the whole content."""

    def __init__(self) -> None:
        self.slots: list = [None] * 1024
        self.used = self.bytes = 0

    def add(self, digest: bytes, content: bytes, top: int, n: int) -> None:
        slots, mask = self.slots, len(self.slots) - 1
        i = int.from_bytes(digest[:8], "little") & mask
        while (entry := slots[i]) is not None:
            if entry[0] == digest:
                if entry[1] != content:
                    raise ValueError("two texts with one SHA-256 digest")
                entry[2] = max(entry[2], top)
                entry[3] += n
                return
            i = (i + 1) & mask
        slots[i] = [digest, content, top, n]
        self.used += 1
        self.bytes += len(content) + 200
        if self.used * 2 > len(slots):
            self.grow()

    def grow(self) -> None:
        old, self.slots = self.slots, [None] * (2 * len(self.slots))
        mask = len(self.slots) - 1
        for entry in old:
            if entry is not None:
                i = int.from_bytes(entry[0][:8], "little") & mask
                while self.slots[i] is not None:
                    i = (i + 1) & mask
                self.slots[i] = entry

    def entries(self):
        return (x for x in self.slots if x is not None)


def grace(records, memory: int = MEMORY, level: int = 0):
    """Fold (digest, content, largest id, count) records: one entry per distinct content."""
    table = ContentTable()
    records = iter(records)
    for record in records:
        table.add(*record)
        if table.bytes > memory and level < 12:
            break
    else:
        yield from table.entries()
        return
    with tempfile.TemporaryDirectory(prefix="grace-") as folder:
        paths = [os.path.join(folder, str(i)) for i in range(1 << FANOUT_BITS)]
        files = [open(p, "wb") for p in paths]  # noqa: SIM115
        try:
            for source in (table.entries(), records):
                for digest, content, top, n in source:
                    bucket = int.from_bytes(digest[8:16], "little") >> (FANOUT_BITS * level) & ((1 << FANOUT_BITS) - 1)
                    files[bucket].write(struct.pack(HEADER, digest, top, n, len(content)) + content)
                table = None
        finally:
            for f in files:
                f.close()
        for path in paths:
            yield from grace(spilled(path), memory, level + 1)
            os.remove(path)


def spilled(path: str):
    with open(path, "rb", buffering=1 << 20) as f:
        while head := f.read(struct.calcsize(HEADER)):
            digest, top, n, length = struct.unpack(HEADER, head)
            yield digest, f.read(length), top, n


def normalise(text: bytes) -> bytes:
    return text.lower()  # bytes.lower() changes A-Z only


def members(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, digest) of every row."""

    def run(batches):
        import pyarrow as pa

        for batch in parts(batches):
            found = [hashlib.sha256(normalise(t)).digest() for t in byte_texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["doc_id", "digest"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, digest binary")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", memory: int = MEMORY) -> DataFrame:
    """One row per distinct text: digest, keep_id (largest id), group_size."""

    def batched(entries, with_content: bool):
        import pyarrow as pa

        rows, size = [], 0

        def batch():
            cols = list(zip(*rows))
            arrays = [pa.array(cols[0], pa.binary())] + ([pa.array(cols[1], pa.binary())] if with_content else [])
            names = ["digest", *["content"] * with_content, "top", "n"]
            return pa.RecordBatch.from_arrays([*arrays, pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())], names)

        for entry in entries:
            rows.append(entry)
            size += len(entry[1]) if with_content else 100
            if size > 8 << 20:
                yield batch()
                rows, size = [], 0
        if rows:
            yield batch()

    def fold_local(batches):
        def records():
            for batch in parts(batches):
                for i, t in zip(batch.column(0).to_pylist(), byte_texts(batch.column(1))):
                    t = normalise(t)
                    yield hashlib.sha256(t).digest(), t, NO_ID if i is None else i, 1

        yield from batched(grace(records(), memory), True)

    def fold_all(batches):
        records = (r for batch in parts(batches) for r in zip(*(batch.column(i).to_pylist() for i in range(4))))
        yield from batched(grace(records, memory), False)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    local = rows.mapInArrow(fold_local, "digest binary, content binary, top long, n long")
    whole = local.repartition("digest").mapInArrow(fold_all, "digest binary, top long, n long")
    return whole.select("digest", F.when(F.col("top") != NO_ID, F.col("top")).alias("keep_id"), F.col("n").alias("group_size"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", memory: int = MEMORY) -> DataFrame:
    """Every row's id, the id that stays, the group's size, whether the row stays, and the text's digest."""
    found = cut(classes(docs, id_col, text_col, memory))
    total = found.agg(F.coalesce(F.sum("group_size"), F.lit(0))).first()[0]
    joined = spread_join(members(docs, id_col, text_col), found, "digest", found.select("digest", F.col("group_size").alias("n")), total, "left")
    return joined.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", memory: int = MEMORY) -> DataFrame:
    """The rows of docs that stay, with all their columns: those with the id and the text of a kept row.

    An id that only one row has says which text it is; only rows of other ids are held against the digest.
    """
    keep = cut(classes(docs, id_col, text_col, memory).select(F.col("keep_id").alias("_keep_id"), F.col("digest").alias("_keep_digest"))).hint("merge")  # it grows with the texts, so it is never broadcast
    many = cut(docs.groupBy(F.col(id_col).cast("long").alias("_many_id")).agg(F.count("*").alias("_n")).where("_n > 1").select("_many_id"))
    same_id, repeated = docs[id_col].cast("long").eqNullSafe(keep["_keep_id"]), docs[id_col].cast("long").eqNullSafe(many["_many_id"])
    if many.isEmpty():
        return docs.join(keep, same_id, "left_semi")
    lowered = F.translate(F.coalesce(docs[text_col].cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    same_text = F.unhex(F.sha2(lowered, 256)) == keep["_keep_digest"]
    single = docs.join(many, repeated, "left_anti").join(keep, same_id, "left_semi")
    return single.union(docs.join(many, repeated, "left_semi").join(keep, same_id & same_text, "left_semi"))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(read(spark, sf_dir, "documents"))


QUERIES = {"op1_exact_dedup": op1_exact_dedup}

SQL = {
    "op1_exact_dedup": """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""
}
