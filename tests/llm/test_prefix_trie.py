"""The prefix trie against a trie of Python tuples."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from quillspark import llm
from quillspark.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, node string, length int"


def brute(rows):
    own = {}
    key = lambda r: hashlib.sha256(f"{len(r[0].encode())}:{r[0]}{r[1]}".encode()).hexdigest()
    for conv_id, turn, role, text, *_ in rows:
        if conv_id is not None:
            own.setdefault(conv_id, []).append(((turn is not None, turn or 0), (role or "", text or "")))
    own = {c: [x for _, x in sorted(v, key=lambda x: (x[0], key(x[1])))] for c, v in own.items()}
    whole = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = tuple(own.get(int(c / 5) * 5, [])[:h] + mine[h:])
    members = {}
    for c, seq in whole.items():
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
    leaves, saved, children = dict.fromkeys(members, 0), dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for seq in members:
        if seq:
            children[seq[:-1]] += 1
    for seq, of in members.items():
        for d in range(len(seq) + 1):
            leaves[seq[:d]] += children[seq] == 0
            saved[seq[:d]] += (len(of) - 1) * len(seq[-1][1].encode()) if seq else 0
    out = []
    for seq, of in members.items():
        ends = ",".join(map(str, sorted(c for c in of if whole[c] == seq)))
        out.append((min(of), len(seq), min(members[seq[:-1]]) if seq else None, len(of), children[seq], leaves[seq], saved[seq], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def plain(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    found = llm.QUERIES["op12_prefix_trie"](spark, folder)
    assert {t for _, t in found.dtypes} == {"bigint", "string"}
    assert plain(found) == brute(rows)


@pytest.fixture(scope="module")
def odd_rows():
    some, rows = random.Random(5), []
    for c in [*range(60), -7, -5, 1000]:
        for turn in range(some.choice([1, 2, 3, 9, 12])):
            rows.append((c, turn if some.random() < 0.9 else None, some.choice(["user", None, "a"]), some.choice(["x", "", None, "ü", "long " * 200]), "n", 1))
    rows += rows[:20]  # repeated rows
    rows += [(None, 0, "user", "nobody's", "n", 1)]
    rows += [(2000, t, "user", "same", "n", 1) for t in range(70)] + [(2001, t, "user", "same", "n", 1) for t in range(75)]
    return rows


def test_odd_rows(spark, odd_rows):
    table = spark.createDataFrame(odd_rows, SCHEMA)
    assert plain(prefix_trie.trie(table)) == brute(odd_rows)


def test_pieces_of_hot_ends(spark):
    rows = [(c, 0, "user", "hello", "n", 1) for c in range(0, 3000, 5)] + [(c, t, "user", f"{c} {t}", "n", 1) for c in range(3000, 3020) for t in range(12)]
    table = spark.createDataFrame(rows, SCHEMA)
    assert plain(prefix_trie.trie(table, piece=64)) == brute(rows)


def test_empty(spark):
    assert prefix_trie.trie(spark.createDataFrame([], SCHEMA)).isEmpty()


def test_rounds_are_logarithmic_and_sums_right(spark, monkeypatch):
    """A path of 200 nodes with a fan of 300 below its middle."""
    tree = spark.range(501).select(F.col("id").cast("string").cast("binary").alias("node"), F.when(F.col("id").between(1, 200), F.col("id") - 1).when(F.col("id") > 200, 100).cast("string").cast("binary").alias("parent"),
                                   F.when(F.col("id") <= 200, F.col("id")).otherwise(101).alias("depth"), F.lit(1).cast("long").alias("x"))
    written = []
    monkeypatch.setattr(prefix_trie, "cut", lambda df, f=prefix_trie.cut: written.append(1) or f(df))
    found = {int(bytes(r.node)): r.x for r in prefix_trie.rollup(tree, ["x"]).collect()}
    assert len(written) <= 1 + 3 * 8
    assert found == {i: 1 if i > 200 else 201 - i + 300 * (i <= 100) for i in range(501)}
