"""A trie of conversation prefixes, rolled up by pointer jumping.

Each distinct sequence of first turns is a node. Its key is a digest of its depth and of two sums over its turns of 64 bits of SHA-256 of
(place, turn); sums add up in blocks, so the prefixes of one very long conversation are keyed by many tasks. A node's parent edge is
the key of the sequence without the last turn. In round k every node adds what the nodes whose pointer it is have gathered, and pointers
double their reach, from parents to ancestors of distance 2^k: after logarithmically many rounds, in the depth, each node has the leaves and the savings of its
whole subtree. Sums for a pointer are grouped with partial sums and hot pointers (a first turn that many conversations share) are salted.

Conversations that end at a node are hashed in ascending order. Ranges of (node, id) are joined to texts in parallel; only where a node's ids go on in another
range are pieces kept and put through one hash, as a stream, since SHA-256 can't be split.

Defined results. Rows without a conv_id belong to no conversation. Turns are ordered by turn, null first, then by a digest of role and text;
repeated rows are turns of their own. A null role or text is the empty one. conv_id % 5 takes the sign of conv_id. The root is there if there is
any conversation; an empty table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, ranked, read, running, spread_join

FAMILY = 5  # conversations c - c % FAMILY to c share first turns
HEADS = 9  # how many is crc32(c) % HEADS
PIECE = 1 << 20


def node_key(depth, a, b):
    return F.unhex(F.substring(F.sha2(F.concat_ws(",", depth.cast("string"), a.cast("string"), b.cast("string")), 256), 1, 32))


def halves(at, digest):
    """The two summands of a turn at a place."""
    mixed = F.sha2(F.concat_ws(",", at.cast("string"), digest), 256)
    return [F.conv(F.substring(mixed, start, 16), 16, 10).cast("decimal(28,0)") for start in (1, 17)]


def turns(table: DataFrame) -> DataFrame:
    """conv_id, rank, digest, size of every turn."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = table.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.octet_length(text).cast("long").alias("size"))
    return cut(ranked(rows, ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("digest")]).drop("turn"))


def rebuilt(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """at (the place), conv_id, digest, size of the rebuilt turns, and conv_id, length of the rebuilt conversations."""
    convs = cut(found.groupBy("conv_id").agg(F.count("*").alias("n")))
    total = convs.agg(F.sum("n")).first()[0] or 0
    heads = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(HEADS))
    plans = convs.select("conv_id", "n", heads.alias("h"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"))
    there = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("there"))
    plans = plans.join(there, "base", "left").withColumn("taken", F.least("h", F.coalesce("there", F.lit(0))))
    plans = cut(plans.withColumn("length", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))))
    first = found.where((F.col("rank") < HEADS) & (F.col("conv_id") % FAMILY == 0)).withColumnRenamed("conv_id", "base")
    first = plans.select("conv_id", "base", "taken", "length").join(first, "base").where("rank <= taken")
    own = spread_join(found, plans.select("conv_id", "h", "taken", "length"), "conv_id", convs, total).where("rank > h")
    columns = ["conv_id", "length", "digest", "size"]
    rows = first.select(*columns, F.col("rank").alias("at")).unionByName(own.select(*columns, (F.col("taken") + F.col("rank") - F.col("h")).alias("at")))
    return rows, plans.select("conv_id", "length")


def prefixes(rows: DataFrame) -> DataFrame:
    """conv_id, length, at, size, node, parent: every rebuilt conversation's first at turns."""
    a, b = halves(F.col("at"), F.col("digest"))
    summed = running(rows.withColumn("a", a).withColumn("b", b), ["conv_id"], "at", {"a": "sum_a", "b": "sum_b"})
    before = node_key(F.col("at") - 1, F.col("sum_a") - F.col("a"), F.col("sum_b") - F.col("b"))
    return summed.select("conv_id", "length", "at", "size", node_key(F.col("at"), F.col("sum_a"), F.col("sum_b")).alias("node"), before.alias("parent"))


def rollup(tree: DataFrame, sums: list[str]) -> DataFrame:
    """node and the sums over its subtree, itself included. tree: node, parent, depth (0: a root), and the columns sums."""
    have = cut(tree.select("node", F.col("parent").alias("pointer"), "depth", *sums))
    deepest, reach = have.agg(F.max("depth")).first()[0] or 0, 1
    while reach <= deepest:
        movers = have.where(F.col("depth") >= reach)
        sent = cut(movers.groupBy("pointer").agg(*(F.sum(c).alias(f"sent_{c}") for c in sums), F.count("*").alias("n")))
        got = have.join(sent.drop("n").withColumnRenamed("pointer", "node"), "node", "left")
        got = got.select("node", "pointer", "depth", *((F.col(c) + F.coalesce(f"sent_{c}", F.lit(0))).alias(c) for c in sums))
        if 2 * reach <= deepest:
            over = sent.join(movers.select(F.col("node").alias("pointer"), F.col("pointer").alias("next")), "pointer").select("pointer", "n", "next")
            over = cut(over)
            far = got.where(F.col("depth") >= 2 * reach)
            moved = spread_join(far, over.select("pointer", "next"), "pointer", over.select("pointer", "n"), over.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
            got = got.where(F.col("depth") < 2 * reach).unionByName(moved.select("node", F.col("next").alias("pointer"), "depth", *sums))
        have, reach = cut(got), 2 * reach
    return have.select("node", *sums)


def joined_digests(ends: DataFrame, piece: int = PIECE) -> DataFrame:
    """node, digest: SHA-256 of the ids of each node, ascending, joined by commas. ends: node, conv_id."""

    def ranges(batches):
        import hashlib

        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        kinds = [pa.binary(), pa.int32(), pa.int64(), pa.binary(), pa.bool_()]

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 5, kinds)], ["node", "part", "at", "content", "whole"])

        now, ids, size, at, first = None, [], 0, 0, True
        for batch in batches:
            rows = []
            for node, conv_id in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if node != now:
                    if ids:  # a node between two others is whole here, but for the first
                        text = ",".join(ids).encode()
                        whole = not first and not at
                        rows.append((now, part, at, hashlib.sha256(text).digest() if whole else text, whole))
                        first = False
                    now, ids, size, at = node, [], 0, 0
                elif size >= piece:
                    rows.append((now, part, at, ",".join(ids).encode(), False))
                    ids, size, at = [], 0, at + 1
                ids.append(str(conv_id))
                size += len(ids[-1]) + 1
            yield out(rows)
        yield out([(now, part, at, ",".join(ids).encode(), False)] if ids else [])

    def streams(batches):
        import hashlib

        import pyarrow as pa

        now, state = None, None
        for batch in batches:
            rows = []
            for node, content in zip(batch.column(0), batch.column(1)):
                node, content = node.as_py(), content.as_py()
                if node != now:
                    if now is not None:
                        rows.append((now, state.digest()))
                    now, state = node, hashlib.sha256(content)
                else:
                    state.update(b"," + content)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in (zip(*rows) if rows else ((), ()))], ["node", "digest"])
        last = [(now, state.digest())] if now is not None else []
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in (zip(*last) if last else ((), ()))], ["node", "digest"])

    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = ends.select("node", "conv_id").repartitionByRange(parts, "node", "conv_id").sortWithinPartitions("node", "conv_id")
    pieces = cut(dealt.mapInArrow(ranges, "node binary, part int, at long, content binary, whole boolean"))
    split = pieces.where("NOT whole").repartition("node").sortWithinPartitions("node", "part", "at").select("node", "content")
    return pieces.where("whole").select("node", F.col("content").alias("digest")).unionByName(split.mapInArrow(streams, "node binary, digest binary"))


def trie(table: DataFrame, piece: int = PIECE) -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256. table: conv_id, turn, role, text."""
    rows, convs = rebuilt(turns(table))
    steps = cut(prefixes(rows))
    root = node_key(F.lit(0), F.lit(0), F.lit(0))
    nodes = steps.groupBy("node").agg(F.min("parent").alias("parent"), F.min("at").alias("depth"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("size").alias("size"))
    top = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    top = top.select(root.alias("node"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("depth"), "conv_id", "n_convs", F.lit(0).cast("long").alias("size"))
    nodes = cut(nodes.withColumn("depth", F.col("depth").cast("long")).unionByName(top))
    children = cut(nodes.where("depth > 0").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children")))
    known = nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    known = cut(known.withColumn("n_leaves", (F.col("n_children") == 0).cast("long")).withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("size")))
    sums = rollup(known, ["n_leaves", "saved_tokens"])
    above = known.where("n_children > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    counts = children.select(F.col("node").alias("parent"), F.col("n_children").alias("n"))
    total = children.agg(F.coalesce(F.sum("n_children"), F.lit(0))).first()[0]
    named = spread_join(known.drop("n_leaves", "saved_tokens", "size"), above, "parent", counts, total, "left")
    ends = steps.where("at = length").select("node", "conv_id").unionByName(convs.where("length = 0").select(root.alias("node"), "conv_id"))
    out = named.join(sums, "node").join(joined_digests(ends, piece), "node", "left")
    digest = F.coalesce(F.lower(F.hex("digest")), F.sha2(F.lit(""), 256))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", digest.alias("ends_sha256"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(read(spark, sf_dir, "conversations"))


QUERIES = {"op12_prefix_trie": op12_prefix_trie}

SQL = {
    "op12_prefix_trie": """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS r
  FROM conversations WHERE conv_id IS NOT NULL
), crc AS (
  SELECT conv_id, list_reduce(
    list_concat([4294967295::HUGEINT], flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: list_concat([ord(x)::HUGEINT], list_transform(range(8), lambda y: (-1)::HUGEINT))))),
    lambda acc, x: CASE WHEN x >= 0 THEN xor(acc, x) ELSE xor(acc // 2, (acc % 2) * 3988292384) END) AS v
  FROM (SELECT DISTINCT conv_id FROM t)
), c AS (
  SELECT crc.conv_id, (xor(v, 4294967295) % 9)::BIGINT AS h, crc.conv_id - crc.conv_id % 5 AS base FROM crc
), n AS (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id),
b AS (
  SELECT c.conv_id, t.r AS pos, role, text FROM c JOIN t ON t.conv_id = c.base AND t.r <= c.h
  UNION ALL
  SELECT c.conv_id, least(c.h, coalesce(n.n, 0)) + t.r - c.h, role, text FROM c JOIN t USING (conv_id) LEFT JOIN n ON n.conv_id = c.base WHERE t.r > c.h
), p AS (
  SELECT conv_id, pos, strlen(text) AS size, sha256(string_agg(sha256(strlen(role) || ':' || role || text), '' ORDER BY pos) OVER w) AS node, pos = count(*) OVER (PARTITION BY conv_id) AS is_end
  FROM b WINDOW w AS (PARTITION BY conv_id ORDER BY pos)
), q AS (
  SELECT conv_id, pos, size, node, is_end, coalesce(lag(node) OVER (PARTITION BY conv_id ORDER BY pos), '') AS parent FROM p
  UNION ALL SELECT conv_id, 0, 0, '', conv_id NOT IN (SELECT conv_id FROM p), NULL FROM c
), nodes AS (
  SELECT node, min(pos) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, min(size) AS size, min(parent) AS parent,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE is_end), '')) AS ends_sha256
  FROM q GROUP BY node
), k AS (SELECT parent AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY parent),
full_nodes AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN k USING (node)),
s AS (
  SELECT q.node, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum((n_convs - 1) * f.size)::BIGINT AS saved_tokens
  FROM full_nodes f JOIN q ON q.conv_id = f.conv_id AND q.pos <= f.depth GROUP BY q.node
)
SELECT f.conv_id, f.depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves, s.saved_tokens, f.ends_sha256
FROM full_nodes f JOIN s USING (node) LEFT JOIN nodes u ON u.node = f.parent
"""
}
