"""How the test tables stand in for the library's own: chunks, spines and stores, each as DataFrame and as SQL of the same name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def document_name(n: Column) -> Column:
    """File name of a project's n-th document."""
    return F.when(n == 0, "cover.xhtml").when(n == 1, "nav.xhtml").when(n % 13 == 5, F.concat(F.lit("part"), n, F.lit(".xhtml"))).otherwise(F.concat(F.lit("chapter"), n, F.lit("_"), n + 1, F.lit(".xhtml")))


NAME_SQL = "CASE WHEN {n} = 0 THEN 'cover.xhtml' WHEN {n} = 1 THEN 'nav.xhtml' WHEN {n} % 13 = 5 THEN 'part' || {n} || '.xhtml' ELSE 'chapter' || {n} || '_' || ({n} + 1) || '.xhtml' END"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings with project_id (the label), source_path (one for each 50 ids), sequence and type: projects and their spines grow with the table."""
    rows = read(spark, sf_dir, "embeddings")
    n = F.floor(F.col("vec_id") / 50).cast("int")
    kinds = F.array(*map(F.lit, ("PARAGRAPH", "HEADING", "PARAGRAPH", "LIST_ITEM", "ALT_TEXT")))
    return rows.select("vec_id", "embedding", "label", F.col("label").alias("project_id"), document_name(n).alias("source_path"), n.alias("document"), (F.col("vec_id") % 50).alias("sequence"), F.element_at(kinds, (F.col("vec_id") % 5 + 1).cast("int")).alias("type"))


VECTORS_SQL = f"""v AS (SELECT vec_id, embedding::DOUBLE[] AS e, label, label AS project_id, {NAME_SQL.format(n="(vec_id // 50)")} AS source_path, vec_id // 50 AS document, vec_id % 50 AS sequence,
  ['PARAGRAPH', 'HEADING', 'PARAGRAPH', 'LIST_ITEM', 'ALT_TEXT'][(vec_id % 5 + 1)::INT] AS type FROM embeddings)"""


def queries(vectors: DataFrame) -> DataFrame:
    """The stated query set: every row whose id is divisible by 100, against all rows."""
    return vectors.where("vec_id % 100 = 0")


#: cosine of every query with every other vector, s(query_id, id, score); p is the same within projects
SCORES_SQL = f"""{VECTORS_SQL},
s AS (SELECT q.vec_id AS query_id, v.vec_id AS id, round(list_cosine_similarity(q.e, v.e), 9) AS score, q.project_id = v.project_id AS near FROM v AS q, v WHERE q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id)"""


def line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as PARAGRAPH chunks: source_path, sequence (from 1, with blank lines left out), content."""
    from ..operators import chunk

    docs = read(spark, sf_dir, "documents").withColumn("source_path", F.concat(F.lit("doc"), "doc_id", F.lit(".txt")))
    rows = chunk.plain_blocks(docs, "source_path", "text", "\\n")
    return rows.withColumn("sequence", F.col("sequence") + 1).withColumn("type", F.when(F.col("sequence") % 7 == 0, "QUOTE").otherwise("PARAGRAPH"))


BLANKS = "[ \\t\\n\\x0B\\f\\r]+"
LINES_SQL = f"""l0 AS (SELECT 'doc' || doc_id || '.txt' AS source_path, list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '\\r\\n?', '\n', 'g'), '\n'), lambda x: regexp_replace(regexp_replace(replace(x, ' ', ' '), '{BLANKS}', ' ', 'g'), '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g')), lambda x: x <> '') AS a FROM documents),
l1 AS (SELECT source_path, unnest(a) AS content, unnest(range(1, len(a) + 1)) AS sequence FROM l0),
l AS (SELECT source_path, sequence, content, CASE WHEN sequence % 7 = 0 THEN 'QUOTE' ELSE 'PARAGRAPH' END AS type FROM l1)"""


def stored_and_current(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A store of documents as it was, and documents as they are: every 7th has changed, every 11th is new, every 13th is gone."""
    rows = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit("m").alias("model"), F.col("source").alias("project_id"), F.concat("source", F.lit("/"), F.floor(F.col("doc_id") / 100), F.lit(".xhtml")).alias("source_path"), T.sha256_hex("text").alias("content_hash"))
    old = rows.where("id % 11 <> 0")
    new = rows.where("id % 13 <> 0").withColumn("content_hash", F.when(F.col("id") % 7 == 0, F.sha2(F.concat("content_hash", F.lit("+")), 256)).otherwise(F.col("content_hash")))
    return old, new


SYNC_SQL = """d AS (SELECT doc_id AS id, source AS project_id, source || '/' || (doc_id // 100) || '.xhtml' AS source_path, sha256(coalesce(text, '')) AS h FROM documents),
o AS (SELECT * FROM d WHERE id % 11 <> 0),
n AS (SELECT id, project_id, source_path, CASE WHEN id % 7 = 0 THEN sha256(h || '+') ELSE h END AS h FROM d WHERE id % 13 <> 0)"""


def stored_and_current_projects(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The same with every id and path in two projects, of which other documents have changed, are new or are gone."""
    rows = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit("m").alias("model"), F.explode(F.array(F.lit("A"), F.lit("B"))).alias("project_id"), F.concat(F.lit("c"), F.floor(F.col("doc_id") / 100), F.lit(".xhtml")).alias("source_path"), T.sha256_hex("text").alias("content_hash"), F.coalesce("text", F.lit("")).alias("embedding_text"))
    old = rows.where("id % 11 <> 0 AND NOT (project_id = 'B' AND id % 17 = 0)")
    changed = F.expr("(project_id = 'A' AND id % 7 = 0) OR (project_id = 'B' AND id % 5 = 0)")
    new = rows.where("id % 13 <> 0 AND NOT (project_id = 'A' AND id BETWEEN 100 AND 199)")
    return old, new.withColumn("content_hash", F.when(changed, F.sha2(F.concat("content_hash", F.lit("+")), 256)).otherwise(F.col("content_hash")))


PROJECTS_SQL = """d AS (SELECT doc_id AS id, p AS project_id, 'c' || (doc_id // 100) || '.xhtml' AS source_path, sha256(coalesce(text, '')) AS h FROM documents, (VALUES ('A'), ('B')) AS t(p)),
o AS (SELECT * FROM d WHERE id % 11 <> 0 AND NOT (project_id = 'B' AND id % 17 = 0)),
n AS (SELECT id, project_id, source_path, CASE WHEN (project_id = 'A' AND id % 7 = 0) OR (project_id = 'B' AND id % 5 = 0) THEN sha256(h || '+') ELSE h END AS h FROM d WHERE id % 13 <> 0 AND NOT (project_id = 'A' AND id BETWEEN 100 AND 199))"""
