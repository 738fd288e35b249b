"""Retrieval: lexical reranking, spine-graph expansion, merging and weighted reciprocal-rank fusion.

Rankings are DataFrames of query_id, id, score, rank. Chunks and rankings that both have a project_id are matched within projects.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..shared import cut
from . import search

# fixed values
EXCLUDED_DOCUMENTS = ["cover.xhtml", "nav.xhtml", "author.xhtml", "copyright.xhtml", "quiz.xhtml"]
CHUNKS_LEFT_OUT = ["HEADING", "ALT_TEXT"]
#: graph weight, seed limit (None: no limit), whether heading and alt-text candidates are left out, branch multiplier
PROFILES = {
    "VECTOR_GRAPH_V1": (0.10, None, False, 1),
    "VECTOR_GRAPH_V2": (0.10, None, False, 1),
    "VECTOR_GRAPH_V3": (0.05, None, False, 1),
    "VECTOR_GRAPH_V4": (0.05, 1, False, 1),
    "VECTOR_GRAPH_V5": (0.025, 1, False, 1),
    "VECTOR_GRAPH_V6": (0.025, 1, True, 1),
    "HYBRID_V1": (0.025, 1, True, 1),
    "HYBRID_V2": (0.025, 1, True, 2),
    "HYBRID_V3": (0.025, 1, True, 2),
    "HYBRID_V4": (0.025, 1, True, 2),
    "HYBRID_V5": (0.025, 1, True, 2),
    "HYBRID_V6": (0.025, 1, True, 2),
}
MODES = ["VECTOR_ONLY", "VECTOR_GRAPH", "HYBRID"]
RERANK_CANDIDATES = 10  # times k
GRAPH_CANDIDATES = 3
MINIMUM_SCORE = 0.45


def mode(name: str | None) -> str:
    """A retrieval mode by its name in any case; VECTOR_ONLY if there is none."""
    found = (name or "").strip().upper() or MODES[0]
    if found not in MODES:
        raise ValueError(f"unknown retrieval mode {name}")
    return found


def ranked(rows: DataFrame, k: int | None = None, *ties: str) -> DataFrame:
    """rank by score, then ties, then id; the first k of each query."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), *ties, "id")
    out = rows.withColumn("rank", F.row_number().over(order))
    return out if k is None else out.where(F.col("rank") <= k)


def rerank(candidates: DataFrame, chunks: DataFrame, queries: DataFrame, k: int, minimum: float | None = None, document_order: bool = False) -> DataFrame:
    """candidates (query_id, id, score) with score + lexical boost * weight of the query's intent; those of at least minimum, the first k.

    chunks: id, title, content, source_path, sequence. queries: query_id, query_text. In document order the first k by position are
    taken, not the best k. Titles and contents are normalised once a chunk, however many queries have it as a candidate.
    """
    asked = queries.select("query_id", "query_text", T.keywords("query_text").alias("keywords"), T.rerank_weight("query_text").alias("weight"))
    key = ["project_id", "id"] if "project_id" in candidates.columns and "project_id" in chunks.columns else ["id"]
    wanted = chunks.join(candidates.select(*key).distinct(), key, "left_semi")
    wanted = wanted.select(*key, "source_path", "sequence", T.normalize_match("title").alias("heading"), T.normalize_match("content").alias("body"), T.has_title_brackets(F.coalesce("content", F.lit(""))).alias("titled"))
    rows = candidates.select("query_id", *key, F.col("score").alias("vector_score")).join(wanted, key).join(asked, "query_id")
    boost = T.boost_of(T.normalize_match("query_text"), F.col("keywords"), F.col("heading"), F.col("body"), F.col("titled"))
    rows = rows.withColumn("boost", boost).withColumn("score", F.round(F.col("vector_score") + F.col("boost") * F.col("weight"), 9))
    if minimum is not None:
        rows = rows.where(F.col("score") >= minimum)
    if document_order:
        order = Window.partitionBy("query_id").orderBy("source_path", "sequence", "id")
        rows = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    else:
        rows = ranked(rows, k)
    return rows.select("query_id", "id", "vector_score", "boost", "score", "rank")


def eligible(path) -> Column:
    """Whether the graph may use a document: no cover, navigation, author, copyright, quiz or part page."""
    name = F.lower(T.file_name(T.normalize_path(path)))
    return F.coalesce(~name.isin(EXCLUDED_DOCUMENTS) & ~(name.startswith("part") & name.endswith(".xhtml")), F.lit(False))


def spine_edges(spine: DataFrame) -> DataFrame:
    """source_path, neighbor: previous and next linear document of a project's spine (project_id, source_path, position, linear)."""
    order = Window.partitionBy("project_id").orderBy("position")
    placed = spine.where("linear").select("project_id", "source_path", F.lag("source_path").over(order).alias("before"), F.lead("source_path").over(order).alias("after"))
    both = placed.select("project_id", "source_path", F.explode(F.array("before", "after")).alias("neighbor"))
    return both.where("neighbor is not null").distinct()


def graph_neighbors(hits: DataFrame, edges: DataFrame, seed_limit: int | None = 1) -> DataFrame:
    """query_id, project_id, source_path, graph_score of the spine neighbours of each query's seed documents.

    hits: query_id, project_id, source_path, rank. Seeds are the first seed_limit distinct eligible documents in rank order.
    """
    seeds = hits.where(eligible(F.col("source_path"))).groupBy("query_id", "project_id", "source_path").agg(F.min("rank").alias("first"))
    order = Window.partitionBy("query_id").orderBy("first", "source_path")
    seeds = seeds.withColumn("seed", F.row_number().over(order))
    if seed_limit is not None:
        seeds = seeds.where(F.col("seed") <= seed_limit)
    found = seeds.join(edges, ["project_id", "source_path"]).select("query_id", "project_id", F.col("neighbor").alias("source_path"))
    found = found.where(eligible(F.col("source_path"))).join(seeds.select("query_id", "project_id", "source_path"), ["query_id", "project_id", "source_path"], "left_anti")
    return found.groupBy("query_id", "project_id", "source_path").agg(F.lit(1.0).alias("graph_score"))


def merge_graph(vector: DataFrame, graph: DataFrame, weight: float, k: int) -> DataFrame:
    """Vector results with graph candidates (score, graph_score): of an id the graph version counts only if strictly higher."""
    plain = vector.select("query_id", "id", "score", F.lit("VECTOR").alias("origin"))
    expanded = graph.select("query_id", "id", F.round(F.col("score") + F.col("graph_score") * weight, 9).alias("score"), F.lit("VECTOR_GRAPH").alias("origin"))
    order = Window.partitionBy("query_id", "id").orderBy(F.desc("score"), "origin")
    best = plain.unionByName(expanded).withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")
    return ranked(best, k)


def graph_branch(found: DataFrame, chunks: DataFrame, queries: DataFrame, edges: DataFrame, k: int, profile: str, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """found (a ranking of vectors) with candidates from the spine neighbours of its documents merged in, by a profile.

    chunks: project_id, source_path, type, id and vector. queries: project_id, id and vector.
    """
    weight, seeds, left_out, _ = PROFILES[profile]
    named = chunks.withColumnRenamed(id_col, "id") if id_col != "id" else chunks
    own = queries.select(F.col(id_col).alias("query_id"), "project_id", F.col(vector_col).alias("_asked"))
    hits = found.join(own.select("query_id", "project_id"), "query_id").join(named.select("project_id", "id", "source_path"), ["project_id", "id"])
    near = graph_neighbors(hits, edges, seeds)
    pool = named.where(~F.col("type").isin(CHUNKS_LEFT_OUT)) if left_out else named
    there = near.join(pool.select("project_id", "source_path", "id", F.col(vector_col).alias("_vector")), ["project_id", "source_path"]).join(own.select("query_id", "_asked"), "query_id").where("id <> query_id")
    scored = there.select("query_id", "id", "graph_score", F.round(V.cosine("_vector", "_asked"), 9).alias("score"))
    return merge_graph(found, ranked(scored, k * GRAPH_CANDIDATES), weight, k)


def retrieve(chunks: DataFrame, queries: DataFrame, edges: DataFrame, k: int, by: str = "HYBRID", profile: str = "HYBRID_V2", id_col: str = "vec_id", vector_col: str = "embedding", question_col: str | None = None, minimum: float | None = None) -> DataFrame:
    """The k best chunks of each query within its project, by a retrieval mode: vectors alone, with spine neighbours, or both branches fused.

    With question_col, a column of queries, RERANK_CANDIDATES times as many vectors are found and reranked by its words (chunks then need title and content); minimum, a score,
    holds for reranked scores, or for those of vectors where nothing is reranked.
    """
    branch = k * (PROFILES[profile][3] if mode(by) == "HYBRID" else 1)
    wide = branch * (RERANK_CANDIDATES if question_col else 1)
    found = search.topk(chunks, queries, wide, minimum=None if question_col else minimum, scope_col="project_id", id_col=id_col, vector_col=vector_col).drop("accepted")
    if question_col:
        asked = queries.select(F.col(id_col).alias("query_id"), "project_id", F.coalesce(question_col, F.lit("")).alias("query_text"))
        named = chunks.withColumnRenamed(id_col, "id") if id_col != "id" else chunks
        found = rerank(found.join(asked.select("query_id", "project_id"), "query_id"), named, asked.drop("project_id"), branch, minimum).select("query_id", "id", "score", "rank")
    found = cut(found)  # both branches read it
    if mode(by) == "VECTOR_ONLY":
        return found
    graph = graph_branch(found, chunks, queries, edges, branch, profile, id_col, vector_col)
    return graph if mode(by) == "VECTOR_GRAPH" else fuse(found, graph, k)


def fuse(one: DataFrame, other: DataFrame, k: int, weights: tuple[float, float] = (0.7, 0.3), constant: int = 60) -> DataFrame:
    """Weighted reciprocal-rank fusion of two rankings; ties by the better rank, then id.

    Each result says where it comes from: retrieval_source (HYBRID if both have it, else VECTOR or VECTOR_GRAPH), its ranks and parts of the score.
    """
    a = one.select("query_id", "id", F.col("rank").alias("vector_rank"))
    b = other.select("query_id", "id", F.col("rank").alias("graph_rank"))
    part = lambda c, w: F.coalesce(w / (constant + F.col(c)), F.lit(0.0))
    rows = a.join(b, ["query_id", "id"], "full").withColumns({"vector_rrf_score": part("vector_rank", weights[0]), "graph_rrf_score": part("graph_rank", weights[1])})
    rows = rows.withColumn("score", F.round(F.col("vector_rrf_score") + F.col("graph_rrf_score"), 9))
    both = F.col("vector_rank").isNotNull() & F.col("graph_rank").isNotNull()
    rows = rows.withColumn("retrieval_source", F.when(both, "HYBRID").when(F.col("graph_rank").isNotNull(), "VECTOR_GRAPH").otherwise("VECTOR"))
    return ranked(rows.withColumn("best_rank", F.least("vector_rank", "graph_rank")), k, "best_rank")
