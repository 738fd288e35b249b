"""Context assembly: neighbour expansion, source blocks, budget packing and the prompt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUDGET = 18_000
PROMPT_BUDGET = 24_000
NOTICE = "[Further sources were left out because the context is full.]"


def expand(hits: DataFrame, chunks: DataFrame, before: int = 1, after: int = 1) -> DataFrame:
    """Each hit's chunks at positions -before to +after in its source; of repeated chunks of a query the first stays.

    hits: query_id, project_id, id, rank. chunks: project_id, id, source_path, sequence. Only sources with a hit are put in order. Returns
    query_id, project_id, id, source_path, position, hit_rank, place (from 1).
    """
    source = ["project_id", "source_path"]
    found = hits.select("query_id", "project_id", "id", F.col("rank").alias("hit_rank")).join(chunks.select("project_id", "id", "source_path"), ["project_id", "id"])
    order = Window.partitionBy(*source).orderBy("sequence", "id")
    wanted = chunks.select(*source, "id", "sequence").join(found.select(*source).distinct(), source, "left_semi")
    placed = wanted.select(*source, "id", F.row_number().over(order).alias("position"))
    at = found.join(placed, [*source, "id"]).select("query_id", "hit_rank", *source, F.explode(F.sequence(F.col("position") - before, F.col("position") + after)).alias("position"))
    rows = at.join(placed, [*source, "position"])
    first = rows.groupBy("query_id", "project_id", "id", "source_path", "position").agg(F.min("hit_rank").alias("hit_rank"))
    places = Window.partitionBy("query_id").orderBy("hit_rank", "position", "id")
    return first.withColumn("place", F.row_number().over(places))


def source_block(rank, title, path, score, content) -> Column:
    return F.concat(F.format_string("[%d] %s\nSource: %s\nScore: %.4f\n", rank, title, path, score), content)


def pack(blocks: DataFrame, budget: int = BUDGET, notice: str = NOTICE) -> DataFrame:
    """Adds end (length of the context up to this block) and included to blocks (query_id, place, block).

    Blocks are taken in order, two line feeds apart, until one does not fit together with the notice that is reserved while blocks
    remain; none is taken after the first that does not fit.
    """
    order = Window.partitionBy("query_id").orderBy("place")
    whole = Window.partitionBy("query_id")
    ends = F.sum(F.length("block") + F.when(F.col("place") > 1, 2).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = blocks.withColumn("end", ends).withColumn("last", F.max("place").over(whole))
    needed = F.col("end") + F.when(F.col("place") < F.col("last"), 2 + len(notice)).otherwise(0)
    rows = rows.withColumn("_over", F.min(F.when(needed > budget, F.col("place"))).over(whole))
    return rows.withColumn("included", F.col("_over").isNull() | (F.col("place") < F.col("_over"))).drop("_over", "last")


def contexts(packed: DataFrame, notice: str = NOTICE, budget: int = BUDGET) -> DataFrame:
    """One row per query: context (with as much of the notice as fits, if blocks were left out), original, included and omitted counts, truncated, and highest_score of all blocks if they have a score."""
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("included"), F.struct("place", "block")))), lambda x: x["block"]), "\n\n")
    highest = F.max("score" if "score" in packed.columns else F.lit(None).cast("double")).alias("highest_score")
    rows = packed.groupBy("query_id").agg(text.alias("context"), F.count("*").alias("original_count"), F.count_if("included").alias("included_count"), highest)
    rows = rows.withColumn("omitted_count", F.col("original_count") - F.col("included_count")).withColumn("truncated", F.col("omitted_count") > 0)
    joined = F.when(F.col("context") == "", F.lit(notice)).otherwise(F.concat("context", F.lit("\n\n" + notice)))
    return rows.withColumn("context", F.when(F.col("truncated"), F.substring(joined, 1, budget)).otherwise(F.col("context")))


def prompt(role: Column, context: Column, request: Column, rules: Column) -> Column:
    """The parts under headings; an error if context or prompt exceed their budgets."""
    whole = F.concat_ws("\n\n", F.concat(F.lit("# Role\n"), role), F.concat(F.lit("# Context\n"), context), F.concat(F.lit("# Request\n"), request), F.concat(F.lit("# Rules\n"), rules))
    return F.when(F.length(context) > BUDGET, F.raise_error(F.lit("the context is too long"))).when(F.length(whole) > PROMPT_BUDGET, F.raise_error(F.lit("the prompt is too long"))).otherwise(whole)
