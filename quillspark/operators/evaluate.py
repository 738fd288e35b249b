"""Evaluation of retrieval: per-case metrics, summaries, comparison of runs, regression checks, latencies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

RANK_EPSILON = 1e-7
BINS = 256
STEP = 16  # edges between two coarse ones


def case_metrics(expected: DataFrame, retrieved: DataFrame) -> DataFrame:
    """case_id, hit, recall, reciprocal_rank of every case with expected sources.

    expected: case_id, source. retrieved: case_id, source, rank. Sources count once; cases without expected sources are not applicable and absent.
    """
    wanted = expected.select("case_id", "source").distinct()
    first = retrieved.groupBy("case_id", "source").agg(F.min("rank").alias("rank"))
    rows = wanted.join(first, ["case_id", "source"], "left").groupBy("case_id").agg(F.count("*").alias("expected"), F.count("rank").alias("matched"), F.min("rank").alias("first_rank"))
    return rows.select("case_id", "expected", "matched", (F.col("matched") > 0).alias("hit"), (F.col("matched") / F.col("expected")).alias("recall"), F.coalesce(1 / F.col("first_rank"), F.lit(0.0)).alias("reciprocal_rank"))


def select_cases(cases: DataFrame, ids: list[str] | None = None) -> DataFrame:
    """Of cases (case_id, expected_documents) those with expected documents and, if ids are given, of these ids; an id that gives no such case is an error."""
    found = cases.where(F.size("expected_documents") > 0)
    wanted = sorted({i.strip() for i in ids or [] if i and i.strip()})
    if not wanted:
        return found
    found = found.where(F.col("case_id").isin(wanted))
    there = {r.case_id for r in found.select("case_id").distinct().collect()}  # at most as many as ids
    if missing := [i for i in wanted if i not in there]:
        raise ValueError(f"cases not found or without expected documents: {missing}")
    return found


def document_deltas(baseline: DataFrame, candidate: DataFrame, expected: DataFrame) -> DataFrame:
    """Sources of two runs (case_id, source, rank, retrieval_source) side by side: ranks, rank_delta, added, removed, whether expected, and whether the graph gave it (anew)."""
    first = lambda rows, n: rows.groupBy("case_id", "source").agg(F.min("rank").alias(f"{n}_rank"), F.min_by("retrieval_source", "rank").alias(f"{n}_source"))
    wanted = expected.select("case_id", "source").distinct().withColumn("is_expected", F.lit(True))
    rows = first(baseline, "baseline").join(first(candidate, "candidate"), ["case_id", "source"], "full").join(wanted, ["case_id", "source"], "left")
    added = F.col("baseline_rank").isNull() & F.col("candidate_rank").isNotNull()
    graph = F.coalesce(F.col("candidate_source") == "VECTOR_GRAPH", F.lit(False))
    return rows.withColumns({"is_expected": F.coalesce("is_expected", F.lit(False)), "rank_delta": F.col("candidate_rank") - F.col("baseline_rank"), "added": added, "removed": F.col("baseline_rank").isNotNull() & F.col("candidate_rank").isNull(), "graph_candidate": graph, "new_graph_candidate": added & graph})


def summary(cases: DataFrame) -> DataFrame:
    return cases.agg(F.count("*").alias("evaluated_cases"), F.count_if("hit").alias("hits"), F.avg(F.col("hit").cast("double")).alias("hit_rate"), F.avg("recall").alias("mean_recall"), F.avg("reciprocal_rank").alias("mrr"))


def metric_averages(metrics: DataFrame) -> DataFrame:
    """metric, mean over applicable cases, and mean_with_zeros, which counts cases where the metric does not apply as 0. metrics: case_id, metric, score, applicable."""
    return metrics.groupBy("metric").agg(F.avg(F.when(F.col("applicable"), F.col("score"))).alias("mean"), F.avg(F.when(F.col("applicable"), F.col("score")).otherwise(0.0)).alias("mean_with_zeros"))


def overall(metrics: DataFrame) -> DataFrame:
    """Mean over the applicable metrics of each case."""
    return metrics.groupBy("case_id").agg(F.avg(F.when(F.col("applicable"), F.col("score"))).alias("overall"))


def applicable_metrics(cases: DataFrame) -> DataFrame:
    """case_id, metric, applicable of the five judged metrics. cases: case_id, type (ANSWERABLE or NO_ANSWER)."""
    no_answer = F.col("type") == "NO_ANSWER"
    names = {"faithfulness": F.lit(True), "answer_relevancy": F.lit(True), "context_precision": ~no_answer, "context_recall": ~no_answer, "no_answer_detection": no_answer}
    rows = F.array(*(F.struct(F.lit(n).alias("metric"), a.alias("applicable")) for n, a in names.items()))
    return cases.select("case_id", F.explode(rows).alias("m")).select("case_id", "m.*")


def judge_score(reply):
    """The score of a judge's reply: the text from the first { to the last } as JSON; null unless it is within [0, 1]."""
    score = F.get_json_object(F.regexp_extract(reply, "(?s)(\\{.*\\})", 1), "$.score").cast("double")
    return F.when(score.between(0, 1), score)


def compare(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """Cases of two runs side by side with change, deltas and first ranks.

    A case of one run only gives change MISSING; one whose retrieval doesn't apply in either run (column applicable, where runs have it; null is no) gives NOT_APPLICABLE.
    """

    def side(run: DataFrame, name: str) -> DataFrame:
        applies = F.coalesce("applicable", F.lit(False)) if "applicable" in run.columns else F.lit(True)
        return run.select("case_id", applies.alias(f"{name}_applies"), F.col("hit").alias(f"{name}_hit"), F.col("recall").alias(f"{name}_recall"), F.col("reciprocal_rank").alias(f"{name}_mrr"))

    a, b = side(baseline, "old"), side(candidate, "new")
    old, new, applies = F.col("old_hit"), F.col("new_hit"), F.col("old_applies") & F.col("new_applies")
    change = F.when(F.col("old_applies").isNull() | F.col("new_applies").isNull(), "MISSING").when(~applies | old.isNull() | new.isNull(), "NOT_APPLICABLE").when(~old & new, "MISS_TO_HIT").when(old & ~new, "HIT_TO_MISS").when(old, "STABLE_HIT").otherwise("STABLE_MISS")
    rank = lambda c: F.when(F.col(c) > 0, F.round(1 / F.col(c)).cast("int"))
    return a.join(b, "case_id", "full").select("case_id", change.alias("change"), (F.col("new_recall") - F.col("old_recall")).alias("recall_delta"), (F.col("new_mrr") - F.col("old_mrr")).alias("mrr_delta"), rank("old_mrr").alias("old_rank"), rank("new_mrr").alias("new_rank"))


def compare_reports(baseline: DataFrame, candidate: DataFrame, datasets: tuple[str, str] | None = None) -> DataFrame:
    """compare of two whole reports: an error if their datasets differ, a case id is blank or repeated, or a case is in one of them only."""
    if datasets and datasets[0] != datasets[1]:
        raise ValueError(f"reports of different datasets: {datasets[0]} and {datasets[1]}")
    for name, run in (("baseline", baseline), ("candidate", candidate)):
        blank = T.jtrim(F.coalesce(F.col("case_id").cast("string"), F.lit(""))) == ""
        wrong = run.groupBy("case_id").agg(F.count("*").alias("n")).where(blank | (F.col("n") > 1)).first()
        if wrong:
            raise ValueError(f"{name}: case {wrong.case_id!r} is repeated or has no id")
    found = compare(baseline, candidate)
    lost = found.where("change = 'MISSING'").first()
    if lost:
        raise ValueError(f"case {lost.case_id!r} is in one report only")
    return found


def compare_summary(compared: DataFrame) -> DataFrame:
    count = lambda c: F.count_if(F.col("change") == c).alias(c.lower())
    moved = (F.col("change") == "STABLE_HIT") & (F.abs("mrr_delta") > RANK_EPSILON)
    return compared.agg(*(count(c) for c in ("MISS_TO_HIT", "HIT_TO_MISS", "STABLE_HIT", "STABLE_MISS", "NOT_APPLICABLE", "MISSING")), F.count_if(moved & (F.col("mrr_delta") > 0)).alias("rank_improved"), F.count_if(moved & (F.col("mrr_delta") < 0)).alias("rank_regressed"))


def regression(baseline: DataFrame, current: DataFrame, datasets: tuple[str, str] | None = None) -> DataFrame:
    """metric, score, floor, current, passed of every baseline metric; a metric without a current score fails.

    baseline: metric, score, tolerance. current: metric, score. datasets: the names of both runs' datasets, which must be one.
    """
    if datasets and datasets[0] != datasets[1]:
        raise ValueError(f"runs of different datasets: {datasets[0]} and {datasets[1]}")
    floor = F.greatest(F.lit(0.0), F.col("score") - F.col("tolerance"))
    rows = baseline.withColumn("floor", floor).join(current.select("metric", F.col("score").alias("current")), "metric", "left")
    return rows.withColumn("passed", F.coalesce(F.col("current") >= F.col("floor"), F.lit(False)))


def regression_verdict(checked: DataFrame) -> DataFrame:
    """One row: passed only if there are metrics and all pass."""
    return checked.agg(F.count("*").alias("metrics"), (F.coalesce(F.bool_and("passed"), F.lit(False))).alias("passed"))


def latencies(samples: DataFrame, value_col: str, *by: str) -> DataFrame:
    """Count, mean, extremes and nearest-rank percentiles of each group.

    Percentiles are exact and no group is gathered in one task: values are counted in BINS ranges between approximate quantiles, whose
    running sums say which range holds each rank, and values are put in order within those ranges only.
    """
    if not by:
        return latencies(samples.withColumn("_all", F.lit(0)), value_col, "_all").drop("_all")
    bins, shares = [i / BINS for i in range(1, BINS)], {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    rows = samples.where(F.col(value_col).isNotNull()).select(*by, F.col(value_col).alias("_x"))
    whole = samples.groupBy(*by).agg(F.count(value_col).alias("n"), F.avg(value_col).alias("average"), F.min(value_col).alias("least"), F.max(value_col).alias("most"), F.percentile_approx(value_col, bins, 10_000).alias("_edges"))
    key = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in by]
    named = whole.select(*(F.col(c).alias(f"_k_{c}") for c in by), "_edges", F.transform(F.sequence(F.lit(STEP), F.lit(BINS - STEP), F.lit(STEP)), lambda i: F.element_at("_edges", i)).alias("_coarse"), F.array(*(F.greatest(F.lit(1), F.ceil(F.col("n") * p)) for p in shares.values())).alias("_ranks"))
    below = lambda edges: F.size(F.filter(edges, lambda e: e < F.col("_x")))
    within = F.transform(F.array(below(F.col("_coarse")) * STEP), lambda at: at + below(F.slice("_edges", at + 1, F.lit(STEP))))  # coarse edges first, then those between two of them
    placed = rows.join(named, key).withColumn("_bin", within[0])
    group = [f"_k_{c}" for c in by]
    sums = placed.groupBy(*group, "_bin").agg(F.count("*").alias("_m"), F.first("_ranks").alias("_ranks"))
    before = F.sum("_m").over(Window.partitionBy(*group).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_m")
    hit = sums.withColumn("_before", before).where(F.exists("_ranks", lambda r: (r > F.col("_before")) & (r <= F.col("_before") + F.col("_m"))))
    same = [F.col(f"_k_{c}").eqNullSafe(F.col(f"_h_{c}")) for c in by]
    hit = hit.select(*(F.col(c).alias(f"_h_{c[3:]}") for c in group), F.col("_bin").alias("_hit_bin"), "_before")
    held = placed.groupBy(*group, "_bin", "_x").agg(F.count("*").alias("_m"), F.first("_ranks").alias("_ranks")).join(hit, [F.col("_bin") == F.col("_hit_bin"), *same])
    ends = F.col("_before") + F.sum("_m").over(Window.partitionBy(*group, "_bin").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0))
    held = held.withColumn("_end", ends)
    found = held.groupBy(*group).agg(*(F.min(F.when((F.col("_ranks")[i] <= F.col("_end")) & (F.col("_ranks")[i] > F.col("_end") - F.col("_m")), F.col("_x"))).alias(p) for i, p in enumerate(shares)))
    return whole.drop("_edges").join(found, key, "left").drop(*group)
