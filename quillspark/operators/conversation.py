"""Conversation log: sequence numbers, history and listing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import ranked, spread_join
from ..sources import store as versions


def append(messages: DataFrame, incoming: DataFrame, order_col: str = "created_at") -> DataFrame:
    """incoming with sequence_no after the largest of its conversation in messages, in order of order_col.

    Places are counted in ranges of (conversation_id, order_col), so a conversation of very many messages is no task's alone.
    """
    last = messages.groupBy("conversation_id").agg(F.max("sequence_no").alias("_last"))
    counts = incoming.groupBy("conversation_id").agg(F.count("*").alias("n"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    placed = ranked(incoming.drop("sequence_no"), ["conversation_id"], [F.col(order_col)], "_place")
    return spread_join(placed, last, "conversation_id", counts, total, "left").select(*(c for c in incoming.columns if c != "sequence_no"), (F.coalesce("_last", F.lit(0)) + F.col("_place")).alias("sequence_no"))


KEY = ("conversation_id",)
BITS = 8  # a new log has 2 ** BITS buckets of conversations; writers of different buckets don't meet


def append_to(spark: SparkSession, folder: str, incoming: DataFrame, order_col: str = "created_at", tries: int = 10) -> versions.Version:
    """Append messages to a log in a store of versions, with sequence numbers that no other writer has.

    The numbers after the last ones read are a claim that the commit makes good: if another writer has committed to one of these buckets of conversations since they
    were read, all numbers are given out anew. A commit adds files and rewrites none.
    """

    def once() -> versions.Version:
        base = versions.load(spark, folder)
        if not base.number:
            base.buckets = {(BITS, v): [] for v in range(1 << BITS)}
        touched = versions.buckets_of(base, incoming, KEY)
        if not touched:
            return base
        held = versions.read(spark, folder, base, touched)
        held = incoming.where("false").select("conversation_id", F.lit(0).cast("long").alias("sequence_no")) if held is None else held
        rows = append(held, incoming, order_col)
        return versions.commit(spark, folder, base, touched, rows, ["conversation_id", "sequence_no"], columns=KEY, append=True)

    return versions.retried(once, tries)


def next_sequence(messages: DataFrame) -> DataFrame:
    return messages.groupBy("conversation_id").agg((F.coalesce(F.max("sequence_no"), F.lit(0)) + 1).alias("next_sequence"))


def history(messages: DataFrame, current_run: str | None = None) -> DataFrame:
    """User and assistant messages without those of the current run; order them by conversation_id, sequence_no."""
    rows = messages.where(F.col("role").isin("USER", "ASSISTANT"))
    return rows if current_run is None else rows.where(~F.col("run_id").eqNullSafe(current_run))


def get_or_create(conversations: DataFrame, wanted: DataFrame) -> DataFrame:
    """conversations (conversation_id, project_id, title, status, created_at, updated_at) with those of wanted (conversation_id, project_id, title, at) that are not there, as ACTIVE; the others stay as they are."""
    new = wanted.join(conversations.select("conversation_id"), "conversation_id", "left_anti")
    new = new.groupBy("conversation_id").agg(F.min_by(F.struct("project_id", "title", "at"), F.struct("at", "project_id", "title")).alias("f"))
    new = new.select("conversation_id", "f.project_id", "f.title", F.lit("ACTIVE").alias("status"), F.col("f.at").alias("created_at"), F.col("f.at").alias("updated_at"))
    return conversations.unionByName(new.select(*conversations.columns))


def touch(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """conversations with updated_at no earlier than their last message's created_at."""
    last = messages.groupBy("conversation_id").agg(F.max("created_at").alias("_last"))
    return conversations.join(last, "conversation_id", "left").withColumn("updated_at", F.greatest("updated_at", "_last")).select(*conversations.columns)


def by_project(conversations: DataFrame, project_id: str) -> DataFrame:
    return conversations.where(F.col("project_id") == project_id).orderBy(F.desc("updated_at"), "conversation_id")


def foreign(messages: DataFrame, conversations: DataFrame) -> DataFrame:
    """Messages that name another project than their conversation's, or no known conversation."""
    known = conversations.select("conversation_id", F.col("project_id").alias("_project"))
    return messages.join(known, "conversation_id", "left").where(~F.col("project_id").eqNullSafe(F.col("_project"))).drop("_project")
