"""Index synchronisation over a stream of changed chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import search, sync
from ..sources import store as versions


def synchronize_stream(changes: DataFrame, store: str, checkpoint: str, embedder, key: tuple[str, ...] = sync.KEY, available_now: bool = True, bucket_rows: int = versions.BUCKET_ROWS, keep: int = 2) -> StreamingQuery:
    """Bring a store of versions up to date with a stream of chunks of changed sources.

    Each chunk carries its source's version (source_version, a long that rises whenever the source is read anew). A source's chunks may come in any
    number of batches: those of one version add up, those of a later version replace all of an earlier one, and those of an earlier
    version than the stored one are left out. A chunk with the key and hash of a stored one of an earlier version keeps its vector if it
    comes with the first batch of its version; later it is embedded anew.

    A batch reads and writes only the buckets that its sources are in, and is one commit that notes the number of the batch, under the checkpoint's name: a batch that
    is run again after its commit changes nothing. Other streams and `sync.merge` may write the same store. Files that only versions before the last `keep` name are deleted.
    """

    def batch(current: DataFrame, number: int) -> None:
        spark = current.sparkSession

        def once() -> None:
            base = versions.load(spark, store)
            if base.notes.get(checkpoint, -1) >= number:
                return
            fresh = search.newest(current, list(dict.fromkeys([*sync.SOURCE, *key])), "source_version")
            touched = versions.buckets_of(base, fresh)
            if touched:
                rows = merged(fresh, versions.read(spark, store, base, touched))
                versions.commit(spark, store, base, touched, rows, list(key), {checkpoint: number}, bucket_rows=bucket_rows)

        versions.retried(once)
        versions.vacuum(spark, store, keep)

    def merged(fresh: DataFrame, old: DataFrame | None) -> DataFrame:
        source, names = sync.SOURCE, list(dict.fromkeys([*sync.SOURCE, *key]))
        last = fresh.select(*source, F.col("source_version").alias("now"))
        if old is None:
            last = last.groupBy(*source).agg(F.max("now").alias("now"))
            return sync.embed(fresh.join(last, source).where("source_version = now").drop("now"), embedder)
        last = last.unionByName(old.select(*source, F.col("source_version").alias("now"))).groupBy(*source).agg(F.max("now").alias("now"))
        fresh = fresh.join(last, source).where("source_version = now").drop("now")
        stays = old.join(last, source).where("source_version = now").drop("now").join(fresh.select(*names), names, "left_anti")
        known = fresh.join(old.select(*names, F.col("content_hash").alias("old_hash"), F.col("vector").alias("old_vector")), names, "left")
        same = F.coalesce(F.col("old_hash") == F.col("content_hash"), F.lit(False)) & F.col("old_vector").isNotNull()
        reused = known.where(same).withColumn("vector", F.col("old_vector")).drop("old_hash", "old_vector")
        embedded = sync.embed(known.where(~same).drop("old_hash", "old_vector"), embedder)
        return stays.unionByName(reused).unionByName(embedded)

    writer = changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def current_store(spark, store: str) -> DataFrame | None:
    """The store after the last commit; None if there is none."""
    return versions.read(spark, store)
