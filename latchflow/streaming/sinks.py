"""Stream sinks: file sinks for events and photos, a counter kept by key, and per-batch folders that can be written again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from latchflow.operators.metrics import species_counts
from latchflow.plans.session import folders, remove
from latchflow.sources.sinks import EVENT_KEYS, photo_manifest, trigger_events
from latchflow.streaming.ordered import DELAY


def write_table(
    stream: DataFrame, path: str, checkpoint: str, partitions: tuple[str, ...] = ()
) -> StreamingQuery:
    """Start an exactly-once parquet sink over all data that is available now."""
    writer = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint)
    if partitions:
        writer = writer.partitionBy(*partitions)
    return writer.trigger(availableNow=True).start(path)


def write_trigger_events(judged: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Event table of a judged stream, one folder per session and day."""
    events = trigger_events(judged.where("ok"))
    return write_table(events, path, checkpoint, ("session_key", "event_date"))


def write_photos_and_counts(
    judged: DataFrame, photos: str, counts: str, checkpoint: str, encoded=None
) -> StreamingQuery:
    """Photo manifests and species counts of a judged stream.

    Every micro-batch owns one folder in each table and replaces it as a whole, so a batch that
    is run again after a failure leaves no second copy. Counts are partial per batch.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        fired = batch.where("ok").persist()
        try:
            kept = fired if encoded is None else fired.where(encoded)
            folder = f"batch={batch_id}"
            photo_manifest(kept).write.mode("overwrite").parquet(f"{photos}/{folder}")
            species_counts(kept).write.mode("overwrite").parquet(f"{counts}/{folder}")
        finally:
            fired.unpersist()

    return (
        judged.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_counts(spark, counts: str) -> DataFrame:
    """Total counts over all batches."""
    return spark.read.parquet(counts).groupBy("session_key", "species").agg(F.sum("n").alias("n"))


def write_photos(fired: DataFrame, path: str, checkpoint: str, delay: str = DELAY, encoded=None) -> StreamingQuery:
    """Photo manifests of a stream of triggers, one per (trap_id, frame_id, det_idx), a folder per session.

    A trigger that is sent again, in whatever batch, is dropped as long as the delay has not passed since.
    """
    timed = fired.withColumn("_time", F.timestamp_micros("t_us")).withWatermark("_time", delay)
    single = timed.dropDuplicatesWithinWatermark(list(EVENT_KEYS))
    return write_table(photo_manifest(single, encoded), path, checkpoint, ("session_key",))


def write_counter(fired: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Triggers per session and label of a stream, merged by key into a table with one row per key.

    Every batch sends the counts that changed and writes the next version of the table; a
    version is named by its batch, so a repeated batch replaces its own. Two versions are kept.
    """
    counts = fired.groupBy("session_key", F.col("label").alias("species")).agg(F.count(F.lit(1)).alias("n"))

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        earlier = [v for v in _versions(spark, path) if v < batch_id]
        changed = batch.persist()
        try:
            rows = changed
            if earlier:
                new = changed.select(F.col("session_key").alias("_session"), F.col("species").alias("_species"))
                same = F.col("session_key").eqNullSafe(F.col("_session")) & F.col("species").eqNullSafe(F.col("_species"))
                rows = changed.unionByName(_version(spark, path, earlier[-1]).join(new, same, "left_anti"))
            rows.write.mode("overwrite").parquet(f"{path}/version={batch_id}")
        finally:
            changed.unpersist()
        for version in earlier[:-1]:
            remove(spark, f"{path}/version={version}")

    return (
        counts.writeStream.outputMode("update").foreachBatch(merge)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def _versions(spark, path: str) -> list[int]:
    """Versions that are complete, in order."""
    named = [n.removeprefix("version=") for n in folders(spark, path) if n.startswith("version=")]
    return sorted(int(n) for n in named if "_SUCCESS" in folders(spark, f"{path}/version={n}"))


def _version(spark, path: str, version: int) -> DataFrame:
    return spark.read.schema("session_key string, species string, n long").parquet(f"{path}/version={version}")


def read_counter(spark, path: str) -> DataFrame:
    """The latest complete version."""
    found = _versions(spark, path)
    return _version(spark, path, found[-1]) if found else spark.createDataFrame([], "session_key string, species string, n long")
