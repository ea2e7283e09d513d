"""Trigger events, photo manifests, counters and log lines as tables and text."""

from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latchflow.functions.boxes import crop
from latchflow.functions.numbers import to_seconds
from latchflow.operators.metrics import species_counts

EVENT_KEYS = ("trap_id", "frame_id", "det_idx")


def trigger_events(fired: DataFrame) -> DataFrame:
    """Event rows of fired detections, as the event log stores them."""
    return fired.select(
        *EVENT_KEYS,
        "session_key",
        F.timestamp_micros("t_us").alias("ts"),
        F.to_date(F.timestamp_micros("t_us")).alias("event_date"),
        F.lit("servo_trigger").alias("event_type"),
        F.col("label").alias("species"),
        F.struct(
            F.col("conf"),
            to_seconds(F.col("cooldown_us")).alias("cooldown"),
            to_seconds(F.col("open_us")).alias("open_dur"),
        ).alias("info"),
    )


def photo_manifest(fired: DataFrame, encoded=None) -> DataFrame:
    """Crop manifest of fired detections whose image could be encoded."""
    rows = fired if encoded is None else fired.where(encoded)
    box = crop(*(F.col(c) for c in ("x1", "y1", "x2", "y2", "width", "height")))
    return rows.select(
        *EVENT_KEYS, "session_key", "t_us", F.col("label").alias("species"), box.alias("_crop")
    ).select("*", "_crop.*").drop("_crop")


def append_events(events: DataFrame, path: str) -> None:
    """Append to the event table, one folder per session and day.

    The rebalance gathers small pieces and lets AQE split a session that holds many rows over
    several tasks and files.
    """
    rows = events.hint("rebalance", "session_key", "event_date")
    rows.write.mode("append").partitionBy("session_key", "event_date").parquet(path)


def write_run(fired: DataFrame, path: str, run_id: str, encoded=None) -> None:
    """Event, photo and counter tables of one run, each with a folder per run and session.

    Only triggers whose image could be encoded are kept, in all three tables alike. A run
    that is written again replaces what it wrote before, whatever it held.
    """
    kept = fired if encoded is None else fired.where(encoded)
    tables = {
        "events": (trigger_events(kept), ["session_key", "event_date"]),
        "photos": (photo_manifest(kept), ["session_key"]),
        "counts": (species_counts(kept), ["session_key"]),
    }
    for name, (rows, partitions) in tables.items():
        folder = f"{path}/{name}/run_id={quote(run_id, safe='')}"
        rows.hint("rebalance", *partitions).write.mode("overwrite").partitionBy(*partitions).parquet(folder)


def read_run_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Rows of all runs of a table, with run_id and session_key as texts."""
    rows = spark.read.option("basePath", f"{path}/{name}").parquet(f"{path}/{name}")
    return rows.withColumns({c: F.col(c).cast("string") for c in ("run_id", "session_key")})


def log_lines(lines: DataFrame, quiet: bool) -> DataFrame:
    """Key lines always; debug lines only when not quiet."""
    levels = ["key"] if quiet else ["key", "debug"]
    return lines.where(F.col("level").isin(levels))


def write_log(lines: DataFrame, path: str, quiet: bool = True) -> None:
    log_lines(lines, quiet).select("line").write.mode("append").text(path)
