"""Streaming queries over the test tables: run over what is available, read back from tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latchflow.operators.detect import infer
from latchflow.operators.gate import candidates
from latchflow.plans import fleet
from latchflow.plans.session import fresh_dir, prepare_streaming
from latchflow.sources.feeds import BATCH_BYTES
from latchflow.streaming import autoclose, boxcache, door, gate, sinks


#: Far later than any row: a beat at this time lets all rows out.
END_OF_TIME = "2262-01-01 00:00:00"


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare_streaming(spark)
    # a pattern stands for a file and for a folder of files alike
    source = spark.readStream.schema(fleet.EVENTS).option("maxBytesPerTrigger", BATCH_BYTES)
    return source.parquet(f"{sf_dir}/events.parque[t]")


class Clock:
    """A feed of beats in the shared folder, empty until told to beat."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path = spark, fresh_dir(spark, "clock")
        spark.createDataFrame([], "frame_ts timestamp").write.parquet(self.path)

    def beats(self) -> DataFrame:
        return self.spark.readStream.schema("frame_ts timestamp").parquet(self.path)

    def beat(self, at: str = END_OF_TIME) -> None:
        row = self.spark.range(1, numPartitions=1).select(F.lit(at).cast("timestamp").alias("frame_ts"))
        row.write.mode("append").parquet(self.path)


def run_to_end(clock: Clock, start) -> None:
    """Run a stream over all that is there, then once more after a last beat."""
    start().awaitTermination()
    clock.beat()
    start().awaitTermination()


def _candidates(spark: SparkSession, sf_dir: str, keep: tuple[str, ...] = ()) -> DataFrame:
    return _candidates_of(spark, event_stream(spark, sf_dir), keep)


def _candidates_of(spark: SparkSession, events: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    return candidates(fleet.resolved(spark, fleet.fleet_of(events))).select(*fleet.GATE_COLUMNS, *keep)


def _run_gate(spark: SparkSession, sf_dir: str, keep_passed: bool = False, keep: tuple[str, ...] = ()) -> tuple[str, str]:
    table, checkpoint, clock = fresh_dir(spark, "gate"), fresh_dir(spark, "gate-state"), Clock(spark)
    rows = _candidates(spark, sf_dir, keep)

    def start():
        stream = gate.gate_stream(rows, fleet.MIN_INTER_S, beats=clock.beats(), keep_passed=keep_passed)
        return sinks.write_table(stream, table, checkpoint)

    run_to_end(clock, start)
    return table, checkpoint


def gate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(_run_gate(spark, sf_dir)[0])


#: Rows with this number come in a second file, after all others; what is behind them by more is late.
STRAGGLERS, STRAGGLER_DELAY = 7, "1 day"


def late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate over two files, of which the second has rows of all times."""
    prepare_streaming(spark)
    events, folder, clock = fleet.events(spark, sf_dir), fresh_dir(spark, "files"), Clock(spark)
    behind = fleet.k_of(F.col("props")) == STRAGGLERS
    table, checkpoint = fresh_dir(spark, "gate"), fresh_dir(spark, "gate-state")

    def start():
        source = spark.readStream.schema(fleet.EVENTS).parquet(folder)
        stream = gate.gate_stream(_candidates_of(spark, source), fleet.MIN_INTER_S, STRAGGLER_DELAY, clock.beats())
        return sinks.write_table(stream, table, checkpoint)

    events.where(~behind).write.mode("append").parquet(folder)
    start().awaitTermination()
    events.where(behind).write.mode("append").parquet(folder)
    run_to_end(clock, start)
    return spark.read.parquet(table)


def gate_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deadlines and cooldowns the gate's stream has stored, per trap and species."""
    _, checkpoint = _run_gate(spark, sf_dir, keep_passed=True)
    per_trap = gate.read_deadlines(spark, checkpoint)
    per_species = gate.read_cooldowns(spark, checkpoint)
    return per_species.join(per_trap, "trap_id").select(
        "trap_id", "cooldown_key", "until_us", "busy_until_us", "hold_until_us", "last_us"
    )


def cached_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from latchflow.operators.detect import label_of

    found = fleet.results_of(event_stream(spark, sf_dir))
    at = F.arrays_zip("xyxy", "cls")

    def box(item, index):
        corner = item["xyxy"]
        return F.struct(
            index.cast("long").alias("det_idx"),
            label_of(item["cls"], fleet.NAMES).alias("label"),
            corner[0].cast("int").alias("x1"),
            corner[1].cast("int").alias("y1"),
        )

    frames = found.select("trap_id", "frame_id", "t_us", F.transform(at, box).alias("boxes"))
    table, checkpoint, clock = fresh_dir(spark, "boxes"), fresh_dir(spark, "boxes-state"), Clock(spark)
    run_to_end(clock, lambda: sinks.write_table(
        boxcache.cached_box_stream(frames, fleet.BOX_TTL_S, beats=clock.beats()), table, checkpoint))
    return spark.read.parquet(table).where("NOT late").select(
        "trap_id", "frame_id", "set_frame_id", "set_t_us", "det_idx", "label", "x1", "y1"
    )


def closes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate's table as the source of a second stream with closing timers."""
    table, _ = _run_gate(spark, sf_dir)
    schema = spark.read.parquet(table).schema
    fired = spark.readStream.schema(schema).parquet(table).where("ok")
    timed = fired.withColumn("frame_ts", F.timestamp_micros("t_us"))
    out, checkpoint, clock = fresh_dir(spark, "closes"), fresh_dir(spark, "closes-state"), Clock(spark)
    run_to_end(clock, lambda: sinks.write_table(autoclose.auto_close_stream(timed, beats=clock.beats()), out, checkpoint))
    return spark.read.parquet(out).where("NOT late").select("trap_id", "trigger_us", "hold_until_us")


def open_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames inside holds, joined with the stream of holds that a stream of triggers leaves."""
    table, _ = _run_gate(spark, sf_dir)
    fired = spark.readStream.schema(spark.read.parquet(table).schema).parquet(table).where("ok")
    ended, checkpoint, clock = fresh_dir(spark, "holds"), fresh_dir(spark, "holds-state"), Clock(spark)
    run_to_end(clock, lambda: sinks.write_table(door.hold_stream(fired, beats=clock.beats()), ended, checkpoint))
    holds = spark.readStream.schema(door.OUT).parquet(ended).where("NOT late")
    frames = fleet.fleet_of(event_stream(spark, sf_dir))
    longest = max(hold for hold, _, _ in fleet.POLICIES.values()) * fleet.HOUR_S
    out = fresh_dir(spark, "open-frames")
    sinks.write_table(door.open_frame_stream(frames, holds, longest), out, fresh_dir(spark, "open-state")).awaitTermination()
    return spark.read.parquet(out)


def latest_frames(spark: SparkSession, sf_dir: str, poll_s: float) -> DataFrame:
    frames = fleet.frames_of(event_stream(spark, sf_dir)).where("ok")
    table, checkpoint, clock = fresh_dir(spark, "latest"), fresh_dir(spark, "latest-state"), Clock(spark)
    run_to_end(clock, lambda: sinks.write_table(door.latest_frame_stream(frames, poll_s, beats=clock.beats()), table, checkpoint))
    return spark.read.parquet(table)


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Species counts as the stream's counter sink leaves them."""
    keep = ("session_key", "label", "x1", "y1", "x2", "y2", "width", "height")
    rows, clock = _candidates(spark, sf_dir, keep), Clock(spark)
    photos, totals, checkpoint = fresh_dir(spark, "photos"), fresh_dir(spark, "counts"), fresh_dir(spark, "sinks-state")
    run_to_end(clock, lambda: sinks.write_photos_and_counts(
        gate.gate_stream(rows, fleet.MIN_INTER_S, beats=clock.beats()), photos, totals, checkpoint))
    return sinks.read_counts(spark, totals)


def photos_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photo manifests of a feed that is sent twice, in different batches."""
    prepare_streaming(spark)
    keep = ("session_key", "label", "x1", "y1", "x2", "y2", "width", "height")
    fired, folder = fleet.judged(spark, sf_dir, keep=keep)[0].where("ok"), fresh_dir(spark, "fired")
    table, checkpoint = fresh_dir(spark, "photos"), fresh_dir(spark, "photos-state")
    for _ in range(2):
        fired.write.mode("append").parquet(folder)
        # a batch per copy and so many bytes, not per file: files grow with the tasks, and each batch visits the state of all tasks
        source = spark.readStream.schema(spark.read.parquet(folder).schema).option("maxBytesPerTrigger", BATCH_BYTES).parquet(folder)
        # the second copy starts over, a whole month behind
        sinks.write_photos(source, table, checkpoint, "60 days").awaitTermination()
    return spark.read.parquet(table).withColumn("session_key", F.col("session_key").cast("string"))


#: Batches in which a table's files are sent.
BATCHES = 4


def _sent_in_batches(spark: SparkSession, table: str) -> DataFrame:
    """Stream of a table's rows in several batches, whatever the number of its files."""
    rows = spark.read.parquet(table)
    files = -(-len(rows.inputFiles()) // BATCHES)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", max(1, files)).parquet(table)


def counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counter of the gate's table, as a stream of several batches leaves it."""
    table, _ = _run_gate(spark, sf_dir, keep=("session_key", "label"))
    fired = _sent_in_batches(spark, table).where("ok")
    counts = fresh_dir(spark, "counter")
    sinks.write_counter(fired, counts, fresh_dir(spark, "counter-state")).awaitTermination()
    return sinks.read_counter(spark, counts)


def inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of each embedding by nearest class centre, through the detector interface.

    The centres are one row per class, so they are small whatever the number of vectors.
    """
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    centres = (
        vectors.select("label", F.posexplode("embedding").alias("at", "x"))
        .groupBy("label", "at")
        .agg(F.avg(F.col("x").cast("double")).alias("x"))
        .groupBy("label")
        .agg(F.sort_array(F.collect_list(F.struct("at", "x"))).alias("centre"))
    )
    model = {r["label"]: [p["x"] for p in r["centre"]] for r in centres.collect()}

    def load():
        import numpy as np
        import pandas as pd

        labels = np.array(sorted(model))
        matrix = np.array([model[label] for label in labels])

        def detect(batch):
            points = np.stack(batch["embedding"].to_numpy()).astype("float64")
            # Squared distances through the dot product; the point's own norm is the same for all.
            score = (matrix**2).sum(axis=1)[None, :] - 2.0 * points @ matrix.T
            best = score.argmin(axis=1)
            return pd.DataFrame(
                {
                    "xyxy": [[[0.0, 0.0, 1.0, 1.0]]] * len(batch),
                    "conf": [[1.0]] * len(batch),
                    "cls": [[int(labels[b])] for b in best],
                }
            )

        return detect

    found = infer(vectors.select("vec_id", "embedding"), load, ["vec_id", "embedding"]).drop("embedding")
    return found.select(
        "vec_id", F.col("cls")[0].alias("class_id"), F.size("conf").alias("n_boxes")
    )
