"""Counts, summaries, rolling frame rate, state snapshots and compliance reports."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latchflow.functions.numbers import whole_div
from latchflow.operators.slices import Layout, slice_limit
from latchflow.operators.timeline import last_before, numbered
from latchflow.schema import DETECTION_ORDER, FPS_SAMPLES, FRAME_ORDER, MIN_INTER_S, micros


def species_counts(fired: DataFrame) -> DataFrame:
    """Triggers per session and label as written, not its slug."""
    return fired.groupBy("session_key", F.col("label").alias("species")).agg(
        F.count(F.lit(1)).alias("n")
    )


def decision_summary(decided: DataFrame) -> DataFrame:
    """Decisions per trap and species, and in total per decision (trap and species NULL)."""
    left = F.col("species_left_us") + F.col("busy_left_us")
    return (
        decided.groupingSets(
            [["trap_id", "cooldown_key", "decision"], ["decision"]],
            "trap_id", "cooldown_key", "decision",
        )
        .agg(F.count(F.lit(1)).alias("n"), F.sum(left).alias("left_us"))
    )


def rolling_fps(frames: DataFrame, layout: Layout, samples: int = FPS_SAMPLES) -> DataFrame:
    """Mean of the last ``samples`` rates ``1/dt`` at each frame that has one.

    For hot traps the running number cuts the line into blocks of equal size; each block also
    gets copies of the ``samples - 1`` rows before it, so no frame misses its history.
    """
    timed = frames.where("dt_us > 0").withColumn("fps", F.lit(1_000_000.0) / F.col("dt_us"))
    back = samples - 1
    if not layout.hot:
        w = Window.partitionBy("trap_id").orderBy(*FRAME_ORDER).rowsBetween(-back, 0)
        return timed.withColumn("fps_avg", F.avg("fps").over(w))
    size = max(slice_limit(frames.sparkSession, 0), 2 * samples)
    row = numbered(timed, ["trap_id"], FRAME_ORDER, "_rn", layout).withColumn("_rn", F.col("_rn") - 1)
    block = whole_div(F.col("_rn"), F.lit(size).cast("long"))
    into_next = F.col("_rn") % size >= size - back
    copies = F.when(into_next, F.array(block, block + 1)).otherwise(F.array(block))
    spread = row.withColumn("_block", F.explode(copies))
    w = Window.partitionBy("trap_id", "_block").orderBy("_rn").rowsBetween(-back, 0)
    averaged = spread.withColumn("fps_avg", F.avg("fps").over(w))
    return averaged.where(F.col("_block") == block).drop("_block", "_rn")


def latest_frames(frames: DataFrame, poll_us: int) -> DataFrame:
    """Only the newest frame of each poll; the rest of the backlog is dropped."""
    newest = F.max(F.struct("t_us", "frame_id"))
    return (
        frames.groupBy("trap_id", whole_div(F.col("t_us"), F.lit(poll_us)).alias("poll"))
        .agg(newest.alias("_f"))
        .select("trap_id", "poll", "_f.frame_id", "_f.t_us")
    )


def state_at(fired: DataFrame, at_us: int) -> DataFrame:
    """State at a point in time: one row per trap (species NULL) and one per trap and species.

    The latest trigger decides, not the largest deadline: a forced one may bring it forward.
    Expired times stay, as 0.
    """
    latest = F.max(
        F.struct(*DETECTION_ORDER, "hold_until_us", "busy_until_us", "cooldown_until_us")
    )
    found = (
        fired.where(F.col("t_us") <= at_us)
        .groupingSets([["trap_id", "cooldown_key"], ["trap_id"]], "trap_id", "cooldown_key")
        .agg(latest.alias("_s"))
    )

    def left(until: str):
        return F.greatest(F.lit(0).cast("long"), F.col(f"_s.{until}") - at_us)

    whole = F.col("cooldown_key").isNull()
    return found.select(
        "trap_id",
        "cooldown_key",
        F.when(whole, left("hold_until_us")).alias("hold_left_us"),
        F.when(whole, left("busy_until_us")).alias("busy_left_us"),
        F.when(~whole, left("cooldown_until_us")).alias("cooldown_left_us"),
    )


def label_gaps(log: DataFrame, layout: Layout, order: Sequence[str], keys: Sequence[str] = ("label",)) -> DataFrame:
    """Per label of a trigger log: rows, and the shortest and longest gap to the label's last one."""
    seen = last_before(log, keys, order, {"_before": F.col("t_us")}, layout)
    gap = F.col("t_us") - F.col("_before")
    return seen.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min(gap).alias("min_gap_us"), F.max(gap).alias("max_gap_us")
    )


def compliance(
    fired: DataFrame,
    layout: Layout,
    order: Sequence[str] = DETECTION_ORDER,
    species: str = "cooldown_key",
    min_inter_s: float = MIN_INTER_S,
) -> DataFrame:
    """Gap of each trigger to the last one of its species and of its trap, against their windows."""
    prior = F.struct("t_us", "open_us", "cooldown_us")
    by_trap = last_before(fired, ["trap_id"], order, {"_any": prior}, layout)
    both = last_before(by_trap, ["trap_id", species], order, {"_same": prior}, layout)
    gap_any = F.col("t_us") - F.col("_any.t_us")
    gap_same = F.col("t_us") - F.col("_same.t_us")
    no = F.lit(False)
    return both.select(
        *fired.columns,
        gap_same.alias("species_gap_us"),
        gap_any.alias("trap_gap_us"),
        F.coalesce(gap_same < F.col("_same.cooldown_us"), no).alias("cooldown_violation"),
        F.coalesce(gap_any < F.col("_any.open_us") + micros(min_inter_s), no).alias("busy_violation"),
    )
