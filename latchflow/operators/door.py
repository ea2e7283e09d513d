"""Door state over time: open frames, automatic closing, intervals, and what blocks a detection."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latchflow.operators.gate import BUSY, COOLING
from latchflow.operators.slices import Layout
from latchflow.operators.timeline import first_after, last_before
from latchflow.schema import DETECTION_ORDER

MARK_ORDER = ["t_us", "kind", "frame_id", "det_idx"]


def open_frames(frames: DataFrame, triggers: DataFrame, layout: Layout) -> DataFrame:
    """Frames inside the hold of the latest trigger: from its own time until before its end."""
    hold = F.struct(
        F.col("t_us").alias("trigger_us"),
        F.col("frame_id").alias("trigger_frame_id"),
        F.col("hold_until_us"),
    )
    marks = triggers.select(
        "trap_id", "t_us", "frame_id", "det_idx", F.lit(0).alias("kind"), hold.alias("hold")
    ).unionByName(
        frames.select("trap_id", "t_us", "frame_id", F.lit(1).alias("kind")), allowMissingColumns=True
    )
    found = last_before(
        marks, ["trap_id"], MARK_ORDER, {"latest": F.col("hold")}, layout
    )
    return found.where((F.col("kind") == 1) & (F.col("t_us") < F.col("latest.hold_until_us"))).select(
        "trap_id", "frame_id", "t_us", "latest.trigger_us", "latest.trigger_frame_id",
        "latest.hold_until_us",
    )


def unsuperseded(triggers: DataFrame, layout: Layout) -> DataFrame:
    """Triggers whose hold runs out before another trigger moves its end (only forced ones do)."""
    following = first_after(
        triggers, ["trap_id"], DETECTION_ORDER, {"next_us": F.col("t_us")}, layout
    )
    stands = F.col("next_us").isNull() | (F.col("next_us") >= F.col("hold_until_us"))
    return following.where(stands).drop("next_us")


def auto_close(frames: DataFrame, triggers: DataFrame, layout: Layout) -> DataFrame:
    """First frame at or after the end of each hold: the frame at which the door really closes."""
    ends = unsuperseded(triggers, layout).select(
        "trap_id",
        F.col("hold_until_us").alias("t_us"),
        "frame_id",
        "det_idx",
        F.lit(0).alias("kind"),
        F.col("t_us").alias("trigger_us"),
    )
    marks = ends.unionByName(
        frames.select("trap_id", "t_us", "frame_id", F.lit(1).alias("kind")), allowMissingColumns=True
    )
    at = F.struct(F.col("t_us").alias("close_us"), F.col("frame_id").alias("close_frame_id"))
    found = first_after(
        marks, ["trap_id"], MARK_ORDER, {"next": F.when(F.col("kind") == 1, at)}, layout
    )
    return found.where("kind = 0").select(
        "trap_id",
        F.col("frame_id").alias("trigger_frame_id"),
        "det_idx",
        "trigger_us",
        F.col("t_us").alias("hold_until_us"),
        "next.close_us",
        "next.close_frame_id",
    )


def timeline(
    frames: DataFrame, triggers: DataFrame, commands: DataFrame, layout: Layout
) -> DataFrame:
    """Door events in order, each with the door's state and the time of the next event.

    Manual commands move the door but leave a pending automatic close in place.
    """
    following = first_after(
        triggers, ["trap_id"], DETECTION_ORDER, {"next_us": F.col("t_us")}, layout
    )
    stands = F.col("next_us").isNull() | (F.col("next_us") >= F.col("hold_until_us"))

    def event(name: str, kind: int, at):
        return F.struct(F.lit(name).alias("event"), F.lit(kind).alias("kind"), at.alias("t_us"))

    opened = event("trigger-open", 2, F.col("t_us"))
    closed = F.when(stands, event("auto-close", 1, F.col("hold_until_us")))
    moves = following.select(
        "trap_id", "frame_id", "det_idx", F.explode(F.array(opened, closed)).alias("_e")
    ).where(F.col("_e").isNotNull())
    start = frames.groupBy("trap_id").agg(F.min("t_us").alias("t_us"))
    keys = ["trap_id", "frame_id", "det_idx"]
    events = (
        moves.select(*keys, "_e.event", "_e.kind", "_e.t_us")
        .unionByName(
            start.select("trap_id", "t_us", F.lit("init-closed").alias("event"), F.lit(0).alias("kind")),
            allowMissingColumns=True,
        )
        .unionByName(
            commands.select(
                "trap_id", "t_us", "frame_id", F.col("command").alias("event"), F.lit(3).alias("kind")
            ),
            allowMissingColumns=True,
        )
    )
    ended = first_after(events, ["trap_id"], MARK_ORDER, {"until_us": F.col("t_us")}, layout)
    is_open = F.col("event").isin("trigger-open", "manual-open")
    return ended.select(
        "trap_id",
        F.col("t_us").alias("at_us"),
        "event",
        F.when(is_open, "open").otherwise("closed").alias("door"),
        "until_us",
    )


def blockers(judged: DataFrame, layout: Layout) -> DataFrame:
    """Blocked detections with the trigger that blocks them."""
    fired = F.when(
        F.col("ok"), F.struct(F.col("t_us").alias("t_us"), F.col("frame_id").alias("frame_id"))
    )
    by_trap = last_before(judged, ["trap_id"], DETECTION_ORDER, {"_trap": fired}, layout)
    by_key = last_before(
        by_trap, ["trap_id", "cooldown_key"], DETECTION_ORDER, {"_species": fired}, layout
    )
    cause = F.when(F.col("reason") == BUSY, F.col("_trap")).when(
        F.col("reason") == COOLING, F.col("_species")
    )
    return by_key.where(~F.col("ok")).select(
        "trap_id", "frame_id", "det_idx", "t_us", "cooldown_key", "reason", "species_left_us",
        "busy_left_us", cause["frame_id"].alias("blocker_frame_id"), cause["t_us"].alias("blocker_us"),
    )
