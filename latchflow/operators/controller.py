"""The whole controller as one job: from frames and raw detector results to decisions, log lines and sinks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latchflow.operators import thinning
from latchflow.operators.detect import above_conf, explode_results, label_of
from latchflow.operators.gate import candidates, gate
from latchflow.operators.policy import with_policy
from latchflow.operators.render import decision_lines, fps_line
from latchflow.operators.slices import measure
from latchflow.schema import BLOCK_LOG_S, FPS_LOG_S, GLOBAL_CONF, MAX_FPS, MIN_INTER_S, SESSION_KEY
from latchflow.sources.settings import Settings
from latchflow.sources.sinks import log_lines, write_run

LINE = ("trap_id", "frame_id", "det_idx", "t_us", "level", "line")


@dataclass(frozen=True)
class Controls:
    """Settings of a run, as the controller's flags have them."""

    conf: float = GLOBAL_CONF
    max_fps: float = MAX_FPS
    every_n: int = 1
    min_inter_s: float = MIN_INTER_S
    block_log_s: float = BLOCK_LOG_S
    fps_log_s: float = FPS_LOG_S
    quiet: bool = True
    session_key: str = SESSION_KEY


@dataclass(frozen=True)
class Outcome:
    """``judged`` holds every candidate with its verdict, ``lines`` the log at all levels."""

    judged: DataFrame
    lines: DataFrame

    def fired(self) -> DataFrame:
        return self.judged.where("ok")


def control(
    frames: DataFrame, results: DataFrame, settings: Settings, names: list[str], controls: Controls = Controls()
) -> Outcome:
    """Run the loop's steps in order over a fleet.

    Frames (trap_id, frame_id, t_us, width, height, dt_us) pass the rate cap, and every n-th of those is looked at.
    Its results are unpacked, filtered, named, given their policies and judged. Blocks are logged at
    most once per gap and trap, frame rates of all frames within the cap at their interval.
    """
    layout = measure(frames)
    capped = thinning.fps_cap(frames, layout, controls.max_fps)
    looked = thinning.every_nth(capped, controls.every_n, layout).select("trap_id", "frame_id", "width", "height")
    boxes = above_conf(explode_results(results), controls.conf).withColumn("label", label_of(F.col("class_id"), names))
    # a frame has few boxes, so this join has no hot keys though a trap may
    seen = boxes.join(looked, ["trap_id", "frame_id"]).withColumns(
        {"force": F.lit(False), "session_key": F.lit(controls.session_key)}
    )
    entering = candidates(with_policy(seen, settings, controls.conf))
    kept = (
        "trap_id", "frame_id", "det_idx", "t_us", "session_key", "label", "conf", "x1", "y1", "x2", "y2", "width", "height",
        "cooldown_key", "open_us", "cooldown_us", "force",
    )
    judged = gate(entering.select(*kept), layout, controls.min_inter_s)
    lines = decision_lines(judged.where("ok"))
    blocks = decision_lines(thinning.block_log(judged.where("NOT ok"), layout, controls.block_log_s))
    rates = thinning.fps_report(capped.select("trap_id", "frame_id", "t_us", "dt_us"), layout, controls.fps_log_s).select(
        "trap_id", "frame_id", F.lit(None).cast("long").alias("det_idx"), "t_us", F.lit("debug").alias("level"),
        fps_line(F.col("fps_now")).alias("line"),
    )
    return Outcome(judged, lines.select(*LINE).unionByName(blocks.select(*LINE)).unionByName(rates))


def store(outcome: Outcome, path: str, run_id: str, controls: Controls = Controls(), encoded=None) -> None:
    """Write a run's events, photos, counts and log; a run that is written again replaces itself."""
    write_run(outcome.fired(), path, run_id, encoded)
    lines = log_lines(outcome.lines, controls.quiet)
    lines.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "run_id"
    ).parquet(f"{path}/log")
