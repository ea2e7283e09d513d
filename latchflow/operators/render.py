"""Console lines of decisions, photos and frame rates."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latchflow.functions.numbers import fixed2, shortest, to_seconds
from latchflow.operators.gate import BUSY, COOLING


def start_line(model: Column, width: Column, height: Column, fourcc: Column, conf: Column, size: Column) -> Column:
    text = "[Start] model=%s cam=%dx%d@%s conf=%s imgsz=%d"
    return F.format_string(text, model, width, height, fourcc, shortest(conf), size)


def trigger_line() -> Column:
    return F.concat(
        F.lit("[TRIG] "), F.col("label"), F.lit(" conf="), fixed2(F.col("conf")),
        F.lit(" open="), shortest(to_seconds(F.col("open_us"))), F.lit("s cd="),
        shortest(to_seconds(F.col("cooldown_us"))), F.lit("s"),
    )


def block_line() -> Column:
    def left(name: str) -> Column:
        return fixed2(to_seconds(F.col(name)))

    tail = (
        F.when(F.col("reason") == COOLING, F.concat(F.lit("species_cd "), left("species_left_us"), F.lit("s")))
        .when(F.col("reason") == BUSY, F.concat(F.lit("busy "), left("busy_left_us"), F.lit("s")))
        .otherwise(F.col("reason"))
    )
    return F.concat(F.lit("[BLOCK] "), F.col("label"), F.lit(" "), tail)


def photo_line() -> Column:
    corners = [F.col(c).cast("string") for c in ("x1", "y1", "x2", "y2")]
    return F.concat(
        F.lit("[PHOTO] "), F.col("label"), F.lit(" bbox=("), F.concat_ws(",", *corners), F.lit(")")
    )


def fps_line(fps: Column) -> Column:
    return F.coalesce(
        F.concat(F.lit("[FPS] avg="), fixed2(fps)), F.lit("[FPS] no frames yet")
    )


def sink_error_line(stage: Column, problem: Column) -> Column:
    return F.concat(F.lit("[Firebase] "), stage, F.lit(" failed: "), problem)


def trap_log_line(ts: Column) -> Column:
    """Line of the trigger log; whole seconds lose their decimals."""

    def seconds(name: str) -> Column:
        return F.regexp_replace(shortest(to_seconds(F.col(name))), r"\.0$", "")

    return F.concat(
        F.lit("["), F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit("] Trap triggered by '"),
        F.col("label"), F.lit("'. Open for "), seconds("open_us"), F.lit("s, cooldown "),
        seconds("cooldown_us"), F.lit("s."),
    )


def decision_lines(judged: DataFrame) -> DataFrame:
    """Log lines of judged candidates with their level: triggers, their photos, and blocks.

    Photos and triggers are essential, blocks are listed in full at debug level.
    """
    lines = F.when(
        F.col("ok"),
        F.array(
            F.struct(F.lit("key").alias("level"), trigger_line().alias("line")),
            F.struct(F.lit("key").alias("level"), photo_line().alias("line")),
        ),
    ).otherwise(F.array(F.struct(F.lit("debug").alias("level"), block_line().alias("line"))))
    return judged.select(
        "trap_id", "frame_id", "det_idx", "t_us", F.explode(lines).alias("_l")
    ).select("trap_id", "frame_id", "det_idx", "t_us", "_l.level", "_l.line")
