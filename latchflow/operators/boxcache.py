"""Boxes kept on screen: the last non-empty detection set of a trap, for a limited time."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latchflow.functions.boxes import annotation
from latchflow.operators.slices import Layout
from latchflow.operators.timeline import last_before
from latchflow.schema import BOX_TTL_S, micros

BOX = ("det_idx", "label", "conf", "x1", "y1", "x2", "y2")


def cached_boxes(
    frames: DataFrame, boxes: DataFrame, layout: Layout, ttl_s: float = BOX_TTL_S
) -> DataFrame:
    """Boxes of the latest strictly earlier non-empty set, per frame, up to ``ttl_s`` old inclusive.

    Frames and sets share one time line, on which a set travels with its boxes as one array, so that
    nothing is read or joined a second time.
    """
    payload = [c for c in boxes.columns if c not in ("trap_id", "frame_id", "t_us")]
    sets = boxes.groupBy("trap_id", "frame_id").agg(
        F.min("t_us").alias("t_us"), F.collect_list(F.struct(*payload)).alias("_boxes")
    )
    # At equal times a frame comes before a set, so it does not see it.
    marks = frames.select("trap_id", "t_us", "frame_id", F.lit(0).alias("kind")).unionByName(
        sets.select("trap_id", "t_us", "frame_id", F.lit(1).alias("kind"), "_boxes"), allowMissingColumns=True
    )
    kept = F.struct(F.col("t_us").alias("set_t_us"), F.col("frame_id").alias("set_frame_id"), F.col("_boxes").alias("boxes"))
    found = last_before(
        marks,
        ["trap_id"],
        ["t_us", "kind", "frame_id"],
        {"latest": F.when(F.col("kind") == 1, kept)},
        layout,
    )
    return found.where(
        (F.col("kind") == 0) & (F.col("t_us") - F.col("latest.set_t_us") <= micros(ttl_s))
    ).select(
        "trap_id", "latest.set_frame_id", "frame_id", "t_us", "latest.set_t_us", F.explode("latest.boxes").alias("_b")
    ).select("trap_id", "set_frame_id", "frame_id", "t_us", "set_t_us", "_b.*")


def overlay(
    frames: DataFrame, boxes: DataFrame, layout: Layout, ttl_s: float = BOX_TTL_S
) -> DataFrame:
    """All boxes drawn on a frame, as a bag: the cached set and the frame's own."""
    columns = ["trap_id", "frame_id", "t_us", *BOX]
    cached = cached_boxes(frames, boxes, layout, ttl_s).select(
        *columns, F.lit("cached").alias("source")
    )
    return cached.unionByName(boxes.select(*columns, F.lit("current").alias("source")))


def annotated(boxes: DataFrame, moved: Column) -> DataFrame:
    """Caption, colour and anchor of every box."""
    drawn = annotation(F.col("label"), F.col("conf"), moved, F.col("x1"), F.col("y1"))
    return boxes.withColumn("_drawn", drawn).select("*", "_drawn.*").drop("_drawn")
