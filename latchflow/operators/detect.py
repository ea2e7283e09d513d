"""From raw detector results to labelled detections, and batch inference."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latchflow.schema import GLOBAL_CONF

CORNERS = ("x1", "y1", "x2", "y2")


def explode_results(results: DataFrame) -> DataFrame:
    """One row per box of the parallel arrays; frames without boxes give no row.

    Corners are truncated toward zero, as an integer cast does.
    """
    kept = [c for c in results.columns if c not in ("xyxy", "conf", "cls")]
    boxes = results.select(
        *kept, F.posexplode(F.arrays_zip("xyxy", "conf", "cls")).alias("det_idx", "_box")
    )
    return boxes.select(
        *kept,
        F.col("det_idx").cast("long").alias("det_idx"),
        F.col("_box.cls").alias("class_id"),
        F.col("_box.conf").alias("conf"),
        *(F.col("_box.xyxy")[i].cast("int").alias(c) for i, c in enumerate(CORNERS)),
    )


def above_conf(rows: DataFrame, conf: float = GLOBAL_CONF) -> DataFrame:
    """Global confidence filter; reaches the scan as a pushed filter."""
    return rows.where(F.col("conf") >= conf)


def class_names(spark, names: list[str]) -> DataFrame:
    """Class-name dimension: the position in the model's list is the class id."""
    one = spark.range(1).select(F.posexplode(F.array(*map(F.lit, names))).alias("class_id", "label"))
    return one


def label_of(class_id: Column, names: list[str]) -> Column:
    """Label of a class id; ids outside the list become ``class_<id>``."""
    missing = F.concat(F.lit("class_"), class_id.cast("string"))
    if not names:
        return missing
    known = F.array(*map(F.lit, names))
    inside = (class_id >= 0) & (class_id < len(names))
    return F.when(inside, F.get(known, class_id)).otherwise(missing)


def with_labels(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Join the class-name dimension; unknown ids become ``class_<id>``.

    The dimension has one row per model class and is small by nature; it is left to Spark's own
    size check whether it is broadcast.
    """
    joined = rows.join(names, "class_id", "left")
    missing = F.concat(F.lit("class_"), F.col("class_id").cast("string"))
    return joined.select(*rows.columns, F.coalesce("label", missing).alias("label"))


Detector = Callable[[pd.DataFrame], pd.DataFrame]


def infer(frames: DataFrame, load: Callable[[], Detector], keep: list[str]) -> DataFrame:
    """Run a detector over frames, in Arrow batches.

    ``load`` is called once per task and returns a function from a batch of frames to a table
    with one ``xyxy``, ``conf`` and ``cls`` array per frame, in the order of its input.
    """
    fields = [frames.schema[c] for c in keep]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        detect = load()
        for batch in batches:
            found = detect(batch)[["xyxy", "conf", "cls"]].reset_index(drop=True)
            yield pd.concat([batch[keep].reset_index(drop=True), found], axis=1)

    return frames.mapInPandas(
        run, f"{schema}, xyxy array<array<double>>, conf array<double>, cls array<int>"
    )
