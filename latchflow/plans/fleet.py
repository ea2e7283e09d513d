"""Views of the star-schema test tables as trap data.

``events`` serves twice: as a fleet of traps with one detection per event (trap = user), and as a
few busy cameras with a frame per event and up to three boxes per frame (trap = user modulo 16).
Durations are scaled to hours, because a user has an event about every ten hours.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from latchflow.functions.numbers import t_us
from latchflow.operators.detect import explode_results, label_of
from latchflow.operators.gate import candidates, gate
from latchflow.operators.policy import with_policy
from latchflow.operators.slices import Layout, measure
from latchflow.plans.session import prepare
from latchflow.sources.settings import Settings, settings_from_text

HOUR_S = 3600.0
MIN_INTER_S = 1.5 * HOUR_S
BLOCK_LOG_S = 1.5 * HOUR_S
BOX_TTL_S = 2.0 * HOUR_S
GLOBAL_CONF = 0.1
CAMERAS = 16
WIDTH, HEIGHT = 640, 480
SNAPSHOT_US = 1_705_276_800_000_000
NAMES = ["click", "error", "purchase", "signup", "view"]

# label: open hours, cooldown hours, confidence
POLICIES = {
    "click": (1.2, 10.0, 0.5),
    "purchase": (2.0, 30.0, 0.2),
    "error": (0.0, 8.0, 0.1),
    "view": (1.5, 8.0, 0.45),
    "signup": (1.0, 20.0, 0.0),
}

EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)

# Policies used by the cascade queries, with and without the catch-all key.
CASCADE = {
    "_default": {"open_duration": 1.75, "cooldown_duration": 9, "confidence_threshold": 0.4},
    "bird": {"open_duration": 2.25, "cooldown_duration": 11, "confidence_threshold": 0.55},
    "squirrel": {"open_duration": 0.0},
    "click": {},
    "Purchase": {"open_duration": 2.5},
    "view-fast-mover": {"cooldown_duration": 12.5, "confidence_threshold": 0.25},
    "signup": 5,
}
CATCH_ALL = {"critter": {"open_duration": 0.75, "cooldown_duration": 4}}


def fleet_settings_text() -> str:
    return json.dumps(
        {
            label: {
                "open_duration": round(hold * HOUR_S, 6),
                "cooldown_duration": round(cooldown * HOUR_S, 6),
                "confidence_threshold": conf,
            }
            for label, (hold, cooldown, conf) in POLICIES.items()
        }
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return spark.read.schema(EVENTS).parquet(f"{sf_dir}/events.parquet")


def k_of(props: Column) -> Column:
    return F.get_json_object(props, "$.k").cast("int")


def _box(x_step: int, y_step: int) -> dict[str, Column]:
    e = F.col("event_id")
    x1 = (e * x_step) % 700 - 30
    y1 = (e * y_step) % 520 - 20
    return {
        "x1": x1.cast("int"),
        "y1": y1.cast("int"),
        "x2": (x1 + 20 + (e * 17) % 200).cast("int"),
        "y2": (y1 + 20 + (e * 29) % 160).cast("int"),
    }


def fleet_of(rows: DataFrame) -> DataFrame:
    """One detection per event row; works on batch and streaming reads alike."""
    return rows.select(
        F.col("user_id").alias("trap_id"),
        F.concat(F.lit("session_"), (F.col("user_id") % 4).cast("string")).alias("session_key"),
        F.col("event_id").alias("frame_id"),
        F.col("ts").cast("timestamp").alias("frame_ts"),
        t_us(F.col("ts")).alias("t_us"),
        F.col("event_id").alias("det_idx"),
        F.col("event_type").alias("label"),
        F.least(F.lit(1.0), F.col("value") / 100.0).alias("conf"),
        *(c.alias(n) for n, c in _box(37, 53).items()),
        F.lit(WIDTH).alias("width"),
        F.lit(HEIGHT).alias("height"),
        k_of(F.col("props")).alias("k"),
        F.lit(False).alias("force"),
    )


def fleet(spark: SparkSession, sf_dir: str, forced: bool = False) -> DataFrame:
    rows = fleet_of(events(spark, sf_dir))
    return rows.withColumn("force", F.col("k") == 7) if forced else rows


def fleet_settings(spark: SparkSession) -> Settings:
    return settings_from_text(spark, fleet_settings_text(), GLOBAL_CONF)


def resolved(spark: SparkSession, rows: DataFrame) -> DataFrame:
    return with_policy(rows, fleet_settings(spark), GLOBAL_CONF)


GATE_COLUMNS = ("trap_id", "frame_id", "det_idx", "t_us", "cooldown_key", "open_us", "cooldown_us", "force")


def judged(
    spark: SparkSession, sf_dir: str, forced: bool = False, keep: tuple[str, ...] = ()
) -> tuple[DataFrame, Layout]:
    """Gate verdicts of the fleet's candidates, and the layout of its traps.

    Nothing can be pruned through the gate, so only the columns wanted behind it enter it.
    """
    rows = fleet(spark, sf_dir, forced)
    layout = measure(rows)
    entering = candidates(resolved(spark, rows)).select(*GATE_COLUMNS, *keep)
    return gate(entering, layout, MIN_INTER_S), layout


def messy_label() -> Column:
    """Labels as people and models write them, chosen by the event's ``k``."""
    name, k = F.col("event_type"), k_of(F.col("props"))
    return (
        F.when(k < 20, name)
        .when(k < 35, F.concat(F.lit("\t  "), F.upper(name), F.lit("  ")))
        .when(k < 50, F.concat(name, F.lit(" Fast-Mover")))
        .when(k < 60, F.lit("Blue-Bird"))
        .when(k < 70, F.lit("grey squirrel"))
        .when(k < 78, F.initcap(name))
        .when(k < 84, F.lit("   "))
        .when(k < 92, F.lit(""))
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Camera frames, without those that failed to read."""
    return frames_of(events(spark, sf_dir)).where("ok")


def frames_of(rows: DataFrame) -> DataFrame:
    k = k_of(F.col("props"))
    return rows.select(
        (F.col("user_id") % CAMERAS).alias("trap_id"),
        F.col("event_id").alias("frame_id"),
        F.col("ts").cast("timestamp").alias("frame_ts"),
        t_us(F.col("ts")).alias("t_us"),
        (k < 97).alias("ok"),
        F.lit(WIDTH).alias("width"),
        F.lit(HEIGHT).alias("height"),
        F.when(k < 5, F.lit(0).cast("long"))
        .otherwise(1000 + (F.col("event_id") * 7919) % 90000)
        .alias("dt_us"),
    )


def results_of(rows: DataFrame) -> DataFrame:
    """Raw detector results of the frames: parallel arrays of up to three boxes."""
    e = F.col("event_id")
    k = k_of(F.col("props"))
    none = F.array().cast("array<int>")
    seq = F.when(k % 4 == 0, none).otherwise(F.sequence(F.lit(0), k % 4 - 1))

    def box(i: Column) -> Column:
        x1 = ((e * 37 + i * 101) % 700 - 30).cast("double") + (e % 10) / 10.0
        y1 = ((e * 53 + i * 71) % 520 - 20).cast("double") + (e % 7) / 8.0
        return F.array(x1, y1, x1 + 20 + (e * 17 + i) % 200, y1 + 20 + (e * 29 + i) % 160)

    return rows.where(k < 97).select(
        (F.col("user_id") % CAMERAS).alias("trap_id"),
        e.alias("frame_id"),
        t_us(F.col("ts")).alias("t_us"),
        F.transform(seq, box).alias("xyxy"),
        F.transform(seq, lambda i: ((e * 31 + i * 17) % 100) / 100.0).alias("conf"),
        F.transform(seq, lambda i: ((e + i * 3) % 7 - 1).cast("int")).alias("cls"),
    )


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results_of(events(spark, sf_dir))


def camera_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled boxes of the cameras."""
    rows = explode_results(results(spark, sf_dir))
    return rows.withColumn("label", label_of(F.col("class_id"), NAMES))


def day_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crowded images: a camera's events of one day as the boxes of one image."""
    e = F.col("event_id")
    x1, y1 = (e * 37) % 60, (e * 53) % 50
    return events(spark, sf_dir).select(
        (F.col("user_id") % CAMERAS).alias("trap_id"),
        F.unix_date(F.to_date("ts")).cast("long").alias("frame_id"),
        e.alias("det_idx"),
        (F.position(F.substring("event_type", 1, 1), F.lit("cepsv")) - 1).alias("class_id"),
        (((e * 31) % 1000) / 1000.0).alias("conf"),
        x1.cast("int").alias("x1"),
        y1.cast("int").alias("y1"),
        (x1 + 40 + (e * 17) % 30).cast("int").alias("x2"),
        F.when(k_of(F.col("props")) == 3, y1).otherwise(y1 + 40 + (e * 29) % 25).cast("int").alias("y2"),
    )


def settings_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One settings text per event, good and broken."""
    name, k = F.col("event_type"), k_of(F.col("props"))
    full = F.format_string(
        '{"_default": {"open_duration": 1.75, "cooldown_duration": 9, "confidence_threshold": 0.4}, '
        '"%s": {"open_duration": %s, "cooldown_duration": %d}}',
        name, (k / 4.0).cast("string"), k,
    )
    text = (
        F.when(k < 50, full)
        .when(k < 60, F.lit('{"_default": '))
        .when(k < 70, F.lit("[1, 2]"))
        .when(k < 80, F.format_string('{"%s": {}, "x": 5}', name))
        .when(k < 90, F.format_string('{"%s": {"open_duration": null}, "y": null}', name))
        .when(k < 92, F.format_string("{\"%s\": {'open_duration': 1}}", name))
        .when(k < 94, F.format_string('{"%s": {}} {"x": {}}', name))
        .when(k < 96, F.format_string('{"%s": {"open_duration": "null", "cooldown_duration": "4.5"}}', name))
        .otherwise(F.lit("{}"))
    )
    return events(spark, sf_dir).select(F.col("event_id").alias("doc_id"), text.alias("settings_text"))


def trap_log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trigger log lines of the fleet, with some noise between them."""
    k = k_of(F.col("props"))
    stamp = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss")
    line = F.concat(
        F.lit("["), stamp, F.lit("] Trap triggered by '"), F.col("event_type"), F.lit("'. Open for "),
        (1 + k % 3).cast("string"), F.lit("s, cooldown "), (k * 600).cast("string"), F.lit("s."),
    )
    return events(spark, sf_dir).select(
        F.col("user_id").alias("trap_id"),
        F.col("event_id").alias("line_id"),
        F.when(k < 90, line).otherwise(F.concat(F.lit("noise "), F.col("event_type"))).alias("value"),
    )


def console_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Console lines of every form, chosen by the event's ``k``."""
    e, k, name = F.col("event_id"), k_of(F.col("props")), F.col("event_type")
    label = F.when(k % 2 == 0, name).otherwise(F.concat(F.lit("big "), name))
    forms = [
        (20, "[TRIG] %s conf=0.%d open=%d.5s cd=%d.0s", (label, k + 10, k % 4, k)),
        (35, "[BLOCK] %s species_cd %d.25s", (label, k)),
        (50, "[BLOCK] %s busy %d.75s", (label, k)),
        (55, "[BLOCK] %s hold", (label,)),
        (70, "[PHOTO] %s bbox=(%d,%d,%d,%d)", (label, e % 50 - 25, e % 40, e % 50 + 60, e % 40 + 70)),
        (80, "[FPS] avg=%d.5", (k,)),
        (85, "[FPS] no frames yet", ()),
        (90, "[Start] model=a b.pt cam=640x480@MJPG conf=0.45 imgsz=%d", (k * 4,)),
        (95, "[Firebase] log_event failed: code %d", (k,)),
    ]
    line = F.concat(F.lit("[OTHER] "), name)
    for below, text, args in reversed(forms):
        line = F.when(k < below, F.format_string(text, *args) if args else F.lit(text)).otherwise(line)
    return events(spark, sf_dir).select(e.alias("line_id"), line.alias("value"))
