"""Readers for the trigger log and the console log."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Line formats of the two logs.
TRAP_LINE = r"^\[(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d)\] Trap triggered by '(.*)'\. Open for ([0-9.]+)s, cooldown ([0-9.]+)s\.$"
TRIG_LINE = r"^\[TRIG\] (.*) conf=([0-9.]+) open=([0-9.eE+-]+)s cd=([0-9.eE+-]+)s$"
COOLING_LINE = r"^\[BLOCK\] (.*) species_cd ([0-9.]+)s$"
BUSY_LINE = r"^\[BLOCK\] (.*) busy ([0-9.]+)s$"
BLOCK_LINE = r"^\[BLOCK\] (.*) (\S+)$"
PHOTO_LINE = r"^\[PHOTO\] (.*) bbox=\((-?\d+),(-?\d+),(-?\d+),(-?\d+)\)$"
FPS_LINE = r"^\[FPS\] avg=([0-9.]+)$"
FPS_NONE_LINE = r"^\[FPS\] no frames yet$"
START_LINE = r"^\[Start\] (model=.* cam=\d+x\d+@.* conf=[0-9.]+ imgsz=\d+)$"
SINK_LINE = r"^\[Firebase\] (Enabled|(?:init|log_event) failed: .*)$"


def _part(line: Column, pattern: str, group: int, kind: str = "string") -> Column:
    return F.regexp_extract(line, pattern, group).try_cast(kind)


def parse_trap_log(lines: DataFrame, line: str = "value") -> DataFrame:
    """Trigger log lines as columns; ``matched`` is false for lines of any other form.

    The stamps carry no zone and stay zone-less.
    """
    text = F.col(line)
    # One pass takes all parts; the label comes last, so it may hold any character.
    whole = F.regexp_replace(text, TRAP_LINE, "$1\x01$3\x01$4\x01$2")
    parts = F.when(text.rlike(TRAP_LINE), F.split(whole, "\x01", 4))

    def part(at: int) -> Column:
        return F.get("_parts", F.lit(at))

    return (
        lines.withColumn("_parts", parts)
        .withColumns(
            {
                "matched": F.col("_parts").isNotNull(),
                "ts": part(0).try_cast("timestamp_ntz"),
                "label": part(3),
                "open_s": part(1).try_cast("double"),
                "cooldown_s": part(2).try_cast("double"),
            }
        )
        .drop("_parts")
    )


def parse_console_log(lines: DataFrame, line: str = "value") -> DataFrame:
    """Console lines as one wide table; ``tag`` is NULL for lines of unknown form."""
    text = F.col(line)
    forms = [
        ("trig", TRIG_LINE),
        ("cooling", COOLING_LINE),
        ("busy", BUSY_LINE),
        ("block", BLOCK_LINE),
        ("photo", PHOTO_LINE),
        ("fps", FPS_LINE),
        ("fps_none", FPS_NONE_LINE),
        ("start", START_LINE),
        ("sink", SINK_LINE),
    ]
    pattern_of = dict(forms)
    tags = {
        "trig": "TRIG", "cooling": "BLOCK", "busy": "BLOCK", "block": "BLOCK", "photo": "PHOTO",
        "fps": "FPS", "fps_none": "FPS", "start": "Start", "sink": "Firebase",
    }
    # The tag is compared first, so a line meets only the patterns of its own tag.
    form = F.coalesce(
        *(
            F.when(F.startswith(text, F.lit(f"[{tags[name]}]")) & text.rlike(pattern), F.lit(name))
            for name, pattern in forms
        )
    )

    def pick(group_of: dict[str, int], kind: str = "string") -> Column:
        return F.coalesce(
            *(
                F.when(F.col("_form") == name, _part(text, pattern_of[name], group, kind))
                for name, group in group_of.items()
            )
        )

    tag = F.coalesce(*(F.when(F.col("_form") == n, F.lit(t)) for n, t in tags.items()))
    reason = (
        F.when(F.col("_form") == "cooling", "species_cooldown")
        .when(F.col("_form") == "busy", "global_busy")
        .otherwise(pick({"block": 2}))
    )
    message = F.when(F.col("_form") == "fps_none", "no frames yet").otherwise(
        pick({"start": 1, "sink": 1})
    )
    corners = {c: pick({"photo": i}, "int") for i, c in enumerate(("x1", "y1", "x2", "y2"), 2)}
    return (
        lines.withColumn("_form", form)
        .withColumns(
            {
                "tag": tag,
                "label": pick({"trig": 1, "cooling": 1, "busy": 1, "block": 1, "photo": 1}),
                "conf": pick({"trig": 2}, "double"),
                "open_s": pick({"trig": 3}, "double"),
                "cd_s": pick({"trig": 4}, "double"),
                "reason": reason,
                "left_s": pick({"cooling": 2, "busy": 2}, "double"),
                **corners,
                "fps": pick({"fps": 1}, "double"),
                "message": message,
            }
        )
        .drop("_form")
    )


def read_trap_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Parsed trigger log and its rejected lines."""
    rows = parse_trap_log(spark.read.text(path))
    return rows.where("matched").drop("matched"), rows.where("NOT matched").select("value")


def read_console_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Parsed console log and its rejected lines."""
    rows = parse_console_log(spark.read.text(path))
    return rows.where("tag IS NOT NULL"), rows.where("tag IS NULL").select("value")
