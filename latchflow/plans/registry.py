"""Every operator as a query over the star-schema test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latchflow.functions.boxes import crop
from latchflow.functions.labels import cooldown_key, label_slug
from latchflow.functions.numbers import t_us
from latchflow.operators import boxcache, controller, detect, door, metrics, policy, render, thinning
from latchflow.operators.gate import candidates, decisions, gate
from latchflow.operators.slices import measure
from latchflow.operators.suppress import suppress
from latchflow.plans import fleet, streams
from latchflow.plans.session import fresh_dir
from latchflow.sources import logs, settings, sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

ID = ("trap_id", "frame_id", "det_idx")
BOX = ("x1", "y1", "x2", "y2")
PHOTO_COLUMNS = ("session_key", "label", "conf", *BOX, "width", "height")


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


def _fired(spark, sf_dir, forced=False, keep=()):
    rows, layout = fleet.judged(spark, sf_dir, forced, keep)
    return rows.where("ok"), layout


# Sources and sinks


@query
def src_detections(spark, sf_dir):
    rows = fleet.fleet(spark, sf_dir).where((F.col("k") < 97) & F.col("frame_ts").isNotNull())
    return rows.select(*ID, "session_key", "t_us", "label", F.round("conf", 6).alias("conf"))


@query
def settings_load(spark, sf_dir):
    rows = settings.parse_settings(fleet.settings_docs(spark, sf_dir))
    return rows.select("doc_id", "key", "from_fallback", "is_object", *settings.FIELDS, "bad_field")


@query
def traplog_parse(spark, sf_dir):
    rows = logs.parse_trap_log(fleet.trap_log_lines(spark, sf_dir))
    return rows.select(
        "trap_id", "line_id", "matched", t_us(F.col("ts")).alias("log_us"), "label", "open_s", "cooldown_s"
    )


@query
def consolelog_parse(spark, sf_dir):
    return logs.parse_console_log(fleet.console_lines(spark, sf_dir)).drop("value")


@query
def sink_trigger_events(spark, sf_dir):
    fired, _ = _fired(spark, sf_dir, keep=("session_key", "label", "conf"))
    path = fresh_dir(spark, "events")
    sinks.append_events(sinks.trigger_events(fired), path)
    stored = spark.read.parquet(path)
    return stored.select(
        *ID,
        "session_key",
        F.col("event_date").cast("string").alias("event_date"),
        t_us(F.col("ts")).alias("t_us"),
        "event_type",
        "species",
        F.round("info.conf", 6).alias("conf"),
        "info.cooldown",
        "info.open_dur",
    )


@query
def sink_run_rewritten(spark, sf_dir):
    """Two runs, of which one is written twice; images of some triggers could not be encoded."""
    fired, _ = _fired(spark, sf_dir, keep=(*PHOTO_COLUMNS, "k"))
    path, encoded = fresh_dir(spark, "runs"), F.col("k") % 10 != 3
    for run_id in ("first", "second=b", "first"):
        sinks.write_run(fired, path, run_id, encoded)
    return sinks.read_run_table(spark, path, "events").select("run_id", *ID, "session_key", t_us(F.col("ts")).alias("t_us"), "species")


@query
def photo_manifest(spark, sf_dir):
    fired, _ = _fired(spark, sf_dir, keep=PHOTO_COLUMNS)
    return sinks.photo_manifest(fired)


@query
def log_lines_quiet(spark, sf_dir):
    rows, _ = fleet.judged(spark, sf_dir, keep=PHOTO_COLUMNS)
    return sinks.log_lines(render.decision_lines(rows), quiet=True)


# Projections and filters


@query
def explode_detections(spark, sf_dir):
    return detect.explode_results(fleet.results(spark, sf_dir)).select(
        *ID, "class_id", F.round("conf", 6).alias("conf")
    )


@query
def box_trunc(spark, sf_dir):
    return detect.explode_results(fleet.results(spark, sf_dir)).select(*ID, *BOX)


@query
def conf_prefilter(spark, sf_dir):
    rows = detect.above_conf(detect.explode_results(fleet.results(spark, sf_dir)))
    return rows.select(*ID, F.round("conf", 6).alias("conf"))


def _messy(spark, sf_dir):
    return fleet.events(spark, sf_dir).select("event_id", fleet.messy_label().alias("label"))


@query
def label_slug_query(spark, sf_dir):
    return _messy(spark, sf_dir).select("event_id", label_slug(F.col("label")).alias("slug"))


@query
def cooldown_key_query(spark, sf_dir):
    return _messy(spark, sf_dir).select("event_id", cooldown_key(F.col("label")).alias("cooldown_key"))


def _cascades(spark, sf_dir):
    """Messy labels resolved with and without the catch-all policy."""
    import json

    rows = _messy(spark, sf_dir)
    plain = settings.settings_from_text(spark, json.dumps(fleet.CASCADE))
    caught = settings.settings_from_text(spark, json.dumps(fleet.CASCADE | fleet.CATCH_ALL))
    return policy.resolve(rows, plain).withColumn("variant", F.lit("plain")).unionByName(
        policy.resolve(rows, caught).withColumn("variant", F.lit("caught"))
    )


@query
def policy_resolve(spark, sf_dir):
    return _cascades(spark, sf_dir).select("event_id", "variant", "matched_rule", "policy_key")


@query
def policy_fields(spark, sf_dir):
    return policy.with_fields(_cascades(spark, sf_dir)).select(
        "event_id", "variant", "open_s", "cooldown_s", "min_conf"
    )


@query
def eligible(spark, sf_dir):
    rows = fleet.resolved(spark, fleet.fleet(spark, sf_dir)).where("eligible")
    return rows.select(*ID, "label", "open_s", "cooldown_s", "min_conf")


@query
def decisions_query(spark, sf_dir):
    rows = fleet.fleet(spark, sf_dir)
    wanted = rows.select(*ID, "t_us", "label", "conf", "force")
    decided = decisions(fleet.resolved(spark, wanted), measure(rows), fleet.MIN_INTER_S)
    return decided.select(*ID, "label", "decision", "species_left_us", "busy_left_us")


@query
def every_n(spark, sf_dir):
    rows = fleet.frames(spark, sf_dir)
    layout = measure(rows)
    capped = thinning.fps_cap(rows.select("trap_id", "frame_id", "t_us"), layout, 0.0)
    return thinning.every_nth(capped, 3, layout).select("trap_id", "frame_id", "frame_idx")


@query
def crop_geometry(spark, sf_dir):
    rows = fleet.fleet(spark, sf_dir)
    box = crop(*(F.col(c) for c in (*BOX, "width", "height")))
    return rows.select(*ID, box.alias("c")).select(*ID, "c.*")


@query
def annotations(spark, sf_dir):
    rows, _ = fleet.judged(spark, sf_dir, keep=("label", "conf", *BOX))
    drawn = boxcache.annotated(rows, F.col("ok"))
    return drawn.select(*ID, "caption", "blue", "green", "red", "anchor_x", "anchor_y")


@query
def log_render(spark, sf_dir):
    rows, _ = fleet.judged(spark, sf_dir, keep=PHOTO_COLUMNS)
    return render.decision_lines(rows)


# Joins


@query
def class_lookup(spark, sf_dir):
    boxes = detect.explode_results(fleet.results(spark, sf_dir))
    named = detect.with_labels(boxes, detect.class_names(spark, fleet.NAMES))
    return named.select(*ID, "class_id", "label")


@query
def box_ttl_asof(spark, sf_dir):
    rows = fleet.frames(spark, sf_dir)
    boxes = fleet.camera_boxes(spark, sf_dir)
    shown = boxcache.cached_boxes(rows, boxes, measure(rows), fleet.BOX_TTL_S)
    return shown.select("trap_id", "frame_id", "set_frame_id", "set_t_us", "det_idx", "label", "x1", "y1")


@query
def door_open_frames(spark, sf_dir):
    fired, layout = _fired(spark, sf_dir)
    return door.open_frames(fleet.fleet(spark, sf_dir), fired, layout)


@query
def auto_close_asof(spark, sf_dir):
    fired, layout = _fired(spark, sf_dir, forced=True)
    return door.auto_close(fleet.fleet(spark, sf_dir), fired, layout)


@query
def block_attribution(spark, sf_dir):
    rows, layout = fleet.judged(spark, sf_dir)
    return door.blockers(rows, layout)


# Aggregations


@query
def species_counts(spark, sf_dir):
    fired, _ = _fired(spark, sf_dir, keep=("session_key", "label"))
    return metrics.species_counts(fired)


@query
def decision_summary(spark, sf_dir):
    rows = fleet.fleet(spark, sf_dir)
    wanted = rows.select(*ID, "t_us", "label", "conf", "force")
    decided = decisions(fleet.resolved(spark, wanted), measure(rows), fleet.MIN_INTER_S)
    return metrics.decision_summary(decided.withColumn("cooldown_key", cooldown_key(F.col("label"))))


@query
def fps_rolling(spark, sf_dir):
    rows = fleet.frames(spark, sf_dir)
    rolled = metrics.rolling_fps(rows.select("trap_id", "frame_id", "t_us", "dt_us"), measure(rows))
    return rolled.select("trap_id", "frame_id", F.round("fps_avg", 6).alias("fps_avg"))


@query
def gate_state_asof(spark, sf_dir):
    fired, _ = _fired(spark, sf_dir, forced=True)
    return metrics.state_at(fired, fleet.SNAPSHOT_US)


@query
def traplog_summary(spark, sf_dir):
    parsed = logs.parse_trap_log(fleet.trap_log_lines(spark, sf_dir)).where("matched")
    # the layout and the windows read the log several times; its lines are parsed once
    path = fresh_dir(spark, "log")
    parsed.select("label", "line_id", t_us(F.col("ts")).alias("t_us")).write.parquet(path)
    log = spark.read.parquet(path)
    return metrics.label_gaps(log, measure(log, ("label",)), ["t_us", "line_id"])


# Windows and set operations


@query
def cooldown_compliance(spark, sf_dir):
    fired, layout = _fired(spark, sf_dir, forced=True)
    checked = metrics.compliance(fired, layout, min_inter_s=fleet.MIN_INTER_S)
    return checked.select(
        *ID, "species_gap_us", "trap_gap_us", "cooldown_violation", "busy_violation"
    )


@query
def latest_frame(spark, sf_dir):
    return metrics.latest_frames(fleet.frames(spark, sf_dir), 6 * 3_600_000_000)


@query
def overlay_union(spark, sf_dir):
    rows = fleet.frames(spark, sf_dir)
    boxes = fleet.camera_boxes(spark, sf_dir)
    shown = boxcache.overlay(rows, boxes, measure(rows), fleet.BOX_TTL_S)
    return shown.select("trap_id", "frame_id", "source", "det_idx", "label", *BOX)


# Stateful operators

VERDICT = (*ID, "t_us", "ok", "reason", "species_left_us", "busy_left_us",
           "hold_until_us", "busy_until_us", "cooldown_until_us")


@query
def gate_decisions(spark, sf_dir):
    return fleet.judged(spark, sf_dir)[0].select(*VERDICT)


@query
def trap_pipeline(spark, sf_dir):
    """The whole controller over the cameras: what its run leaves in the log and in the tables of its sinks."""
    controls = controller.Controls(
        fleet.GLOBAL_CONF, 0.0, 2, fleet.MIN_INTER_S, fleet.BLOCK_LOG_S, 10 * fleet.HOUR_S, quiet=False)
    frames, results = fleet.frames(spark, sf_dir).drop("frame_ts", "ok"), fleet.results(spark, sf_dir)
    outcome = controller.control(frames, results, fleet.fleet_settings(spark), fleet.NAMES, controls)
    path = fresh_dir(spark, "run")
    for _ in range(2):  # a run that is repeated leaves one copy
        controller.store(outcome, path, "run-1", controls)

    def rows(kind, table, text, t):
        known = [F.col(c) if c in table.columns else F.lit(None).cast("long").alias(c) for c in ID]
        return table.select(F.lit(kind).alias("kind"), *known, t.alias("t_us"), F.col(text).alias("text"))

    log = spark.read.parquet(f"{path}/log").where("line NOT LIKE '[FPS]%'")
    found = rows("log", log, "line", F.col("t_us"))
    for kind, t in (("event", t_us(F.col("ts"))), ("photo", F.col("t_us")), ("count", F.col("n"))):
        found = found.unionByName(rows(kind, sinks.read_run_table(spark, path, f"{kind}s"), "species", t))
    return found


@query
def gate_multibox(spark, sf_dir):
    """Several boxes a frame: a trap's events of one day are the boxes of one frame."""
    day = F.date_trunc("day", "frame_ts")
    rows = fleet.fleet(spark, sf_dir).withColumns({"t_us": t_us(day), "frame_id": F.unix_date(day.cast("date")).cast("long")})
    layout = measure(rows)
    entering = candidates(fleet.resolved(spark, rows)).select(*fleet.GATE_COLUMNS)
    return gate(entering, layout, fleet.MIN_INTER_S).select(*VERDICT)


@query
def gate_forced(spark, sf_dir):
    return fleet.judged(spark, sf_dir, forced=True)[0].select(*VERDICT, "force")


@query
def throttle_fps_cap(spark, sf_dir):
    rows = fleet.frames(spark, sf_dir)
    return thinning.fps_cap(rows.select("trap_id", "frame_id", "t_us"), measure(rows), 0.0)


@query
def throttle_block_log(spark, sf_dir):
    rows, layout = fleet.judged(spark, sf_dir, keep=("label",))
    logged = thinning.block_log(rows.where("NOT ok"), layout, fleet.BLOCK_LOG_S)
    return logged.select(*ID, "t_us", render.block_line().alias("line"))


@query
def fps_log_emit(spark, sf_dir):
    rows = fleet.frames(spark, sf_dir).select("trap_id", "frame_id", "t_us", "dt_us")
    reported = thinning.fps_report(rows, measure(rows), 10 * fleet.HOUR_S)
    rate = F.round("fps_now", 6)
    return reported.select("trap_id", "frame_id", "t_us", rate.alias("fps_now"), render.fps_line(rate).alias("line"))


@query
def door_timeline(spark, sf_dir):
    fired, layout = _fired(spark, sf_dir, forced=True)
    rows = fleet.fleet(spark, sf_dir)
    commands = rows.where(F.col("k").between(10, 15)).withColumn(
        "command", F.when(F.col("k") < 13, "manual-open").otherwise("manual-close")
    )
    return door.timeline(rows, fired, commands, layout)


@query
def deadband_thin(spark, sf_dir):
    rows = fleet.events(spark, sf_dir).select(
        F.col("user_id").alias("trap_id"), F.col("event_id").alias("frame_id"), t_us(F.col("ts")).alias("t_us"), "value"
    )
    return thinning.deadband(rows, ("t_us", "frame_id"), measure(rows), 60.0, 12 * fleet.HOUR_S)


# Inference


@query
def batch_inference(spark, sf_dir):
    return streams.inference(spark, sf_dir)


@query
def box_nms(spark, sf_dir):
    return suppress(fleet.day_boxes(spark, sf_dir)).select(*ID, "class_id", *BOX)


# Streams


@query
def gate_stream(spark, sf_dir):
    return streams.gate_rows(spark, sf_dir).select(*VERDICT, "late")


@query
def door_open_stream(spark, sf_dir):
    return streams.open_frames(spark, sf_dir)


@query
def latest_frame_stream(spark, sf_dir):
    return streams.latest_frames(spark, sf_dir, 6 * 3600)


@query
def gate_late(spark, sf_dir):
    return streams.late_rows(spark, sf_dir).select(*VERDICT, "late")


@query
def counter_stream(spark, sf_dir):
    return streams.counter(spark, sf_dir)


@query
def photo_stream(spark, sf_dir):
    return streams.photos_once(spark, sf_dir)


@query
def gate_state_store(spark, sf_dir):
    return streams.gate_state(spark, sf_dir)


@query
def box_ttl_stream(spark, sf_dir):
    return streams.cached_boxes(spark, sf_dir)


@query
def auto_close_stream(spark, sf_dir):
    return streams.closes(spark, sf_dir)


@query
def stream_sinks(spark, sf_dir):
    return streams.counts(spark, sf_dir)


# Queries named like the functions they show.
for name in ("label_slug", "cooldown_key", "decisions"):
    QUERIES[name] = QUERIES.pop(f"{name}_query")
