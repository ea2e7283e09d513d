from pyspark.sql import functions as F

from helpers import WHOLE, S
from latchflow.functions.numbers import t_us
from latchflow.operators import detect, metrics, render
from latchflow.operators.suppress import suppress
from latchflow.schema import RAW_RESULT
from latchflow.sources import feeds, logs, sinks

LOG = """[2025-03-01 10:00:00] Trap triggered by 'fox'. Open for 1s, cooldown 20s.
[2025-03-01 10:00:02] Trap triggered by 'big owl'. Open for 2s, cooldown 10s.
[2025-03-01 10:00:20] Trap triggered by 'fox'. Open for 1s, cooldown 20s.
some other line
[2025-03-01 10:00:25] Trap triggered by 'big owl'. Open for 2s, cooldown 10s.
[2025-03-01 10:00:39] Trap triggered by 'fox'. Open for 1s, cooldown 20s.
"""


def test_trap_log(spark, tmp_path):
    path = tmp_path / "trap.txt"
    path.write_text(LOG)
    rows, rejected = logs.read_trap_log(spark, str(path))
    assert [r.value for r in rejected.collect()] == ["some other line"]
    assert dict(rows.dtypes)["ts"] == "timestamp_ntz"
    log = rows.withColumns({"t_us": t_us(F.col("ts")), "trap_id": F.lit(1),
                            "open_us": (F.col("open_s") * S).cast("long"),
                            "cooldown_us": (F.col("cooldown_s") * S).cast("long")})
    gaps = {r.label: (r.n, r.min_gap_us // S, r.max_gap_us // S) for r in metrics.label_gaps(log, WHOLE, ["t_us"]).collect()}
    assert gaps == {"fox": (3, 19, 20), "big owl": (2, 23, 23)}

    def violations(inter):
        checked = metrics.compliance(log, WHOLE, ["t_us"], "label", inter)
        counts = F.sum(F.col("cooldown_violation").cast("int")), F.sum(F.col("busy_violation").cast("int"))
        return tuple(checked.agg(*counts).first())

    assert violations(1.0) == (1, 0)
    assert violations(1.5) == (1, 1)


def test_console_log_round_trip(spark):
    rows = [
        (1, 1, 0, 0, True, "first_trigger", "big fox", 0.615, 1_200_000, 8 * S, 0, 0, -5, 2, 30, 40),
        (1, 2, 0, 1, False, "global_busy", "owl", 0.5, S, 8 * S, 0, 1_125_000, 1, 2, 3, 4),
        (1, 3, 0, 2, False, "species_cooldown", "owl x", 0.5, S, 8 * S, 6_500_000, 0, 1, 2, 3, 4),
    ]
    df = spark.createDataFrame(rows, "trap_id long, frame_id long, det_idx long, t_us long, ok boolean, reason string, "
                               "label string, conf double, open_us long, cooldown_us long, species_left_us long, "
                               "busy_left_us long, x1 int, y1 int, x2 int, y2 int")  # fmt: skip
    lines = render.decision_lines(df).withColumnRenamed("line", "value")
    assert sorted(r.value for r in lines.collect()) == [
        "[BLOCK] owl busy 1.12s", "[BLOCK] owl x species_cd 6.50s", "[PHOTO] big fox bbox=(-5,2,30,40)",
        "[TRIG] big fox conf=0.61 open=1.2s cd=8.0s",
    ]
    got = {(r.tag, r.label): r for r in logs.parse_console_log(lines).collect()}
    assert (got[("TRIG", "big fox")].conf, got[("TRIG", "big fox")].open_s, got[("TRIG", "big fox")].cd_s) == (0.61, 1.2, 8.0)
    assert (got[("PHOTO", "big fox")].x1, got[("PHOTO", "big fox")].y2) == (-5, 40)
    assert (got[("BLOCK", "owl")].reason, got[("BLOCK", "owl")].left_s) == ("global_busy", 1.12)
    assert (got[("BLOCK", "owl x")].reason, got[("BLOCK", "owl x")].left_s) == ("species_cooldown", 6.5)


def test_other_console_lines(spark):
    text = ["[FPS] avg=9.50", "[FPS] no frames yet", "[BLOCK] fox hold", "[Firebase] init failed: no route", "[What] x", "[Firebase] Enabled"]
    one = spark.range(1).select(
        render.start_line(F.lit("m.pt"), F.lit(640), F.lit(480), F.lit("MJPG"), F.lit(0.45), F.lit(320)).alias("value"),
        render.fps_line(F.lit(9.504)).alias("fps"), render.fps_line(F.lit(None).cast("double")).alias("none"),
        render.sink_error_line(F.lit("init"), F.lit("no route")).alias("sink"),
    ).first()
    assert one.value == "[Start] model=m.pt cam=640x480@MJPG conf=0.45 imgsz=320"
    assert (one.fps, one.none, one.sink) == (text[0], text[1], text[3])
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*text, one.value])], "i int, value string")
    got = logs.parse_console_log(df).orderBy("i").collect()
    assert [(r.tag, r.label, r.reason, r.fps, r.message) for r in got] == [
        ("FPS", None, None, 9.5, None), ("FPS", None, None, None, "no frames yet"), ("BLOCK", "fox", "hold", None, None),
        ("Firebase", None, None, None, "init failed: no route"), (None, None, None, None, None), ("Firebase", None, None, None, "Enabled"),
        ("Start", None, None, None, "model=m.pt cam=640x480@MJPG conf=0.45 imgsz=320"),
    ]


def test_results_and_names(spark):
    rows = [
        (1, 1, None, [[-0.9, 10.9, 5.0, 7.0], [1.0, 2.0, 3.0, 4.0]], [0.45, 0.449], [0, 99]),
        (1, 2, None, [], [], []),
        (1, 3, None, [[0.0, 0.0, 1.0, 1.0]], [0.9], [-1]),
    ]
    boxes = detect.explode_results(spark.createDataFrame(rows, RAW_RESULT))
    names = ["fox", "owl"]
    joined = detect.with_labels(boxes, detect.class_names(spark, names)).orderBy("frame_id", "det_idx").collect()
    assert [(r.label, r.x1, r.y1) for r in joined] == [("fox", 0, 10), ("class_99", 1, 2), ("class_-1", 0, 0)]
    direct = boxes.withColumn("label", detect.label_of(F.col("class_id"), names)).orderBy("frame_id", "det_idx")
    assert [r.label for r in direct.collect()] == [r.label for r in joined]
    assert detect.above_conf(boxes).count() == 2


def test_confidence_reaches_the_scan(spark, tmp_path):
    spark.createDataFrame([(1, 0.5, "x"), (2, 0.1, "y")], "i int, conf double, label string").write.parquet(str(tmp_path / "d"))
    rows = detect.above_conf(spark.read.parquet(str(tmp_path / "d"))).select("i", "conf")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(conf,0.45)" in plan and "ReadSchema: struct<i:int,conf:double>" in plan


def test_suppression(spark):
    rows = [
        (1, 1, 0, 0, 0.9, 0, 0, 30, 10),
        (1, 1, 1, 0, 0.8, 10, 0, 40, 10),  # overlap exactly one half: stays
        (1, 1, 2, 0, 0.7, 9, 0, 39, 10),  # more than half of the first
        (1, 1, 3, 1, 0.7, 0, 0, 30, 10),  # same box, other class
        (1, 1, 4, 0, 0.6, 0, 0, 30, 10),  # copy of the first
        (1, 1, 5, 0, 0.6, 5, 5, 5, 9),  # no area
        (1, 1, 6, 0, 0.6, 5, 5, 5, 9),
        (1, 2, 7, 0, 0.1, 0, 0, 30, 10),
    ]
    df = spark.createDataFrame(rows, "trap_id long, frame_id long, det_idx long, class_id int, conf double, x1 int, y1 int, x2 int, y2 int")
    assert sorted(r.det_idx for r in suppress(df).collect()) == [0, 1, 3, 5, 6, 7]


def test_feeds_and_images(spark, tmp_path):
    frames = spark.sql(
        "SELECT 1L trap_id, id frame_id, IF(id = 3, NULL, timestamp_micros(id)) frame_ts, id != 2 ok, "
        "640 width, 480 height, 0L dt_us FROM range(5)"
    )
    frames.write.json(str(tmp_path / "frames"))
    assert sorted(r.frame_id for r in feeds.read_frames(spark, str(tmp_path / "frames"), "json").collect()) == [0, 1, 4]
    images = tmp_path / "images"
    images.mkdir()
    (images / "a.jpg").write_bytes(b"abc")
    (images / "b.txt").write_bytes(b"x")
    assert [bytes(r.content) for r in feeds.read_images(spark, str(images)).collect()] == [b"abc"]

    def load():
        import pandas as pd

        def find(batch):
            n = batch["length"].tolist()
            return pd.DataFrame({"xyxy": [[[0.0, 0.0, float(x), 1.0]] for x in n], "conf": [[0.5]] * len(n), "cls": [[1]] * len(n)})

        return find

    stream = feeds.stream_images(spark, str(images))
    found = detect.infer(stream, load, ["path"])
    query = found.writeStream.format("memory").queryName("found").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [tuple(r) for r in spark.sql("SELECT xyxy[0][2], conf[0], cls[0] FROM found").collect()] == [(3.0, 0.5, 1)]


def test_detection_feeds(spark, tmp_path):
    path = str(tmp_path / "detections")
    spark.sql(
        "SELECT 1L trap_id, id frame_id, IF(id = 3, NULL, timestamp_micros(id)) frame_ts, 0L det_idx, 'fox' label, "
        "0.5D conf, IF(id = 1, 's9', NULL) session_key, IF(id = 1, true, NULL) force FROM range(4)"
    ).write.parquet(path)
    expected = [(0, "session_1", False, 0), (1, "s9", True, 1), (2, "session_1", False, 2)]
    columns = ["frame_id", "session_key", "force", "t_us"]
    assert sorted(map(tuple, feeds.read_detections(spark, path).select(*columns).collect())) == expected
    rows = feeds.stream_detections(spark, path).select(*columns)
    rows.writeStream.format("memory").queryName("fed").trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(tuple, spark.table("fed").collect())) == expected


def test_event_table_and_quiet_log(spark, tmp_path):
    fired = spark.createDataFrame([(1, 1, 0, 86_400_000_000, "session_1", "Fox", 0.5, S, 8 * S)],
                                  "trap_id long, frame_id long, det_idx long, t_us long, session_key string, "
                                  "label string, conf double, open_us long, cooldown_us long")  # fmt: skip
    path = str(tmp_path / "events")
    for _ in range(2):
        sinks.append_events(sinks.trigger_events(fired), path)
    assert (tmp_path / "events" / "session_key=session_1" / "event_date=1970-01-02").is_dir()
    assert spark.read.parquet(path).where("info.open_dur = 1.0 AND species = 'Fox'").count() == 2
    lines = spark.createDataFrame([("key", "a"), ("debug", "b")], "level string, line string")
    sinks.write_log(lines, str(tmp_path / "log"))
    assert [r.value for r in spark.read.text(str(tmp_path / "log")).collect()] == ["a"]
    assert sinks.log_lines(lines, quiet=False).count() == 2


def test_log_stamps_do_not_move_with_the_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    line = "[2025-03-09 02:30:00] Trap triggered by 'fox'. Open for 1s, cooldown 20s."
    lines = spark.createDataFrame([(line,)], "value string")
    try:
        for name in ("UTC", "America/New_York"):  # the hour does not exist in the second one
            spark.conf.set("spark.sql.session.timeZone", name)
            stamp = logs.parse_trap_log(lines).select(F.col("ts").cast("string").alias("t")).first()["t"]
            assert stamp == "2025-03-09 02:30:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
