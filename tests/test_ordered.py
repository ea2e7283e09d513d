"""Thinning, as-of look-ups, door states and metrics against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from helpers import WHOLE, S
from latchflow.operators import boxcache, door, metrics, thinning
from latchflow.operators.fold import fold_ordered
from latchflow.operators.slices import SLICE, measure
from latchflow.operators.timeline import first_after, last_before, numbered


def frames(spark, times, trap=1):
    rows = [(trap, i, t) for i, t in enumerate(times)]
    return spark.createDataFrame(rows, "trap_id long, frame_id long, t_us long")


def ids(df):
    return sorted(r.frame_id for r in df.collect())


def test_fps_cap_keeps_exact_gaps(spark):
    # 12 per second: 83,333 us are too few, 83,334 are enough.
    df = frames(spark, [0, 83_333, 83_334, 166_668, 200_000])
    assert ids(thinning.fps_cap(df, WHOLE)) == [0, 2, 3]
    kept = thinning.fps_cap(df, WHOLE)
    assert ids(thinning.fps_cap(kept, WHOLE)) == [0, 2, 3]
    assert ids(thinning.every_nth(kept, 2, WHOLE)) == [2]
    assert ids(thinning.every_nth(kept, 0, WHOLE)) == [0, 2, 3]


def test_block_log_and_deadband(spark):
    df = frames(spark, [0, 1_499_999, 1_500_000, 2_000_000, 3_000_000]).withColumn("det_idx", F.lit(0))
    assert ids(thinning.block_log(df, WHOLE)) == [0, 2, 4]
    series = spark.createDataFrame(
        [(1, 0, 0, 5.0), (1, 1, 10_000, 7.4), (1, 2, 20_000, 7.5), (1, 3, 79_999, 7.5), (1, 4, 80_000, 7.5)],
        "trap_id long, frame_id long, t_us long, value double",
    )
    assert ids(thinning.deadband(series, ("t_us", "frame_id"), WHOLE)) == [0, 2, 4]
    assert ids(thinning.deadband(series, ("t_us", "frame_id"), WHOLE, slewed=False)) == [0, 2]


def test_fps_report_counts_from_the_start(spark):
    rows = [(1, i, i * S, 0 if i < 7 else 50_000) for i in range(21)]
    df = spark.createDataFrame(rows, "trap_id long, frame_id long, t_us long, dt_us long")
    got = {r.frame_id: r.fps_now for r in thinning.fps_report(df, WHOLE, 1.0).collect()}
    # The interval has a floor of five seconds.
    assert got == {5: None, 10: 20.0, 15: 20.0, 20: 20.0}


def throttle_by_hand(times, gap):
    kept, last = [], None
    for i, t in enumerate(times):
        if last is None or t - last >= gap:
            kept.append(i)
            last = t
    return kept


@pytest.mark.parametrize("step", [1, 3])
def test_sliced_throttle_on_a_regular_grid(spark, slice_rows, step):
    times = [i * step * 100_000 for i in range(3000)]
    slice_rows(150)
    df = frames(spark, times)
    layout = measure(df)
    fold = thinning.ThrottleFold(730_000)
    marked = fold_ordered(df, ["trap_id"], ["t_us", "frame_id"], fold, layout)
    assert ids(marked.where("kept")) == throttle_by_hand(times, 730_000)


@pytest.mark.parametrize("gap_us, rate", [(20_000_000, 1), (730_000, 1), (1_000_000, 12), (1_000_000, 0.7), (0, 1)])
def test_throttle_of_a_dense_trap_takes_as_many_jobs_however_many_slices(spark, slice_rows, gap_us, rate):
    rng, t, times = random.Random(7), 0, []
    for _ in range(1500):
        t += rng.choice([0, 83_333, 83_334, 400_000, 5_000_000]) if rng.random() < 0.9 else rng.randrange(40_000_000)
        times.append(t)
    df = frames(spark, times).checkpoint()
    kept, last = [], None
    for i, at in enumerate(times):
        if last is None or (at - last) * rate >= gap_us:
            kept.append(i)
            last = at
    counted = set()
    for limit in (150, 38):
        slice_rows(limit)
        layout = measure(df)
        fold = thinning.ThrottleFold(gap_us, rate)
        name = f"throttle-{gap_us}-{rate}-{limit}"
        spark.sparkContext.setJobGroup(name, name)
        assert ids(fold_ordered(df, ["trap_id"], ["t_us", "frame_id"], fold, layout).where("kept")) == kept
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        counted.add(len(spark.sparkContext.statusTracker().getJobIdsForGroup(name)))
    assert len(counted) == 1, counted


def test_throttle_without_tables_is_tried(spark, slice_rows, monkeypatch):
    times = sorted(random.Random(3).randrange(100_000_000) for _ in range(900))
    slice_rows(100)
    df = frames(spark, times)
    layout = measure(df)
    want = throttle_by_hand(times, 2_000_000)
    for most in (20_000, 1):
        monkeypatch.setattr(thinning.ThrottleFold, "TABLE", most)
        fold = thinning.ThrottleFold(2_000_000)
        assert ids(fold_ordered(df, ["trap_id"], ["t_us", "frame_id"], fold, layout).where("kept")) == want


def test_slices_are_balanced_and_ordered(spark, slice_rows):
    # Half of the rows fall into one second of a day.
    day = F.when(F.col("id") % 2 == 0, F.col("id") * 40_000_000).otherwise(F.lit(5_000_000) + F.col("id") * 200)
    df = spark.range(4000).select(F.lit(1).cast("long").alias("trap_id"), day.cast("long").alias("t_us"))
    slice_rows(300)
    got = (
        measure(df).assign(df).groupBy(SLICE)
        .agg(F.count("*").alias("n"), F.min("t_us").alias("lo"), F.max("t_us").alias("hi"))
        .orderBy(SLICE).collect()
    )
    assert max(r.n for r in got) <= 300 and len(got) < 40
    assert all(a.hi < b.lo for a, b in zip(got, got[1:]))


@pytest.mark.parametrize("rows_per_slice", [None, 60])
def test_look_ups_equal_plain_loops(spark, slice_rows, rows_per_slice):
    rng = random.Random(3)
    rows = [
        (0 if rng.random() < 0.7 else rng.randrange(1, 5), i, rng.randrange(500), rng.choice([None, None, i]))
        for i in range(800)
    ]
    df = spark.createDataFrame(rows, "trap_id long, frame_id long, t_us long, v long")
    if rows_per_slice:
        slice_rows(rows_per_slice)
    layout = measure(df)
    order = ["t_us", "frame_id"]
    out = last_before(df, ["trap_id"], order, {"before": F.col("v")}, layout)
    out = first_after(out, ["trap_id"], order, {"after": F.col("v")}, layout)
    out = last_before(out, ["trap_id"], order, {"upto": F.col("v")}, layout, inclusive=True)
    got = {r.frame_id: r for r in numbered(out, ["trap_id"], order, "n", layout).collect()}
    for trap in range(5):
        line = sorted((r for r in rows if r[0] == trap), key=lambda r: (r[2], r[1]))
        for i, r in enumerate(line):
            seen = [x[3] for x in line[:i] if x[3] is not None]
            to_come = [x[3] for x in line[i + 1 :] if x[3] is not None]
            g = got[r[1]]
            assert g.before == (seen[-1] if seen else None)
            assert g.after == (to_come[0] if to_come else None)
            assert g.upto == (r[3] if r[3] is not None else g.before)
            assert g.n == i + 1


@pytest.mark.parametrize("rows_per_slice", [None, 80])
def test_rolling_fps(spark, slice_rows, rows_per_slice):
    rng = random.Random(9)
    rows = [(1, i, i * 1000, rng.choice([0, 20_000, 50_000, 125_000])) for i in range(700)]
    df = spark.createDataFrame(rows, "trap_id long, frame_id long, t_us long, dt_us long")
    if rows_per_slice:
        slice_rows(rows_per_slice)
    got = {r.frame_id: r.fps_avg for r in metrics.rolling_fps(df, measure(df)).collect()}
    rates = []
    for _, i, _, dt in rows:
        if dt > 0:
            rates.append(1_000_000 / dt)
            assert got.pop(i) == pytest.approx(sum(rates[-120:]) / len(rates[-120:]))
    assert not got


def test_box_cache_edges(spark):
    f = frames(spark, [0, 1 * S, 2 * S, 3 * S, 3 * S + 1])
    boxes = spark.createDataFrame(
        [(1, 1, 1 * S, 0, "fox", 0.9, 1, 2, 3, 4), (1, 1, 1 * S, 1, "owl", 0.9, 1, 2, 3, 4)],
        "trap_id long, frame_id long, t_us long, det_idx long, label string, conf double, x1 int, y1 int, x2 int, y2 int",
    )
    # Frame 2 detected nothing and does not clear the set; frame 3 is exactly 2 s after it.
    got = sorted((r.frame_id, r.label) for r in boxcache.cached_boxes(f, boxes, WHOLE).collect())
    assert got == [(2, "fox"), (2, "owl"), (3, "fox"), (3, "owl")]
    bag = boxcache.overlay(f, boxes, WHOLE).groupBy("frame_id", "source").count().collect()
    assert sorted(tuple(r) for r in bag) == [(1, "current", 2), (2, "cached", 2), (3, "cached", 2)]


TRIGGER = "trap_id long, frame_id long, det_idx long, t_us long, hold_until_us long"


def test_door(spark):
    f = frames(spark, [0, 10, 20, 30, 40, 50])
    fired = spark.createDataFrame([(1, 1, 0, 10, 30), (1, 2, 0, 20, 25), (1, 4, 0, 40, 90)], TRIGGER)
    opened = door.open_frames(f, fired, WHOLE).collect()
    assert sorted((r.frame_id, r.trigger_us) for r in opened) == [(1, 10), (2, 20), (4, 40), (5, 40)]
    closed = sorted((r.trigger_us, r.close_us) for r in door.auto_close(f, fired, WHOLE).collect())
    # The first hold is replaced by the forced second one; the last never closes on a frame.
    assert closed == [(20, 30), (40, None)]
    commands = spark.createDataFrame([(1, 3, 27, "manual-open"), (1, 3, 28, "manual-close")],
                                     "trap_id long, frame_id long, t_us long, command string")
    got = door.timeline(f, fired, commands, WHOLE).orderBy("at_us").collect()
    assert [(r.at_us, r.event, r.door, r.until_us) for r in got] == [
        (0, "init-closed", "closed", 10), (10, "trigger-open", "open", 20), (20, "trigger-open", "open", 25),
        (25, "auto-close", "closed", 27), (27, "manual-open", "open", 28), (28, "manual-close", "closed", 40),
        (40, "trigger-open", "open", 90), (90, "auto-close", "closed", None),
    ]


def test_state_takes_the_latest_trigger(spark):
    fired = spark.createDataFrame(
        [(1, 1, 0, 10, "fox", 500, 600, 900), (1, 2, 0, 20, "fox", 40, 50, 60), (1, 3, 0, 99, "owl", 200, 210, 220)],
        "trap_id long, frame_id long, det_idx long, t_us long, cooldown_key string, "
        "hold_until_us long, busy_until_us long, cooldown_until_us long",
    )
    got = {r.cooldown_key: (r.hold_left_us, r.busy_left_us, r.cooldown_left_us) for r in metrics.state_at(fired, 45).collect()}
    assert got == {None: (0, 5, None), "fox": (None, None, 15)}
