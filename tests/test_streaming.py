import json
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from helpers import GATE_SCHEMA, WHOLE, S, verdicts_of
from latchflow.operators.boxcache import cached_boxes
from latchflow.operators.door import open_frames, unsuperseded
from latchflow.operators.gate import gate
from latchflow.operators.metrics import latest_frames
from latchflow.plans.session import prepare_streaming
from latchflow.plans import streams
from latchflow.plans.streams import Clock, run_to_end
from latchflow.streaming import autoclose, boxcache, sinks
from latchflow.streaming.door import hold_stream, latest_frame_stream, open_frame_stream
from latchflow.streaming import ordered
from latchflow.streaming.gate import committed, deadline_changes, deadline_history, gate_stream, read_cooldowns, read_deadlines
from test_gate import crowded


def write_parts(spark, rows, schema, folder, parts, first=0):
    """One JSON file per part, in time order, with rising modification times."""
    os.makedirs(folder, exist_ok=True)
    names = [c.split()[0] for c in schema.split(", ")]
    size = -(-len(rows) // parts)
    for i in range(parts):
        path = os.path.join(folder, f"part-{first + i:03d}.json")
        with open(path, "w") as out:
            for row in rows[i * size : (i + 1) * size]:
                out.write(json.dumps(dict(zip(names, row))) + "\n")
        os.utime(path, (1_700_000_000 + first + i,) * 2)


def stream(spark, folder, schema):
    prepare_streaming(spark)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(folder)


def run(df, table, checkpoint):
    sinks.write_table(df, table, checkpoint).awaitTermination()


def run_with_beat(spark, build, table, checkpoint):
    """All that is there, then a last beat that lets every row out."""
    clock = Clock(spark)
    run_to_end(clock, lambda: sinks.write_table(build(clock.beats()), table, checkpoint))


def shaken(rows, seconds, at):
    """Rows in an order that no row is behind another one's time by more than this."""
    rng = random.Random(2)
    return sorted(rows, key=lambda r: r[at] + rng.random() * seconds * S)


def stored(spark, state, name):
    return spark.read.format("statestore").option("stateVarName", name).load(state)


@pytest.mark.parametrize("parts, forced", [(1, 0.01), (2, 0.0), (9, 0.02)])
def test_gate_stream_equals_batch_however_it_is_cut(spark, tmp_path, parts, forced):
    rows = shaken(crowded(5, 600, forced, traps=3), 9, 3)
    schema = GATE_SCHEMA + ", note string, seen timestamp, x1 int"
    full = [(*r, None if i % 3 else f"n{i}", "2024-01-01T00:00:00.123456Z", i) for i, r in enumerate(rows)]
    folder, table, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    write_parts(spark, full, schema, folder, parts)
    run_with_beat(spark, lambda beats: gate_stream(stream(spark, folder, schema), delay="10 seconds", beats=beats), table, state)
    got = spark.read.parquet(table)
    assert verdicts_of(got) == verdicts_of(gate(spark.createDataFrame(rows, GATE_SCHEMA), WHOLE))
    assert got.count() == len(rows) and got.where("late").count() == 0
    # further columns come through as they are
    assert {(r.det_idx, r.note, r.x1) for r in got.collect()} == {(r[2], r[8], r[10]) for r in full}
    assert got.where("unix_micros(seen) % 1000000 <> 123456").count() == 0
    # nothing waits, and all cooldowns have passed
    assert stored(spark, state, "waiting").count() == stored(spark, state, "cooldowns").count() == 0


def test_gate_stream_restart_late_rows_and_state(spark, tmp_path):
    folder, table, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    first = [(1, 1, 0, 1 * S, "fox", 2 * S, 8 * S, False), (1, 2, 0, 2 * S, "owl", S, S, False), (1, 6, 0, 14 * S, "elk", S, 30 * S, False)]
    second = [
        (1, 3, 0, 1_500_000, "owl", S, S, False),  # behind the watermark of 4 s
        (1, 4, 0, 4_500_000, "owl", S, 2 * S, False),
        (1, 5, 0, 7 * S, "fox", S, S, False),
        (2, 7, 0, 26 * S, "owl", S, S, False),
    ]
    write_parts(spark, first, GATE_SCHEMA, folder, 1)
    run(gate_stream(stream(spark, folder, GATE_SCHEMA), keep_passed=False), table, state)
    assert {r.frame_id for r in spark.read.parquet(table).collect()} == {1, 2}
    assert {r.cooldown_key: r.until_us for r in read_cooldowns(spark, state).collect()} == {"fox": 9 * S}
    assert stored(spark, state, "waiting").count() == 1
    write_parts(spark, second, GATE_SCHEMA, folder, 1, first=1)
    run(gate_stream(stream(spark, folder, GATE_SCHEMA), keep_passed=False), table, state)
    got = {r.frame_id: (r.reason, r.late) for r in spark.read.parquet(table).collect()}
    assert got == {
        1: ("first_trigger", False), 2: ("global_busy", False), 3: (None, True), 4: ("ok", False),
        5: ("species_cooldown", False), 6: ("ok", False),
    }
    deadlines = [tuple(r) for r in read_deadlines(spark, state).select("trap_id", "busy_until_us", "hold_until_us", "last_us").collect()]
    assert deadlines == [(1, 16_500_000, 15 * S, 14 * S)]
    # what has passed at 16 s is gone, the pending one is kept
    assert {r.cooldown_key: r.until_us for r in read_cooldowns(spark, state).collect()} == {"elk": 44 * S}


def test_box_stream_equals_batch(spark, tmp_path):
    schema = "trap_id long, frame_id long, t_us long, boxes array<struct<det_idx:long,label:string,x1:int>>"
    rows = []
    for i in range(60):
        boxes = [{"det_idx": j, "label": "fox" if j else None, "x1": i} for j in range(i % 3)] if i % 4 else []
        rows.append((i % 2, i, i * 700_000, boxes))
    folder, table, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    write_parts(spark, shaken(rows, 9, 2), "trap_id, frame_id, t_us, boxes", folder, 4)
    run_with_beat(spark, lambda beats: boxcache.cached_box_stream(stream(spark, folder, schema), beats=beats), table, state)
    assert stored(spark, state, "latest").count() == stored(spark, state, "before").count() == 0
    frames = spark.createDataFrame([(*r[:3], json.dumps(r[3])) for r in rows], "trap_id long, frame_id long, t_us long, b string")
    opened = frames.select("trap_id", "frame_id", "t_us", F.explode(F.from_json("b", schema.split("boxes ")[1])).alias("b"))
    batch = cached_boxes(frames, opened.select("trap_id", "frame_id", "t_us", "b.*"), WHOLE)
    columns = ["trap_id", "frame_id", "set_frame_id", "det_idx", "label", "x1"]
    one, two = (sorted(map(repr, df.select(*columns).collect())) for df in (batch, spark.read.parquet(table)))
    assert one == two and one


def test_box_stream_with_equal_times(spark, tmp_path):
    """Four frames share each time; none sees a set of its own time."""
    schema = "trap_id long, frame_id long, t_us long, boxes array<struct<det_idx:long,label:string>>"
    rows = [(1, i, i // 4 * S, [{"det_idx": 0, "label": "fox"}] if i % 4 in (0, 2) else []) for i in range(16)]
    folder, table, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    write_parts(spark, rows, "trap_id, frame_id, t_us, boxes", folder, 3)
    run_with_beat(spark, lambda beats: boxcache.cached_box_stream(stream(spark, folder, schema), 1.0, beats=beats), table, state)
    got = sorted((r.frame_id, r.set_frame_id) for r in spark.read.parquet(table).collect())
    assert got == [(i, i // 4 * 4 - 2) for i in range(4, 16)]


def test_auto_close_stream(spark, tmp_path):
    schema = "trap_id long, frame_id long, det_idx long, t_us long, hold_until_us long"
    rows = [
        (1, 1, 0, 1 * S, 3 * S), (1, 2, 0, 2 * S, 2_500_000),  # the second replaces the first
        (2, 3, 0, 2 * S, 9 * S), (1, 4, 0, 5 * S, 6 * S), (3, 5, 0, 7 * S, 7_000_400), (2, 6, 0, 20 * S, 50 * S), (1, 7, 0, 6 * S, 8 * S),
    ]
    fired = spark.createDataFrame(rows, schema)
    stands = {(r.trap_id, r.t_us, r.hold_until_us) for r in unsuperseded(fired, WHOLE).collect()}
    for parts in (1, 3, 7):
        folder, table, state = (str(tmp_path / f"{n}{parts}") for n in ("in", "out", "state"))
        write_parts(spark, shaken(rows, 9, 3), schema, folder, parts)
        source = stream(spark, folder, schema).withColumn("frame_ts", F.timestamp_micros("t_us"))
        run_with_beat(spark, lambda beats: autoclose.auto_close_stream(source, beats=beats), table, state)
        got = [(r.trap_id, r.trigger_us, r.hold_until_us, r.late) for r in spark.read.parquet(table).collect()]
        assert sorted(got) == sorted((*r, False) for r in stands)
        assert stored(spark, state, "hold").count() == 0


def test_late_triggers_are_shown(spark, tmp_path):
    schema = "trap_id long, frame_id long, det_idx long, t_us long, hold_until_us long"
    rows = [(1, 1, 0, 30 * S, 31 * S), (1, 2, 0, 5 * S, 60 * S)]
    folder, table, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    write_parts(spark, rows, schema, folder, 2)
    source = stream(spark, folder, schema).withColumn("frame_ts", F.timestamp_micros("t_us"))
    run_with_beat(spark, lambda beats: autoclose.auto_close_stream(source, beats=beats), table, state)
    assert sorted(tuple(r) for r in spark.read.parquet(table).collect()) == [(1, 5 * S, 60 * S, True), (1, 30 * S, 31 * S, False)]


def test_photos_and_counts_survive_a_repeated_batch(spark, tmp_path):
    schema = GATE_SCHEMA + ", session_key string, label string, x1 int, y1 int, x2 int, y2 int, width int, height int"
    rows = [(t, i, 0, i * 100 * S, "fox", S, S, False, "s1", "Fox", 0, 0, 9, 9, 640, 480) for i in range(6) for t in (1, 2)]
    folder, photos, counts, state = (str(tmp_path / n) for n in ("in", "photos", "counts", "state"))
    write_parts(spark, rows, schema, folder, 3)
    clock = Clock(spark)
    run_to_end(clock, lambda: sinks.write_photos_and_counts(
        gate_stream(stream(spark, folder, schema), beats=clock.beats()), photos, counts, state))
    # Forget the last commit: the batch runs again.
    last = sorted(int(n) for n in os.listdir(f"{state}/commits") if n.isdigit())[-1]
    os.remove(f"{state}/commits/{last}")
    os.remove(f"{state}/commits/.{last}.crc")
    judged = gate_stream(stream(spark, folder, schema), beats=clock.beats())
    sinks.write_photos_and_counts(judged, photos, counts, state).awaitTermination()
    assert [tuple(r) for r in sinks.read_counts(spark, counts).collect()] == [("s1", "Fox", 12)]
    assert spark.read.parquet(photos).count() == 12


def test_counter_keeps_one_row_per_key(spark, tmp_path):
    schema = "session_key string, label string, t_us long"
    rows = [(None if i % 5 == 0 else f"s{i % 2}", None if i % 7 == 0 else "Fox", i) for i in range(60)]
    folder, table, state = (str(tmp_path / n) for n in ("in", "counts", "state"))
    want = Counter((r[0], r[1]) for r in rows)
    for part in range(3):
        write_parts(spark, rows[part * 20 : part * 20 + 20], schema, folder, 4, first=4 * part)
        sinks.write_counter(stream(spark, folder, schema), table, state).awaitTermination()
        found = sinks.read_counter(spark, table)
        assert Counter({(r.session_key, r.species): r.n for r in found.collect()}) == Counter((r[0], r[1]) for r in rows[: part * 20 + 20])
    assert found.count() == len(want) and len(os.listdir(table)) <= 2
    # Forget the last commit: the batch runs again.
    last = sorted(int(n) for n in os.listdir(f"{state}/commits") if n.isdigit())[-1]
    os.remove(f"{state}/commits/{last}")
    os.remove(f"{state}/commits/.{last}.crc")
    sinks.write_counter(stream(spark, folder, schema), table, state).awaitTermination()
    assert Counter({(r.session_key, r.species): r.n for r in sinks.read_counter(spark, table).collect()}) == want


def test_photos_sent_twice_are_kept_once(spark, tmp_path):
    schema = "trap_id long, frame_id long, det_idx long, session_key string, label string, t_us long, x1 int, y1 int, x2 int, y2 int, width int, height int, good boolean"
    rows = [(1, i, 0, "s1", "Fox", i * S, 0, 0, 9, 9, 640, 480, i % 4 > 0) for i in range(8)]
    folder, table, state = (str(tmp_path / n) for n in ("in", "photos", "state"))
    write_parts(spark, [*rows, *rows[4:], *rows], schema, folder, 3)
    source = stream(spark, folder, schema)
    sinks.write_photos(source, table, state, "1 minute", F.col("good")).awaitTermination()
    assert sorted(r.frame_id for r in spark.read.parquet(table).collect()) == [1, 2, 3, 5, 6, 7]
    assert [n for n in os.listdir(table) if n.startswith("session_key=")] == ["session_key=s1"]


def test_holds_end_at_their_time_or_at_the_next_trigger(spark, tmp_path):
    rows = shaken(crowded(9, 120, 0.3, traps=3, span=900), 9, 3)
    judged = gate(spark.createDataFrame(rows, GATE_SCHEMA), WHOLE).where("ok").checkpoint()
    fired = sorted(((r.trap_id, r.frame_id, r.det_idx, r.t_us, r.hold_until_us) for r in judged.collect()), key=lambda r: (r[3], r[1], r[2]))
    schema = "trap_id long, frame_id long, det_idx long, t_us long, hold_until_us long"
    names = ("in", "out", "state", "frames", "joined", "join")
    folder, table, state, seen, joined, join = (str(tmp_path / n) for n in names)
    write_parts(spark, shaken(fired, 9, 3), schema, folder, 4)
    run_with_beat(spark, lambda beats: hold_stream(stream(spark, folder, schema), beats=beats), table, state)
    found = sorted((r.trap_id, r.trigger_us, r.trigger_frame_id, r.hold_until_us, r.until_us) for r in spark.read.parquet(table).collect())
    want = []
    for trap in range(3):
        line = [r for r in fired if r[0] == trap]
        for r, following in zip(line, [*line[1:], None]):
            want.append((trap, r[3], r[1], r[4], min(r[4], following[3]) if following else r[4]))
    assert found == sorted(want)
    # the join of two streams equals the batch look-up
    frames = [(t % 3, i, t * 250_000) for i, t in enumerate(range(0, 1900))]
    write_parts(spark, shaken(frames, 9, 2), "trap_id, frame_id, t_us", seen, 5)
    held = spark.readStream.schema(spark.read.parquet(table).schema).parquet(table).where("NOT late")
    run(open_frame_stream(stream(spark, seen, "trap_id long, frame_id long, t_us long"), held, 2.0, "1 hour"), joined, join)
    batch = open_frames(spark.createDataFrame(frames, "trap_id long, frame_id long, t_us long"), judged, WHOLE)
    assert sorted(map(tuple, spark.read.parquet(joined).collect())) == sorted(map(tuple, batch.select(*spark.read.parquet(joined).columns).collect()))


def test_latest_frames_of_polls_and_their_state(spark, tmp_path):
    schema = "trap_id long, frame_id long, t_us long"
    rows = [(i % 2, i, i * 700_000) for i in range(90)]
    folder, table, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    write_parts(spark, shaken(rows, 9, 2), schema, folder, 4)
    run_with_beat(spark, lambda beats: latest_frame_stream(stream(spark, folder, schema), 2.5, beats=beats), table, state)
    batch = latest_frames(spark.createDataFrame(rows, schema), 2_500_000)
    columns = ["trap_id", "poll", "frame_id", "t_us"]
    assert sorted(map(tuple, spark.read.parquet(table).select(*columns).collect())) == sorted(map(tuple, batch.select(*columns).collect()))
    assert spark.read.format("statestore").load(state).count() == 0


def test_state_of_earlier_batches_and_its_changes(spark, tmp_path):
    folder, table, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    rows = [(1, i, 0, i * 20 * S, "fox", S, 5 * S, False) for i in range(1, 5)]
    write_parts(spark, rows, GATE_SCHEMA, folder, 4)
    run(gate_stream(stream(spark, folder, GATE_SCHEMA)), table, state)
    history = {}
    for r in deadline_history(spark, state).collect():
        history.setdefault(r.batch_id, []).append((r.trap_id, r.last_us))
    # a row is judged when the watermark has passed it, ten seconds behind the newest one
    assert committed(spark, state)[-1] in history and len(history) >= 3
    times = [history[b][0][1] for b in sorted(history)]
    assert times == sorted(times) and times[-1] == 60 * S and set(times) <= {20 * S, 40 * S, 60 * S}
    changes = [(r.change_type, r.trap_id, r.last_us) for r in deadline_changes(spark, state).orderBy("batch_id").collect()]
    assert [c for c in changes if c[0] == "update"] == changes and {c[2] for c in changes} == {20 * S, 40 * S, 60 * S}


@pytest.fixture
def many_files(spark, tmp_path, monkeypatch):
    """Events of two traps whose tables get a file per task, and the folders that a query makes."""
    start = "timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, id * 20)"
    spark.range(60).selectExpr(
        "id AS event_id", f"{start} AS ts", "id % 9 AS user_id", "'click' AS event_type", "90D AS value", "'{\"k\": 1}' AS props"
    ).write.parquet(str(tmp_path / "events.parquet"))
    made, fresh = {}, streams.fresh_dir
    monkeypatch.setattr(streams, "fresh_dir", lambda session, name: made.setdefault(name, fresh(session, name)))
    before = {name: spark.conf.get(name) for name in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield str(tmp_path), made
    for name, value in before.items():
        spark.conf.set(name, value)


def test_batches_of_the_counter_do_not_grow_with_files(spark, many_files):
    folder, made = many_files
    found = streams.counter(spark, folder).collect()
    assert sum(r.n for r in found) == spark.read.parquet(made["gate"]).where("ok").count() > 9
    assert 1 < len(committed(spark, made["counter-state"])) <= streams.BATCHES + 1


def test_batches_of_repeated_photos_do_not_grow_with_files(spark, many_files):
    folder, made = many_files
    found = streams.photos_once(spark, folder)
    assert 2 * found.count() == spark.read.parquet(made["fired"]).count() > 18
    assert 2 <= len(committed(spark, made["photos-state"])) <= 4


def test_timers_of_a_trap_do_not_grow_with_its_species(spark, tmp_path):
    """A trap whose cooldowns have all passed leaves no timer and no row of state but its deadlines."""
    rows = [(1, i, 0, i * 40 * S, f"species-{i}", S, 20 * S, False) for i in range(30)]
    folder, table, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    write_parts(spark, rows, GATE_SCHEMA, folder, 1)
    run(gate_stream(stream(spark, folder, GATE_SCHEMA)), table, state)
    # the newest row waits; nothing of the others' cooldowns is left, nor a timer for each
    assert stored(spark, state, "cooldowns").count() == 0
    timers = spark.read.format("statestore").option("readRegisteredTimers", "true").load(state)
    assert timers.count() == 1 and spark.read.parquet(table).count() == 29


@pytest.mark.parametrize("limit", [1, 4096])
def test_due_rows_are_sorted_on_disk_and_waiting_ones_in_blocks(spark, tmp_path, monkeypatch, limit):
    monkeypatch.setattr(ordered, "SORT_MB", limit)
    rows = shaken([(1, i, i // 3 * S, [{"det_idx": 0, "label": "fox"}]) for i in range(2400)], 5000, 2)
    schema = "trap_id long, frame_id long, t_us long, boxes array<struct<det_idx:long,label:string>>"
    folder, table, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    write_parts(spark, rows, "trap_id, frame_id, t_us, boxes", folder, 1)
    run(boxcache.cached_box_stream(stream(spark, folder, schema), 1.0), table, state)
    left = 2400 - spark.read.parquet(table).count() - 3
    assert 0 < stored(spark, state, "waiting").count() < left
    run_with_beat(spark, lambda beats: boxcache.cached_box_stream(stream(spark, folder, schema), 1.0, beats=beats), table + "2", state + "2")
    got = sorted((r.frame_id, r.set_frame_id) for r in spark.read.parquet(table + "2").collect())
    assert got == [(i, i // 3 * 3 - 1) for i in range(3, 2400)]


def test_groups_of_traps_share_state_and_timers(spark, tmp_path):
    """Many traps in few groups: verdicts as by trap, and calls by group, of which waiting rows and timers tell."""
    rows = shaken(crowded(7, 900, 0.02, traps=45), 9, 3)
    folder, table, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    write_parts(spark, rows, GATE_SCHEMA, folder, 3)
    run(gate_stream(stream(spark, folder, GATE_SCHEMA), groups=3), table, state)
    waiting = stored(spark, state, "waiting").select("key.*").distinct().count()
    timers = spark.read.format("statestore").option("readRegisteredTimers", "true").load(state).select("key.*").distinct().count()
    assert 0 < waiting <= 3 and 0 < timers <= 3
    assert read_deadlines(spark, state).count() > 3 and read_cooldowns(spark, state).groupBy("trap_id").count().count() > 3
    run_with_beat(spark, lambda beats: gate_stream(stream(spark, folder, GATE_SCHEMA), beats=beats, groups=3), table + "2", state + "2")
    got = spark.read.parquet(table + "2")
    assert verdicts_of(got) == verdicts_of(gate(spark.createDataFrame(rows, GATE_SCHEMA), WHOLE)) and got.count() == len(rows)


def test_texts_and_nulls_pass_through_waiting_rows(spark, tmp_path):
    schema = GATE_SCHEMA + ", note string"
    notes = ['"', "\\", "a,b]", "\n\t", "é\U0001f600", "null", "", None]
    rows = [(2**53 + 1, 2**60 + i, i, i * S, None if i % 3 == 0 else 'k"\\' + str(i % 2), S, 2 * S, False, n) for i, n in enumerate(notes)]
    folder, table, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    write_parts(spark, rows, schema, folder, 2)
    run_with_beat(spark, lambda beats: gate_stream(stream(spark, folder, schema), beats=beats), table, state)
    got = spark.read.parquet(table).select(*(c.split()[0] for c in schema.split(", "))).collect()
    assert sorted(map(tuple, got), key=lambda r: r[2]) == rows
