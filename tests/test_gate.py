import random

import pytest

from helpers import GATE_SCHEMA, WHOLE, S, gate_by_hand, verdicts_of
from latchflow.operators.door import blockers
from latchflow.operators.gate import _FIRST, CHUNK, candidates, decisions, gate, quiet_chunks
from latchflow.operators.policy import with_policy
from latchflow.operators.slices import measure
from latchflow.sources.settings import settings_from_text

INTER = 1.5


def test_edges(spark):
    rows = [
        # trap 1: two boxes in a frame, then equality with busy_until and cooldown_until
        (1, 1, 0, 0, "fox", 2 * S, 8 * S, False),
        (1, 1, 1, 0, "owl", 2 * S, 8 * S, False),
        (1, 2, 0, 3_499_999, "owl", 2 * S, 8 * S, False),
        (1, 3, 0, 3_500_000, "owl", 2 * S, 8 * S, False),
        (1, 4, 0, 7_999_999, "fox", 2 * S, 8 * S, False),
        (1, 5, 0, 8_000_000, "fox", 2 * S, 8 * S, False),
        # trap 2, same instants: own state
        (2, 1, 0, 0, "fox", 1 * S, 9 * S, False),
        # trap 3: a forced row inside the busy window brings the deadlines forward
        (3, 1, 0, 0, "fox", 60 * S, 60 * S, False),
        (3, 2, 0, 1 * S, "fox", 1 * S, 2 * S, True),
        (3, 3, 0, 3_500_000, "fox", 1 * S, 2 * S, False),
    ]
    got = verdicts_of(gate(spark.createDataFrame(rows, GATE_SCHEMA), WHOLE, INTER))
    assert got == gate_by_hand(rows, 1_500_000)
    assert got[(1, 1, 1)][0] == "global_busy" and got[(1, 3, 0)][0] == "ok"
    assert got[(1, 4, 0)][0] == "species_cooldown" and got[(1, 5, 0)][0] == "ok"
    assert got[(3, 3, 0)][0] == "ok"


def crowded(seed, n, forced=0.0, traps=1, span=4000):
    """Dense rows, two thirds of them on trap 0, several per instant."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        trap = 0 if traps == 1 or rng.random() < 0.66 else rng.randrange(1, traps)
        t = rng.randrange(span) * 500_000
        key = rng.choice("abcde")
        hold, cooldown = rng.choice([(1, 5), (2, 30), (0.5, 8)])
        rows.append((trap, t // 500_000, i, t, key, int(hold * S), cooldown * S, rng.random() < forced))
    return rows


@pytest.mark.parametrize("rows_per_slice, forced", [(None, 0.0), (400, 0.0), (50, 0.02), (5, 0.0)])
def test_equals_plain_loop(spark, slice_rows, rows_per_slice, forced):
    rows = crowded(7, 2000, forced, traps=6)
    df = spark.createDataFrame(rows, GATE_SCHEMA).repartition(5)
    if rows_per_slice:
        slice_rows(rows_per_slice)
    layout = measure(df)
    assert bool(layout.hot) == bool(rows_per_slice)
    assert verdicts_of(gate(df, layout, INTER)) == gate_by_hand(rows, 1_500_000)


def test_spacing_and_blockers(spark, slice_rows):
    rows = crowded(11, 1500, traps=4)
    df = spark.createDataFrame(rows, GATE_SCHEMA)
    slice_rows(100)
    layout = measure(df)
    judged = gate(df, layout, INTER)
    fired = sorted((r for r in judged.where("ok").collect()), key=lambda r: (r.trap_id, r.t_us, r.det_idx))
    last = {}
    for r in fired:
        before = last.get(r.trap_id)
        assert before is None or r.t_us >= before.busy_until_us
        same = last.get((r.trap_id, r.cooldown_key))
        assert same is None or r.t_us >= same.cooldown_until_us
        last[r.trap_id] = last[(r.trap_id, r.cooldown_key)] = r
    ends = {(r.trap_id, r.t_us): r for r in fired}
    blocked = blockers(judged, layout).collect()
    assert len(blocked) == len(rows) - len(fired)
    for r in blocked:
        cause = ends[(r.trap_id, r.blocker_us)]
        if r.reason == "global_busy":
            assert cause.busy_until_us - r.t_us == r.busy_left_us
        else:
            assert cause.cooldown_key == r.cooldown_key
            assert cause.cooldown_until_us - r.t_us == r.species_left_us


def test_decisions(spark):
    cfg = '{"bird": {"open_duration": 1.1, "cooldown_duration": 9.5, "confidence_threshold": 0.5}, "squirrel": {"open_duration": 0}}'
    rows = [
        (1, 1, 0, 0, "bluebird", 0.5, False),
        (1, 2, 0, 3 * S, "bird", 0.9, False),
        (1, 3, 0, 6 * S, "Blue Bird", 0.9, False),
        (1, 4, 0, 9 * S, "bluebird", 0.9, False),
        (1, 5, 0, 9 * S, "bluebird", 0.49, False),
        (1, 6, 0, 9 * S, "squirrel", 0.99, False),
        (1, 7, 0, 9 * S, "squirrel", 0.3, False),
        (1, 8, 0, 9 * S, "squirrel", 0.3, True),
    ]
    df = spark.createDataFrame(rows, "trap_id long, frame_id long, det_idx long, t_us long, label string, conf double, force boolean")
    got = decisions(with_policy(df, settings_from_text(spark, cfg)), WHOLE).collect()
    assert [r.decision for r in sorted(got, key=lambda r: r.frame_id)] == [
        # one policy, but a cooldown for each label
        "triggered", "triggered", "triggered", "species_cooldown", "low_conf", "disabled",
        "below_global_conf", "triggered",
    ]


def test_only_candidates_are_shuffled(spark):
    df = spark.createDataFrame([(1, 1, 0, 0, "x", 0.5, False)], "trap_id long, frame_id long, det_idx long, t_us long, label string, conf double, force boolean")
    resolved = with_policy(df, settings_from_text(spark, "{}"))
    plan = gate(candidates(resolved), WHOLE)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning") == 1 and plan.index("Filter") > plan.index("Exchange")


def jobs_of(spark, name, build):
    """Result of a query and the number of jobs it took."""
    spark.sparkContext.setJobGroup(name, name)
    try:
        found = build()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return found, len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def test_a_hot_trap_takes_as_many_jobs_however_many_slices_it_has(spark, slice_rows):
    # groups of rows with a quiet time between them, so a trap has many chunks
    rng = random.Random(1)
    rows = [(0, i, 0, (i // 8) * 60 * S + rng.randrange(20) * S, rng.choice("ab"), S, 9 * S, i % 50 == 0) for i in range(1600)]
    df = spark.createDataFrame(rows, GATE_SCHEMA).repartition(4).checkpoint()
    want, counted = gate_by_hand(rows, 1_500_000), set()
    for limit in (160, 40):
        slice_rows(limit)
        layout = measure(df)
        assert len(layout.hot[(0,)]) >= 1600 // limit - 1
        got, jobs = jobs_of(spark, f"gate-{limit}", lambda layout=layout: verdicts_of(gate(df, layout, INTER)))
        assert got == want
        counted.add(jobs)
    assert len(counted) == 1, counted


def test_chunks_start_where_nothing_is_pending(spark, slice_rows):
    rows = crowded(3, 1200, 0.02, span=40_000)
    slice_rows(60)
    df = spark.createDataFrame(rows, GATE_SCHEMA)
    chunks = {(r.trap_id, r.frame_id, r.det_idx): r[CHUNK] for r in quiet_chunks(df, measure(df), 1_500_000).collect()}
    reach, start = None, None
    for r in sorted(rows, key=lambda r: (r[3], r[1], r[2])):
        if reach is None or r[3] >= reach:
            start = _FIRST if reach is None else r[3]
        assert chunks[(r[0], r[1], r[2])] == start
        reach = max(reach or 0, r[3] + max(r[5] + 1_500_000, r[6]))
    assert len(set(chunks.values())) > 20
