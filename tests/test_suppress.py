"""Overlap suppression, folded and peeled, against a plain loop."""

import random

import pytest

from latchflow.operators.suppress import IMAGE, _same, suppress

BOXES = "trap_id long, frame_id long, class_id int, det_idx long, conf double, x1 int, y1 int, x2 int, y2 int, note string"


def by_hand(rows, num, den):
    kept, seen = [], set()
    images = {}
    for r in rows:
        images.setdefault(r[:3], []).append(r)
    for image, boxes in images.items():
        held = []
        for r in sorted(boxes, key=lambda r: (-r[4], r[3])):
            x1, y1, x2, y2 = r[5:9]
            if x2 <= x1 or y2 <= y1:
                kept.append(r)
                continue
            if (image, r[5:9]) in seen:
                continue
            seen.add((image, r[5:9]))
            area = (x2 - x1) * (y2 - y1)

            def shares(o):
                w, h = min(x2, o[7]) - max(x1, o[5]), min(y2, o[8]) - max(y1, o[6])
                inter = max(0, w) * max(0, h)
                return inter * den > num * (area + (o[7] - o[5]) * (o[8] - o[6]) - inter)

            if not any(shares(o) for o in held):
                held.append(r)
        kept += held
    return sorted(map(repr, kept))


def crowd(seed, n, images=2):
    dice = random.Random(seed)
    rows = []
    for i in range(n):
        x, y = dice.randrange(-60, 120), dice.randrange(-40, 90)
        w, h = dice.choice([(0, 9), (40, 40), (37, 45), (80, 75), (9, 150), (1, 1), (12, 13)])
        at = None if dice.random() < 0.05 else dice.randrange(images)
        rows.append((at, 7, dice.randrange(2), i, dice.randrange(60) / 64, x, y, x + w + dice.randrange(4), y + h + dice.randrange(4), f"n{i}"))
    return [*rows, *((*r[:3], 5000 + r[3], *r[4:]) for r in rows[:20])]


@pytest.mark.parametrize("limit, num, den", [(0.5, 1, 2), (0.3, 3, 10), (0.85, 17, 20), (1.0, 1, 1)])
@pytest.mark.parametrize("together", [10_000, 40, 0])
def test_equals_a_plain_loop(spark, limit, num, den, together):
    if together == 0 and limit != 0.5:
        pytest.skip("one share is enough where all is peeled")
    rows = crowd(3, 260)
    found = suppress(spark.createDataFrame(rows, BOXES).repartition(3), limit, together)
    assert found.columns == [c.split()[0] for c in BOXES.split(", ")]
    assert sorted(repr(tuple(r)) for r in found.collect()) == by_hand(rows, num, den)


def test_a_crowd_on_one_spot_is_peeled_in_one_round(spark):
    rows = [(1, 1, 0, i, i / 5000, i % 7, i % 5, 200 + i % 7, 200 + i % 5, "x") for i in range(4000)]
    found = suppress(spark.createDataFrame(rows, BOXES), together=5)
    assert [r.det_idx for r in found.collect()] == [3999]


def test_no_boxes_and_no_python(spark):
    empty = spark.createDataFrame([], BOXES)
    for together in (5, 128):
        found = suppress(empty, together=together)
        assert found.count() == 0
        plan = found._jdf.queryExecution().toString()
        assert "InArrow" not in plan and "EvalPython" not in plan
    with pytest.raises(ValueError):
        suppress(empty, 0.0)


def test_peeled_boxes_are_never_broadcast(spark):
    boxes = spark.createDataFrame([(1, None, 1, "a"), (2, 7, 1, "b")], "trap_id long, frame_id long, class_id int, note string")
    for how, notes in (("inner", ["a", "b"]), ("left_semi", ["a", "b"]), ("left_anti", [])):
        joined = _same(boxes, boxes.withColumnRenamed("note", "other"), IMAGE, how)
        assert sorted(r.note for r in joined.collect()) == notes
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
