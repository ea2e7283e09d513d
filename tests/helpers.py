"""Reference results in plain Python, for small fixtures."""

from latchflow.operators.slices import Layout

WHOLE = Layout(("trap_id",), "t_us")
S = 1_000_000

GATE_SCHEMA = (
    "trap_id long, frame_id long, det_idx long, t_us long, cooldown_key string, "
    "open_us long, cooldown_us long, force boolean"
)


def gate_by_hand(rows, inter_us):
    """Verdict per (trap, frame, det): plain loop over each trap's rows in order."""
    verdicts, busy, cooling = {}, {}, {}
    for trap, frame, det, t, key, hold, cooldown, force in sorted(
        rows, key=lambda r: (r[0], r[3], r[1], r[2])
    ):
        left_busy = max(0, busy[trap] - t) if trap in busy else 0
        left_key = max(0, cooling.get((trap, key), t) - t)
        if not force and left_busy > 0:
            verdict = ("global_busy", 0, left_busy)
        elif not force and left_key > 0:
            verdict = ("species_cooldown", left_key, 0)
        else:
            verdict = ("ok" if trap in busy else "first_trigger", 0, 0)
            busy[trap] = t + hold + inter_us
            cooling[(trap, key)] = t + cooldown
        verdicts[(trap, frame, det)] = verdict
    return verdicts


def verdicts_of(df):
    return {
        (r["trap_id"], r["frame_id"], r["det_idx"]): (r["reason"], r["species_left_us"], r["busy_left_us"])
        for r in df.collect()
    }
