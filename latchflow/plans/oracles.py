"""The queries again, as SQL over the same tables, written from the rules and not from the code."""

from __future__ import annotations

import re

from latchflow.plans import fleet

K = "CAST(regexp_extract(props, '[0-9]+') AS INTEGER)"
LABELS = fleet.NAMES
HOUR_US = 3_600_000_000
INTER_US = 5_400_000_000

POLICY_ROWS = ", ".join(
    f"('{n}', {int(h * HOUR_US)}, {int(c * HOUR_US)}, CAST({m} AS DOUBLE))"
    for n, (h, c, m) in fleet.POLICIES.items()
)


DAY = ("epoch_us(date_trunc('day', ts))", "epoch_us(date_trunc('day', ts)) // 86400000000")


def det(forced: bool = False, lost: str = "FALSE", at: tuple[str, str] = ("epoch_us(ts)", "event_id")) -> str:
    force = f"{K} = 7" if forced else "FALSE"
    return f"""
det AS (
  SELECT user_id AS trap_id, 'session_' || (user_id % 4) AS session_key, {at[1]} AS frame_id,
         event_id AS det_idx, {at[0]} AS t_us, event_type AS label,
         least(CAST(1 AS DOUBLE), value / 100) AS conf,
         CAST((event_id * 37) % 700 - 30 AS INTEGER) AS x1,
         CAST((event_id * 53) % 520 - 20 AS INTEGER) AS y1,
         CAST((event_id * 37) % 700 - 10 + (event_id * 17) % 200 AS INTEGER) AS x2,
         CAST((event_id * 53) % 520 + (event_id * 29) % 160 AS INTEGER) AS y2,
         640 AS width, 480 AS height, {K} AS k, {force} AS force
  FROM events),
pol(label, open_us, cd_us, min_conf) AS (VALUES {POLICY_ROWS}),
pdet AS (
  SELECT det.*, open_us, cd_us, min_conf,
         conf >= CAST(0.1 AS DOUBLE) AND open_us > 0 AND conf >= min_conf AS eligible
  FROM det JOIN pol USING (label)),
cand AS (
  SELECT *, row_number() OVER (PARTITION BY trap_id ORDER BY t_us, frame_id, det_idx) AS rn
  FROM pdet WHERE (eligible OR force) AND NOT ({lost}))"""


def gate(forced: bool = False, lost: str = "FALSE", at: tuple[str, str] = ("epoch_us(ts)", "event_id"), source: str = "") -> str:
    ready = " ".join(f"WHEN '{n}' THEN g.cd_{n}" for n in LABELS)
    start = ", ".join(
        f"CASE WHEN label = '{n}' THEN t_us + cd_us END AS cd_{n}" for n in LABELS
    )
    carry = ", ".join(f"g.cd_{n}" for n in LABELS)
    update = ", ".join(
        f"CASE WHEN reason = 'ok' AND label = '{n}' THEN t_us + cd_us ELSE cd_{n} END" for n in LABELS
    )
    return f"""
WITH RECURSIVE {source or det(forced, lost, at)},
g AS (
  SELECT trap_id, rn, 'first_trigger' AS reason, CAST(0 AS BIGINT) AS species_left_us,
         CAST(0 AS BIGINT) AS busy_left_us, t_us + open_us + {INTER_US} AS busy, {start}
  FROM cand WHERE rn = 1
  UNION ALL
  SELECT trap_id, rn, reason,
         CASE WHEN reason = 'species_cooldown' THEN ready - t_us ELSE 0 END,
         CASE WHEN reason = 'global_busy' THEN busy - t_us ELSE 0 END,
         CASE WHEN reason = 'ok' THEN t_us + open_us + {INTER_US} ELSE busy END, {update}
  FROM (
    SELECT n.*, CASE WHEN force THEN 'ok' WHEN t_us < busy THEN 'global_busy'
                     WHEN t_us < ready THEN 'species_cooldown' ELSE 'ok' END AS reason
    FROM (
      SELECT c.*, g.busy, CASE c.label {ready} END AS ready, {carry}
      FROM g JOIN cand c ON c.trap_id = g.trap_id AND c.rn = g.rn + 1) n) s),
judged AS (
  SELECT c.*, g.reason, g.reason IN ('ok', 'first_trigger') AS ok, g.species_left_us, g.busy_left_us
  FROM cand c JOIN g USING (trap_id, rn)),
fired AS (
  SELECT *, t_us + open_us AS hold_until_us, t_us + open_us + {INTER_US} AS busy_until_us,
         t_us + cd_us AS cooldown_until_us
  FROM judged WHERE ok)"""


VERDICT = f"""trap_id, frame_id, det_idx, t_us, ok, reason, species_left_us, busy_left_us,
  CASE WHEN ok THEN t_us + open_us END AS hold_until_us,
  CASE WHEN ok THEN t_us + open_us + {INTER_US} END AS busy_until_us,
  CASE WHEN ok THEN t_us + cd_us END AS cooldown_until_us"""

# Stragglers come after all others; those a day behind the newest of these are late.
LATE = """(k = 7 AND t_us // 1000 <
  (SELECT max(t_us) // 1000 - 86400000 FROM pdet p WHERE (p.eligible OR p.force) AND p.k <> 7))"""
K_KEPT = "k % 10 <> 3"

SECONDS = "CAST({0} / 1000000 AS VARCHAR)"

LINES = """
lines AS (
  SELECT trap_id, frame_id, det_idx, t_us, 'key' AS level,
         '[TRIG] ' || label || ' conf=' || format('{:.2f}', conf) || ' open='
         || CAST(open_us / 1000000 AS VARCHAR) || 's cd=' || CAST(cd_us / 1000000 AS VARCHAR) || 's' AS line
  FROM judged WHERE ok
  UNION ALL
  SELECT trap_id, frame_id, det_idx, t_us, 'key',
         '[PHOTO] ' || label || ' bbox=(' || x1 || ',' || y1 || ',' || x2 || ',' || y2 || ')'
  FROM judged WHERE ok
  UNION ALL
  SELECT trap_id, frame_id, det_idx, t_us, 'debug',
         '[BLOCK] ' || label || CASE reason
           WHEN 'species_cooldown' THEN ' species_cd ' || format('{:.2f}', species_left_us / 1000000) || 's'
           ELSE ' busy ' || format('{:.2f}', busy_left_us / 1000000) || 's' END
  FROM judged WHERE NOT ok)"""

CROP = """
  CASE WHEN whole THEN 0 ELSE l END AS crop_x1, CASE WHEN whole THEN 0 ELSE t END AS crop_y1,
  CASE WHEN whole THEN width ELSE r END AS crop_x2, CASE WHEN whole THEN height ELSE b END AS crop_y2,
  whole AS whole_frame"""


def crops(source: str) -> str:
    return f"""(
  SELECT *, r <= l OR b <= t AS whole FROM (
    SELECT *, greatest(0, x1) AS l, greatest(0, y1) AS t, least(width, x2) AS r, least(height, y2) AS b
    FROM {source}))"""


FRAMES = f"""
frames AS (
  SELECT user_id % {fleet.CAMERAS} AS trap_id, event_id AS frame_id, epoch_us(ts) AS t_us,
         CASE WHEN {K} < 5 THEN 0 ELSE 1000 + (event_id * 7919) % 90000 END AS dt_us
  FROM events WHERE {K} < 97)"""

NAME_CASE = " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(LABELS))

BOXES = f"""
boxes AS (
  SELECT user_id % {fleet.CAMERAS} AS trap_id, event_id AS frame_id, i AS det_idx, epoch_us(ts) AS t_us,
         CAST((event_id + i * 3) % 7 - 1 AS INTEGER) AS class_id,
         ((event_id * 31 + i * 17) % 100) / 100 AS conf,
         CAST(trunc(fx) AS INTEGER) AS x1, CAST(trunc(fy) AS INTEGER) AS y1,
         CAST(trunc(fx + 20 + (event_id * 17 + i) % 200) AS INTEGER) AS x2,
         CAST(trunc(fy + 20 + (event_id * 29 + i) % 160) AS INTEGER) AS y2,
         CASE (event_id + i * 3) % 7 - 1 {NAME_CASE}
              ELSE 'class_' || ((event_id + i * 3) % 7 - 1) END AS label
  FROM (SELECT *, CAST((event_id * 37 + i * 101) % 700 - 30 AS DOUBLE) + (event_id % 10) / 10 AS fx,
               CAST((event_id * 53 + i * 71) % 520 - 20 AS DOUBLE) + (event_id % 7) / 8 AS fy
        FROM (SELECT events.*, unnest(range({K} % 4)) AS i FROM events WHERE {K} < 97)))"""

MESSY = f"""
messy AS (
  SELECT event_id, CASE
    WHEN k < 20 THEN event_type
    WHEN k < 35 THEN chr(9) || '  ' || upper(event_type) || '  '
    WHEN k < 50 THEN event_type || ' Fast-Mover'
    WHEN k < 60 THEN 'Blue-Bird'
    WHEN k < 70 THEN 'grey squirrel'
    WHEN k < 78 THEN upper(event_type[1]) || event_type[2:]
    WHEN k < 84 THEN '   '
    WHEN k < 92 THEN '' END AS label
  FROM (SELECT *, {K} AS k FROM events)),
slugged AS (
  SELECT event_id, label, trim(coalesce(label, ''), chr(9) || ' ') AS raw,
         replace(replace(lower(trim(coalesce(label, ''), chr(9) || ' ')), ' ', '_'), '-', '_') AS slug
  FROM messy)"""

CASCADE = """
cfg(key, o, c, m) AS (VALUES ('_default', 1.75, 9.0, 0.4), ('bird', 2.25, 11.0, 0.55),
  ('squirrel', 0.0, NULL, NULL), ('click', NULL, NULL, NULL), ('Purchase', 2.5, NULL, NULL),
  ('view-fast-mover', NULL, 12.5, 0.25), ('critter', 0.75, 4.0, NULL)),
resolved AS (
  SELECT s.event_id, v.variant, CASE
      WHEN a.key IS NOT NULL THEN 'raw' WHEN b.key IS NOT NULL THEN 'slug'
      WHEN d.key IS NOT NULL THEN 'hyphen' WHEN contains(slug, 'bird') THEN 'contains_bird'
      WHEN contains(slug, 'squirrel') THEN 'contains_squirrel'
      WHEN v.variant = 'caught' THEN 'critter' ELSE 'default' END AS matched_rule,
    CASE WHEN a.key IS NOT NULL THEN a.key WHEN b.key IS NOT NULL THEN b.key
      WHEN d.key IS NOT NULL THEN d.key WHEN contains(slug, 'bird') THEN 'bird'
      WHEN contains(slug, 'squirrel') THEN 'squirrel'
      WHEN v.variant = 'caught' THEN 'critter' ELSE '_default' END AS policy_key
  FROM slugged s CROSS JOIN (VALUES ('plain'), ('caught')) v(variant)
  LEFT JOIN cfg a ON a.key = s.raw LEFT JOIN cfg b ON b.key = s.slug
  LEFT JOIN cfg d ON d.key = replace(s.slug, '_', '-'))"""


def throttle(source: str, keep: str, start: str = "TRUE", tag: str = "") -> str:
    """Step through numbered rows; ``keep`` compares ``c.t_us`` with ``h.last``. ``tag`` tells two of them apart."""
    text = f"""
num AS (SELECT *, row_number() OVER (PARTITION BY trap_id ORDER BY t_us, frame_id) AS step FROM {source}),
h AS (
  SELECT trap_id, step, t_us AS last, {start} AS kept FROM num WHERE step = 1
  UNION ALL
  SELECT c.trap_id, c.step, CASE WHEN {keep} THEN c.t_us ELSE h.last END, {keep}
  FROM h JOIN num c ON c.trap_id = h.trap_id AND c.step = h.step + 1),
thrown AS (SELECT num.* FROM num JOIN h USING (trap_id, step) WHERE kept)"""
    return re.sub(r"\b(num|h|thrown)\b", rf"\1{tag}", text) if tag else text


FPS_CAP = "(c.t_us - h.last) * CAST(0.001 AS DOUBLE) >= 1000000"

ROLLING = """
sampled AS (
  SELECT trap_id, frame_id, t_us,
         avg(1000000.0::DOUBLE / dt_us) OVER (PARTITION BY trap_id ORDER BY t_us, frame_id
             ROWS BETWEEN 119 PRECEDING AND CURRENT ROW) AS fps_avg
  FROM frames WHERE dt_us > 0)"""

CACHED = """
sets AS (SELECT trap_id, frame_id AS set_frame_id, min(t_us) AS set_t_us FROM boxes GROUP BY ALL),
cached AS (
  SELECT f.trap_id, f.frame_id, s.set_frame_id, s.set_t_us, b.det_idx, b.label, b.x1, b.y1, b.x2, b.y2
  FROM frames f ASOF JOIN sets s ON f.trap_id = s.trap_id AND f.t_us > s.set_t_us
  JOIN boxes b ON b.trap_id = s.trap_id AND b.frame_id = s.set_frame_id
  WHERE f.t_us - s.set_t_us <= 7200000000)"""

# Boxes of every second frame within the rate cap, with the literal defaults for labels without a policy.
CAMERA = f"""{FRAMES}, {BOXES}, {throttle("frames", FPS_CAP, tag="_f")},
idx AS (SELECT trap_id, frame_id, row_number() OVER (PARTITION BY trap_id ORDER BY t_us, frame_id) AS frame_idx FROM thrown_f),
pol(label, open_us, cd_us, min_conf) AS (VALUES {POLICY_ROWS}),
cand AS (
  SELECT *, row_number() OVER (PARTITION BY trap_id ORDER BY t_us, frame_id, det_idx) AS rn
  FROM (SELECT boxes.*, 640 AS width, 480 AS height, FALSE AS force, coalesce(open_us, 1500000) AS open_us, coalesce(cd_us, 8000000) AS cd_us,
               coalesce(min_conf, CAST(0.1 AS DOUBLE)) AS min_conf
        FROM boxes JOIN idx USING (trap_id, frame_id) LEFT JOIN pol USING (label)
        WHERE frame_idx % 2 = 0 AND conf >= CAST(0.1 AS DOUBLE))
  WHERE open_us > 0 AND conf >= min_conf)"""

DECIDED = """
decided AS (
  SELECT trap_id, frame_id, det_idx, label, CASE WHEN ok THEN 'triggered' ELSE reason END AS decision,
         species_left_us, busy_left_us FROM judged
  UNION ALL
  SELECT trap_id, frame_id, det_idx, label,
         CASE WHEN conf < CAST(0.1 AS DOUBLE) THEN 'below_global_conf'
              WHEN open_us <= 0 THEN 'disabled' ELSE 'low_conf' END, 0, 0
  FROM pdet WHERE NOT eligible)"""

PRIOR = """
prior AS (
  SELECT *, lag(t_us) OVER s AS s_t, lag(cd_us) OVER s AS s_cd, lag(t_us) OVER a AS a_t, lag(open_us) OVER a AS a_open
  FROM fired WINDOW s AS (PARTITION BY trap_id, label ORDER BY t_us), a AS (PARTITION BY trap_id ORDER BY t_us))"""


def _settings_load() -> str:
    fields = ["open_duration", "cooldown_duration", "confidence_threshold"]
    defaults = ["1.5", "8.0", "0.45"]
    number = "TRY_CAST(json_extract_string(v, '$.{0}') AS DOUBLE)"
    columns = ", ".join(
        f"CASE WHEN bad THEN CAST({d} AS DOUBLE) WHEN obj THEN {number.format(f)} END AS {f}"
        for f, d in zip(fields, defaults)
    )
    broken = " OR ".join(
        f"(list_contains(json_keys(v), '{f}') AND {number.format(f)} IS NULL)" for f in fields
    )
    return f"""
WITH docs AS (
  SELECT event_id AS doc_id, CASE
    WHEN k < 50 THEN '{{"_default": {{"open_duration": 1.75, "cooldown_duration": 9, "confidence_threshold": 0.4}}, "'
      || event_type || '": {{"open_duration": ' || CAST(k / 4 AS VARCHAR) || ', "cooldown_duration": ' || k || '}}}}'
    WHEN k < 60 THEN '{{"_default": ' WHEN k < 70 THEN '[1, 2]'
    WHEN k < 80 THEN '{{"' || event_type || '": {{}}, "x": 5}}'
    WHEN k < 90 THEN '{{"' || event_type || '": {{"open_duration": null}}, "y": null}}'
    WHEN k < 92 THEN '{{"' || event_type || '": {{''open_duration'': 1}}}}'
    WHEN k < 94 THEN '{{"' || event_type || '": {{}}}} {{"x": {{}}}}'
    WHEN k < 96 THEN '{{"' || event_type || '": {{"open_duration": "null", "cooldown_duration": "4.5"}}}}'
    ELSE '{{}}' END AS t
  FROM (SELECT *, {K} AS k FROM events)),
typed AS (SELECT doc_id, t, CASE WHEN json_valid(t) THEN json_type(t) = 'OBJECT' ELSE FALSE END AS fine FROM docs),
entries AS (
  SELECT doc_id, FALSE AS bad, key, json_extract(t, '$."' || key || '"') AS v
  FROM (SELECT doc_id, t, unnest(json_keys(t)) AS key FROM typed WHERE fine)
  UNION ALL SELECT doc_id, TRUE, '_default', NULL FROM typed WHERE NOT fine),
kinds AS (SELECT *, coalesce(json_type(v) = 'OBJECT', FALSE) AS obj FROM entries)
SELECT doc_id, key, bad AS from_fallback, obj OR bad AS is_object, {columns},
       CASE WHEN obj THEN coalesce({broken}, FALSE) ELSE FALSE END AS bad_field
FROM kinds"""


def _trap_lines() -> str:
    return f"""
lines AS (
  SELECT user_id AS trap_id, event_id AS line_id, CASE WHEN {K} < 90
    THEN '[' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '] Trap triggered by ''' || event_type || '''. Open for '
         || (1 + {K} % 3) || 's, cooldown ' || ({K} * 600) || 's.'
    ELSE 'noise ' || event_type END AS line
  FROM events),
parsed AS (
  SELECT trap_id, line_id, starts_with(line, '[') AS matched,
    CASE WHEN starts_with(line, '[') THEN epoch_us(strptime(line[2:20], '%Y-%m-%d %H:%M:%S')) END AS log_us,
    nullif(regexp_extract(line, '''(.*)''', 1), '') AS label,
    TRY_CAST(regexp_extract(line, 'for ([0-9]+)s', 1) AS DOUBLE) AS open_s,
    TRY_CAST(regexp_extract(line, 'cooldown ([0-9]+)s', 1) AS DOUBLE) AS cooldown_s
  FROM lines)"""


def _console() -> str:
    """What each rendered form must parse to, straight from the values it was rendered with."""
    none = "CAST(NULL AS {0})"
    label = "CASE WHEN k % 2 = 0 THEN event_type ELSE 'big ' || event_type END"

    def when(kind: str, *cases: tuple[str, str]) -> str:
        return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in cases) + f" ELSE {none.format(kind)} END"

    corner = "k >= 55 AND k < 70"
    columns = {
        "tag": when("VARCHAR", ("k < 20", "'TRIG'"), ("k < 55", "'BLOCK'"), ("k < 70", "'PHOTO'"),
                    ("k < 85", "'FPS'"), ("k < 90", "'Start'"), ("k < 95", "'Firebase'")),
        "label": when("VARCHAR", ("k < 70", label)),
        "conf": when("DOUBLE", ("k < 20", "CAST('0.' || (k + 10) AS DOUBLE)")),
        "open_s": when("DOUBLE", ("k < 20", "k % 4 + 0.5")),
        "cd_s": when("DOUBLE", ("k < 20", "k")),
        "reason": when("VARCHAR", ("k < 20", "NULL"), ("k < 35", "'species_cooldown'"),
                       ("k < 50", "'global_busy'"), ("k < 55", "'hold'")),
        "left_s": when("DOUBLE", ("k < 20", "NULL"), ("k < 35", "k + 0.25"), ("k < 50", "k + 0.75")),
        "x1": when("INTEGER", (corner, "event_id % 50 - 25")),
        "y1": when("INTEGER", (corner, "event_id % 40")),
        "x2": when("INTEGER", (corner, "event_id % 50 + 60")),
        "y2": when("INTEGER", (corner, "event_id % 40 + 70")),
        "fps": when("DOUBLE", ("k >= 70 AND k < 80", "k + 0.5")),
        "message": when("VARCHAR", ("k >= 80 AND k < 85", "'no frames yet'"),
                        ("k >= 85 AND k < 90", "'model=a b.pt cam=640x480@MJPG conf=0.45 imgsz=' || (k * 4)"),
                        ("k >= 90 AND k < 95", "'log_event failed: code ' || k")),
    }
    kinds = {"conf": "DOUBLE", "open_s": "DOUBLE", "cd_s": "DOUBLE", "left_s": "DOUBLE", "fps": "DOUBLE",
             "x1": "INTEGER", "y1": "INTEGER", "x2": "INTEGER", "y2": "INTEGER"}
    body = ", ".join(f"CAST({v} AS {kinds.get(n, 'VARCHAR')}) AS {n}" for n, v in columns.items())
    return f"SELECT event_id AS line_id, {body} FROM (SELECT *, {K} AS k FROM events)"


def _suppressed() -> str:
    overlap = (
        "greatest(0, least(x2, n.x2) - greatest(x1, n.x1)) * greatest(0, least(y2, n.y2) - greatest(y1, n.y1))"
    )
    for c in ("x1", "y1", "x2", "y2"):
        overlap = overlap.replace(f"({c},", f"(b.{c},")
    box = "{'x1': c.x1, 'y1': c.y1, 'x2': c.x2, 'y2': c.y2}"
    first = box.replace("c.", "")
    hit = (
        f"len(list_filter(g.kept, lambda b: 2 * ({overlap.replace('n.', 'c.')}) > "
        "(b.x2 - b.x1) * (b.y2 - b.y1) + (c.x2 - c.x1) * (c.y2 - c.y1) "
        f"- ({overlap.replace('n.', 'c.')}))) > 0"
    )
    return f"""
WITH RECURSIVE raw AS (
  SELECT user_id % {fleet.CAMERAS} AS trap_id, CAST(epoch_us(ts) // 86400000000 AS BIGINT) AS frame_id, event_id AS det_idx,
         CAST(strpos('cepsv', event_type[1]) - 1 AS INTEGER) AS class_id, ((event_id * 31) % 1000) / 1000 AS conf,
         CAST((event_id * 37) % 60 AS INTEGER) AS x1, CAST((event_id * 53) % 50 AS INTEGER) AS y1,
         CAST((event_id * 37) % 60 + 40 + (event_id * 17) % 30 AS INTEGER) AS x2,
         CAST(CASE WHEN {K} = 3 THEN (event_id * 53) % 50
              ELSE (event_id * 53) % 50 + 40 + (event_id * 29) % 25 END AS INTEGER) AS y2
  FROM events),
num AS (SELECT *, row_number() OVER (PARTITION BY trap_id, frame_id, class_id ORDER BY conf DESC, det_idx) AS rn FROM raw),
g AS (
  SELECT trap_id, frame_id, class_id, rn, TRUE AS keep, [{first}] AS kept FROM num WHERE rn = 1
  UNION ALL
  SELECT c.trap_id, c.frame_id, c.class_id, c.rn, NOT ({hit}),
         CASE WHEN {hit} THEN g.kept ELSE list_append(g.kept, {box}) END
  FROM g JOIN num c ON c.trap_id = g.trap_id AND c.frame_id = g.frame_id AND c.class_id = g.class_id AND c.rn = g.rn + 1)
SELECT n.trap_id, n.frame_id, n.det_idx, n.class_id, n.x1, n.y1, n.x2, n.y2
FROM num n JOIN g USING (trap_id, frame_id, class_id, rn) WHERE keep"""


def _timeline() -> str:
    return f"""
{gate(True)},
led AS (SELECT *, lead(t_us) OVER (PARTITION BY trap_id ORDER BY t_us) AS next_us FROM fired),
ev AS (
  SELECT trap_id, min(t_us) AS at_us, 'init-closed' AS event, 0 AS kind FROM det GROUP BY trap_id
  UNION ALL SELECT trap_id, hold_until_us, 'auto-close', 1 FROM led WHERE next_us IS NULL OR next_us >= hold_until_us
  UNION ALL SELECT trap_id, t_us, 'trigger-open', 2 FROM led
  UNION ALL SELECT trap_id, t_us, CASE WHEN k < 13 THEN 'manual-open' ELSE 'manual-close' END, 3
  FROM det WHERE k BETWEEN 10 AND 15)
SELECT trap_id, at_us, event, CASE WHEN event LIKE '%-open' THEN 'open' ELSE 'closed' END AS door,
       lead(at_us) OVER (PARTITION BY trap_id ORDER BY at_us, kind) AS until_us
FROM ev"""


def build() -> dict[str, str]:
    ident = "trap_id, frame_id, det_idx"
    sql = {
        "src_detections": f"""WITH {det()} SELECT {ident}, session_key, t_us, label, round(conf, 6) AS conf
            FROM det WHERE k < 97""",
        "settings_load": _settings_load(),
        "traplog_parse": f"WITH {_trap_lines()} SELECT * FROM parsed",
        "consolelog_parse": _console(),
        "sink_trigger_events": f"""{gate()} SELECT {ident}, session_key,
            strftime(make_timestamp(t_us), '%Y-%m-%d') AS event_date, t_us, 'servo_trigger' AS event_type,
            label AS species, round(conf, 6) AS conf, cd_us / 1000000 AS cooldown, open_us / 1000000 AS open_dur
            FROM fired""",
        "photo_manifest": f"""{gate()} SELECT {ident}, session_key, t_us, label AS species, {CROP}
            FROM {crops("fired")}""",
        "log_lines_quiet": f"{gate()}, {LINES} SELECT * FROM lines WHERE level = 'key'",
        "explode_detections": f"WITH {BOXES} SELECT {ident}, class_id, round(conf, 6) AS conf FROM boxes",
        "box_trunc": f"WITH {BOXES} SELECT {ident}, x1, y1, x2, y2 FROM boxes",
        "conf_prefilter": f"""WITH {BOXES} SELECT {ident}, round(conf, 6) AS conf FROM boxes
            WHERE conf >= CAST(0.45 AS DOUBLE)""",
        "label_slug": f"WITH {MESSY} SELECT event_id, slug FROM slugged",
        "cooldown_key": f"""WITH {MESSY} SELECT event_id,
            CASE WHEN label IS NULL OR label = '' THEN 'unknown' ELSE slug END AS cooldown_key FROM slugged""",
        "policy_resolve": f"WITH {MESSY}, {CASCADE} SELECT * FROM resolved",
        "policy_fields": f"""WITH {MESSY}, {CASCADE} SELECT event_id, variant,
            CAST(coalesce(o, 1.5) AS DOUBLE) AS open_s, CAST(coalesce(c, 8.0) AS DOUBLE) AS cooldown_s,
            CAST(coalesce(m, 0.45) AS DOUBLE) AS min_conf FROM resolved LEFT JOIN cfg ON cfg.key = policy_key""",
        "eligible": f"""WITH {det()} SELECT {ident}, label, open_us / 1000000 AS open_s,
            cd_us / 1000000 AS cooldown_s, min_conf FROM pdet WHERE eligible""",
        "decisions": f"{gate()}, {DECIDED} SELECT * FROM decided",
        "every_n": f"""WITH RECURSIVE {FRAMES}, {throttle("frames", FPS_CAP)},
            idx AS (SELECT trap_id, frame_id,
              row_number() OVER (PARTITION BY trap_id ORDER BY t_us, frame_id) AS frame_idx FROM thrown)
            SELECT * FROM idx WHERE frame_idx % 3 = 0""",
        "crop_geometry": f"WITH {det()} SELECT {ident}, {CROP} FROM {crops('det')}",
        "annotations": f"""{gate()} SELECT {ident},
            label || ' ' || format('{{:.2f}}', conf) || CASE WHEN ok THEN ' [TRIG]' ELSE '' END AS caption,
            0 AS blue, CASE WHEN ok THEN 255 ELSE 128 END AS green, CASE WHEN ok THEN 0 ELSE 255 END AS red,
            x1 AS anchor_x, greatest(0, y1 - 6) AS anchor_y FROM judged""",
        "log_render": f"{gate()}, {LINES} SELECT * FROM lines",
        "class_lookup": f"WITH {BOXES} SELECT {ident}, class_id, label FROM boxes",
        "box_ttl_asof": f"""WITH {FRAMES}, {BOXES}, {CACHED}
            SELECT trap_id, frame_id, set_frame_id, set_t_us, det_idx, label, x1, y1 FROM cached""",
        "door_open_frames": f"""{gate()} SELECT f.trap_id, f.frame_id, f.t_us, g.t_us AS trigger_us,
            g.frame_id AS trigger_frame_id, g.hold_until_us
            FROM det f ASOF JOIN fired g ON f.trap_id = g.trap_id AND f.t_us >= g.t_us
            WHERE f.t_us < g.hold_until_us""",
        "auto_close_asof": f"""{gate(True)},
            led AS (SELECT *, lead(t_us) OVER (PARTITION BY trap_id ORDER BY t_us) AS next_us FROM fired)
            SELECT l.trap_id, l.frame_id AS trigger_frame_id, l.det_idx, l.t_us AS trigger_us, l.hold_until_us,
                   f.t_us AS close_us, f.frame_id AS close_frame_id
            FROM (SELECT * FROM led WHERE next_us IS NULL OR next_us >= hold_until_us) l
            ASOF LEFT JOIN det f ON f.trap_id = l.trap_id AND l.hold_until_us <= f.t_us""",
        "block_attribution": f"""{gate()},
            blocked AS (SELECT * FROM judged WHERE NOT ok)
            SELECT b.trap_id, b.frame_id, b.det_idx, b.t_us, b.label AS cooldown_key, b.reason,
                   b.species_left_us, b.busy_left_us, f.frame_id AS blocker_frame_id, f.t_us AS blocker_us
            FROM blocked b ASOF JOIN fired f ON b.trap_id = f.trap_id AND b.t_us > f.t_us
            WHERE b.reason = 'global_busy'
            UNION ALL
            SELECT b.trap_id, b.frame_id, b.det_idx, b.t_us, b.label, b.reason,
                   b.species_left_us, b.busy_left_us, f.frame_id, f.t_us
            FROM blocked b ASOF JOIN fired f ON b.trap_id = f.trap_id AND b.label = f.label AND b.t_us > f.t_us
            WHERE b.reason = 'species_cooldown'""",
        "species_counts": f"""{gate()} SELECT session_key, label AS species, count(*) AS n FROM fired GROUP BY ALL""",
        "decision_summary": f"""{gate()}, {DECIDED}
            SELECT trap_id, label AS cooldown_key, decision, count(*) AS n,
                   CAST(sum(species_left_us + busy_left_us) AS BIGINT) AS left_us FROM decided GROUP BY ALL
            UNION ALL SELECT NULL, NULL, decision, count(*),
                   CAST(sum(species_left_us + busy_left_us) AS BIGINT) FROM decided GROUP BY decision""",
        "fps_rolling": f"WITH {FRAMES}, {ROLLING} SELECT trap_id, frame_id, round(fps_avg, 6) AS fps_avg FROM sampled",
        "gate_state_asof": f"""{gate(True)},
            past AS (SELECT * FROM fired WHERE t_us <= {fleet.SNAPSHOT_US})
            SELECT trap_id, CAST(NULL AS VARCHAR) AS cooldown_key,
                   greatest(0, arg_max(hold_until_us, t_us) - {fleet.SNAPSHOT_US}) AS hold_left_us,
                   greatest(0, arg_max(busy_until_us, t_us) - {fleet.SNAPSHOT_US}) AS busy_left_us,
                   CAST(NULL AS BIGINT) AS cooldown_left_us FROM past GROUP BY trap_id
            UNION ALL
            SELECT trap_id, label, NULL, NULL, greatest(0, arg_max(cooldown_until_us, t_us) - {fleet.SNAPSHOT_US})
            FROM past GROUP BY trap_id, label""",
        "traplog_summary": f"""WITH {_trap_lines()},
            gaps AS (SELECT label, log_us - lag(log_us) OVER (PARTITION BY label ORDER BY log_us, line_id) AS gap
                     FROM parsed WHERE matched)
            SELECT label, count(*) AS n, min(gap) AS min_gap_us, max(gap) AS max_gap_us FROM gaps GROUP BY label""",
        "cooldown_compliance": f"""{gate(True)}, {PRIOR}
            SELECT {ident}, t_us - s_t AS species_gap_us, t_us - a_t AS trap_gap_us,
                   coalesce(t_us - s_t < s_cd, FALSE) AS cooldown_violation,
                   coalesce(t_us - a_t < a_open + {INTER_US}, FALSE) AS busy_violation FROM prior""",
        "latest_frame": f"""WITH {FRAMES} SELECT trap_id, t_us // 21600000000 AS poll,
            arg_max(frame_id, t_us) AS frame_id, max(t_us) AS t_us FROM frames GROUP BY 1, 2""",
        "overlay_union": f"""WITH {FRAMES}, {BOXES}, {CACHED}
            SELECT trap_id, frame_id, 'cached' AS source, det_idx, label, x1, y1, x2, y2 FROM cached
            UNION ALL SELECT trap_id, frame_id, 'current', det_idx, label, x1, y1, x2, y2 FROM boxes""",
        "gate_decisions": f"{gate()} SELECT {VERDICT} FROM judged",
        "gate_forced": f"{gate(True)} SELECT {VERDICT}, force FROM judged",
        "throttle_fps_cap": f"""WITH RECURSIVE {FRAMES}, {throttle("frames", FPS_CAP)}
            SELECT trap_id, frame_id, t_us FROM thrown""",
        "throttle_block_log": f"""{gate()}, {LINES}, blocked AS (SELECT * FROM lines WHERE level = 'debug'),
            {throttle("blocked", f"c.t_us - h.last >= {INTER_US}")}
            SELECT {ident}, t_us, line FROM thrown""",
        "fps_log_emit": f"""WITH RECURSIVE {FRAMES}, {ROLLING},
            {throttle("frames", "c.t_us - h.last >= 36000000000", "FALSE")}
            SELECT t.trap_id, t.frame_id, t.t_us, round(s.fps_avg, 6) AS fps_now,
                   CASE WHEN s.fps_avg IS NULL THEN '[FPS] no frames yet' ELSE '[FPS] avg=' || printf('%.2f', round(s.fps_avg, 6)) END AS line
            FROM thrown t ASOF LEFT JOIN sampled s ON s.trap_id = t.trap_id AND t.t_us >= s.t_us""",
        "door_timeline": _timeline(),
        "deadband_thin": f"""WITH RECURSIVE num AS (
              SELECT user_id AS trap_id, event_id AS frame_id, epoch_us(ts) AS t_us, value,
                     row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step FROM events),
            h AS (
              SELECT trap_id, frame_id, step, t_us AS last_t, value AS last_v, TRUE AS kept, t_us, value FROM num WHERE step = 1
              UNION ALL
              SELECT trap_id, frame_id, step, CASE WHEN k THEN t_us ELSE last_t END,
                     CASE WHEN k THEN value ELSE last_v END, k, t_us, value
              FROM (SELECT c.*, h.last_t, h.last_v,
                           abs(c.value - h.last_v) >= 60 OR c.t_us - h.last_t >= {12 * HOUR_US} AS k
                    FROM h JOIN num c ON c.trap_id = h.trap_id AND c.step = h.step + 1))
            SELECT trap_id, frame_id, t_us, value FROM h WHERE kept""",
        "box_nms": _suppressed(),
        "batch_inference": """WITH flat AS (
              SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
            centre AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS c FROM flat GROUP BY label, i),
            dist AS (SELECT vec_id, centre.label, sum((CAST(x AS DOUBLE) - c) * (CAST(x AS DOUBLE) - c)) AS d
                     FROM flat JOIN centre USING (i) GROUP BY vec_id, centre.label)
            SELECT vec_id, arg_min(label, d) AS class_id, 1 AS n_boxes FROM dist GROUP BY vec_id""",
        "gate_stream": f"{gate()} SELECT {VERDICT}, FALSE AS late FROM judged",
        "gate_state_store": f"""{gate()},
            trap AS (SELECT trap_id, max(t_us) AS last_us FROM cand GROUP BY trap_id),
            busy AS (SELECT trap_id, arg_max(busy_until_us, t_us) AS busy_until_us,
                     arg_max(hold_until_us, t_us) AS hold_until_us FROM fired GROUP BY trap_id),
            species AS (SELECT trap_id, label AS cooldown_key, arg_max(cooldown_until_us, t_us) AS until_us
                        FROM fired GROUP BY trap_id, label)
            SELECT * FROM species JOIN busy USING (trap_id) JOIN trap USING (trap_id)""",
        "box_ttl_stream": f"""WITH {FRAMES}, {BOXES}, {CACHED}
            SELECT trap_id, frame_id, set_frame_id, set_t_us, det_idx, label, x1, y1 FROM cached""",
        "trap_pipeline": f"""{gate(source=CAMERA)}, {LINES},
            blocked AS (SELECT * FROM lines WHERE level = 'debug'), {throttle("blocked", f"c.t_us - h.last >= {INTER_US}", tag="_b")}
            SELECT 'log' AS kind, {ident}, t_us, line AS text FROM lines WHERE level = 'key'
            UNION ALL SELECT 'log', {ident}, t_us, line FROM thrown_b
            UNION ALL SELECT 'event', {ident}, t_us, label FROM fired
            UNION ALL SELECT 'photo', {ident}, t_us, label FROM fired
            UNION ALL SELECT 'count', NULL, NULL, NULL, count(*), label FROM fired GROUP BY label""",
        "gate_multibox": f"{gate(at=DAY)} SELECT {VERDICT} FROM judged",
        "door_open_stream": f"""{gate()} SELECT f.trap_id, f.frame_id, f.t_us, g.t_us AS trigger_us,
            g.frame_id AS trigger_frame_id, g.hold_until_us
            FROM det f ASOF JOIN fired g ON f.trap_id = g.trap_id AND f.t_us >= g.t_us
            WHERE f.t_us < g.hold_until_us""",
        "latest_frame_stream": f"""WITH {FRAMES} SELECT trap_id, t_us // 21600000000 AS poll,
            arg_max(frame_id, t_us) AS frame_id, max(t_us) AS t_us FROM frames GROUP BY 1, 2""",
        "gate_late": f"""{gate(lost=LATE)} SELECT {VERDICT}, FALSE AS late FROM judged UNION ALL
            SELECT trap_id, frame_id, det_idx, t_us, NULL, NULL, NULL, NULL, NULL, NULL, NULL, TRUE FROM pdet
            WHERE (eligible OR force) AND {LATE}""",
        "auto_close_stream": f"""{gate()} SELECT trap_id, t_us AS trigger_us, hold_until_us FROM fired""",
        "counter_stream": f"{gate()} SELECT session_key, label AS species, count(*) AS n FROM fired GROUP BY ALL",
        "photo_stream": f"""{gate()} SELECT {ident}, session_key, t_us, label AS species, {CROP}
            FROM {crops("fired")}""",
        "sink_run_rewritten": f"""{gate()} SELECT run_id, {ident}, session_key, t_us, label AS species
            FROM fired, (VALUES ('first'), ('second=b')) runs(run_id) WHERE {K_KEPT}""",
        "stream_sinks": f"{gate()} SELECT session_key, label AS species, count(*) AS n FROM fired GROUP BY ALL",
    }
    return {name: " ".join(text.split("\n")) for name, text in sql.items()}
