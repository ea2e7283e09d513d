import random

from pyspark.sql import functions as F

from latchflow.functions.boxes import annotation, crop
from latchflow.functions.labels import cooldown_key, label_slug
from latchflow.functions.numbers import fixed2, shortest, t_us


def test_labels(spark):
    cases = [
        (None, "", "unknown"),
        ("", "", "unknown"),
        ("   ", "", ""),
        (" Blue-Bird x ", "blue_bird_x", "blue_bird_x"),
        ("\t Fox", "fox", "fox"),
        ("a\tb", "a\tb", "a\tb"),
        (" 　\x1cOwl\x85", "owl", "owl"),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, s string")
    got = df.select("i", label_slug(F.col("s")).alias("slug"), cooldown_key(F.col("s")).alias("key"))
    assert [(r.slug, r.key) for r in got.orderBy("i").collect()] == [c[1:] for c in cases]


def test_two_decimals_agree_with_c_formatting(spark):
    rng = random.Random(5)
    values = [0.0, 0.005, 0.015, 0.125, 0.145, 0.375, 0.615, 0.625, 0.995, 0.999, 1.0, 2.675, 36000.125]
    values += [rng.random() for _ in range(3000)] + [rng.randrange(10**9) / 1000 for _ in range(3000)]
    values += [rng.randrange(4000) / 8 for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert [r[0] for r in df.select(fixed2(F.col("x"))).collect()] == [f"{v:.2f}" for v in values]


def test_shortest_number_text(spark):
    values = [0.0, 1.2, 8.0, 0.0005, 0.00012, 43200.0, 12345678.0, 12345678.25, 0.1]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert [r[0] for r in df.select(shortest(F.col("x"))).collect()] == [repr(v) for v in values]


def test_crop(spark):
    boxes = [
        ((-10, 5, 50, 60), (0, 5, 50, 60, False)),
        ((600, 5, 700, 60), (600, 5, 640, 60, False)),
        ((30, 30, 30, 60), (0, 0, 640, 480, True)),
        ((-50, 5, -10, 60), (0, 0, 640, 480, True)),
        ((10, 470, 20, 900), (10, 470, 20, 480, False)),
    ]
    df = spark.createDataFrame([b[0] for b in boxes], "x1 int, y1 int, x2 int, y2 int")
    c = crop(*(F.col(n) for n in ("x1", "y1", "x2", "y2")), F.lit(640), F.lit(480))
    assert [tuple(r[0]) for r in df.select(c).collect()] == [b[1] for b in boxes]


def test_annotation(spark):
    df = spark.createDataFrame([("fox", 0.615, True, 5, 3), ("fox", 0.5, False, 7, 50)],
                               "label string, conf double, moved boolean, x1 int, y1 int")
    cells = [F.col(c) for c in ("label", "conf", "moved", "x1", "y1")]
    got = [tuple(r[0]) for r in df.select(annotation(*cells)).collect()]
    assert got == [("fox 0.61 [TRIG]", 0, 255, 0, 5, 0), ("fox 0.50", 0, 128, 255, 7, 44)]


def test_times_without_a_zone_do_not_follow_the_session(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    rows = spark.createDataFrame([("2024-03-10 02:30:00.123456",), ("1969-12-31 23:59:59.999999",), ("2024-11-03 01:30:00",), (None,)], "s string")
    try:
        for zone in ("UTC", "America/New_York", "Asia/Kathmandu"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            got = [r[0] for r in rows.select(t_us(F.col("s").cast("timestamp_ntz"))).collect()]
            assert got == [1_710_037_800_123_456, -1, 1_730_597_400_000_000, None]
            zoned = rows.limit(1).select(t_us(F.timestamp_micros(F.lit(77).cast("long")))).collect()
            assert zoned[0][0] == 77
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
