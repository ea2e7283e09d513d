import json

import pytest
from pyspark.sql import functions as F

from latchflow.operators.policy import resolve, with_policy
from latchflow.sources.settings import checked, load_settings, parse_settings, settings_from_text

EXAMPLE = {
    "_default": {"open_duration": 2.75, "cooldown_duration": 6, "confidence_threshold": 0.35},
    "bird": {"open_duration": 0.9, "cooldown_duration": 14, "confidence_threshold": 0.6},
    "squirrel": {"open_duration": 0.0},
}


def labels(spark, *names):
    return spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, label string")


def rules(spark, settings, *names):
    got = resolve(labels(spark, *names), settings).orderBy("i").collect()
    return [(r["matched_rule"], r["policy_key"]) for r in got]


def text_settings(spark, cfg):
    return settings_from_text(spark, json.dumps(cfg))


def test_cascade(spark):
    got = rules(spark, text_settings(spark, EXAMPLE), "bird", "  BIRD ", "Blue-Bird", "grey squirrel", "cat", None, "")
    assert got == [
        ("raw", "bird"), ("slug", "bird"), ("contains_bird", "bird"), ("contains_squirrel", "squirrel"),
        ("default", "_default"), ("default", "_default"), ("default", "_default"),
    ]


def test_catch_all_and_hyphen_keys(spark):
    cfg = EXAMPLE | {"critter": {}, "blue-bird": {"open_duration": 3}}
    got = rules(spark, text_settings(spark, cfg), "cat", "Blue Bird", None)
    assert got == [("critter", "critter"), ("hyphen", "blue-bird"), ("critter", "critter")]


def test_keys_are_compared_as_written(spark):
    cfg = {"Bird": {"open_duration": 2}, "fox": 5, "owl": {}}
    got = rules(spark, text_settings(spark, cfg), "Bird", "bird", "fox", "owl")
    assert got == [("raw", "Bird"), ("literal", None), ("literal", None), ("raw", "owl")]


def test_fields_and_eligibility(spark):
    rows = labels(spark, "squirrel", "bird", "bird", "owl", "owl").withColumn(
        "conf", F.element_at(F.array(*map(F.lit, (0.9, 0.6, 0.57, 0.45, 0.3))), F.col("i") + 1)
    )
    cfg = EXAMPLE | {"owl": {"confidence_threshold": 0.2}}
    got = with_policy(rows, text_settings(spark, cfg)).orderBy("i").collect()
    assert [(r.open_s, r.cooldown_s, r.min_conf) for r in got] == [
        (0.0, 8.0, 0.45), (0.9, 14.0, 0.6), (0.9, 14.0, 0.6), (1.5, 8.0, 0.2), (1.5, 8.0, 0.2),
    ]
    # The global bar stays when a policy asks for less.
    assert [r.eligible for r in got] == [False, True, False, True, False]


def test_joined_and_literal_settings_agree(spark):
    cfg = {f"kind-{i}": {"open_duration": i / 10} for i in range(40)} | EXAMPLE
    rows = parse_settings(spark.createDataFrame([(json.dumps(cfg),)], "settings_text string"))
    names = ["Kind 3", "kind-7", "kind_8", "bluebird", "x", None, " squirrel"]
    few, many = checked(rows), checked(rows, literal_keys=5)
    assert few.literal is not None and many.literal is None
    one, two = (resolve(labels(spark, *names), s).orderBy("i").collect() for s in (few, many))
    assert one == two


def test_last_of_repeated_keys_counts(spark):
    s = settings_from_text(spark, '{"fox": {"open_duration": 1}, "owl": {}, "fox": {"open_duration": 2}}')
    assert s.literal["fox"][0] == 2.0 and set(s.literal) == {"fox", "owl"}


@pytest.mark.parametrize("text", [
    "{'bird': {}}", '{"bird": {}} junk', "", "[1]", "5", '{"a": ', None, '{"bird": {\'open_duration\': 1}}', '{"a": {}} {"b": {}}', '{"a": {}}}',
    '{"a": {}}, "b": {}', '{}],[{}', '{"a": {"b": [1, {\'c\': 2}]}}', '{"a": {}} // all', "{a: {}}", '{"a": 01}', '"{}"', "null", '{"a": {},}',
])
def test_unusable_text_gives_the_fallback(spark, text):
    s = settings_from_text(spark, text)
    assert s.literal == {"_default": (1.5, 8.0, 0.45)} and s.fallbacks == ("_default",)


def test_empty_objects(spark):
    assert settings_from_text(spark, "{}").literal == {}
    assert rules(spark, settings_from_text(spark, "{}"), "fox") == [("literal", None)]
    assert rules(spark, settings_from_text(spark, '{"_default": {}}'), "fox") == [("literal", None)]


@pytest.mark.parametrize("text", [
    '{"fox": {"open_duration": null}}', '{"fox": {"open_duration": "soon"}}', '{"critter": 5}', '{"_default": 5}',
    '{"bird": null}', '{"squirrel": 0}', '{"fox": {"open_duration": "null"}}', '{"fox": {"open_duration": [1]}}', '{"fox": {"open_duration": {}}}',
    '{"_default": "0"}', '{"_default": [0]}', '{"_default": true}',
])
def test_broken_values_are_refused(spark, text):
    with pytest.raises(ValueError):
        settings_from_text(spark, text)


def test_kinds_of_values(spark):
    text = '{"_default": 0, "fox": {"open_duration": "2.5", "cooldown_duration": 1e1}, "owl": "null", "elk": null, "a.b": {"open_duration": 3}, "é \\"q\\"": {}}'
    s = settings_from_text(spark, text)
    assert s.literal == {"fox": (2.5, 10.0, None), "a.b": (3.0, None, None), 'é "q"': (None, None, None)} and s.fallbacks == ()
    for empty in ("0", "0.0", "false", '""', "[]", "null", "-0.0"):
        assert settings_from_text(spark, '{"_default": %s}' % empty).literal == {}
    rows = parse_settings(spark.createDataFrame([("\n {} \t",), ('{"x": 5}',)], "settings_text string")).collect()
    assert [(r["key"], r["is_object"], r["n_fields"]) for r in rows] == [("x", False, 0)]
    assert spark.conf.get("spark.sql.variant.allowDuplicateKeys") == "false"


def test_files(spark, tmp_path):
    path = tmp_path / "settings.json"
    path.write_text(json.dumps(EXAMPLE, indent=2))
    assert load_settings(spark, str(path)).literal["bird"] == (0.9, 14.0, 0.6)
    with pytest.warns(UserWarning):
        assert load_settings(spark, str(tmp_path / "none.json")).literal == {"_default": (1.5, 8.0, 0.45)}
    path.write_text("")
    with pytest.warns(UserWarning):
        assert load_settings(spark, str(path)).literal == {"_default": (1.5, 8.0, 0.45)}
    path.write_text("[]")
    with pytest.warns(UserWarning):
        assert load_settings(spark, str(path)).fallbacks == ("_default",)
