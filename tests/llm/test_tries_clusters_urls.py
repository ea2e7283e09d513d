"""Prefix trie, bisector clustering and URL filter against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from latchflow.llm import bisector_clusters, prefix_trie, radix_tree, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TURNS = "conv_id long, turn long, role string, text string, id long, n long, `first` string, key string, depth long"
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie_by_hand(rows, stride=20, heads=4):
    said, built = defaultdict(list), {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            name = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]
            said[conv].append(((turn is not None, turn or 0), role, name, len(WORD.findall(text))))
    for conv in said:
        own = sorted(said[conv])
        base = conv - int(math.fmod(conv, stride))
        h = zlib.crc32(str(conv).encode()) % heads
        built[conv] = [t[2:] for t in sorted(said.get(base, []))[:h] + own[h:]]
    members, words, below = defaultdict(list), {}, defaultdict(set)
    for conv, turns in built.items():
        for d in range(len(turns) + 1):
            node = tuple(name for name, _ in turns[:d])
            members[node].append(conv)
            words[node] = turns[d - 1][1] if d else 0
            if d:
                below[node[:-1]].add(node)
    leaves, saved = Counter(), Counter()
    for node in members:
        for d in range(len(node) + 1):
            leaves[node[:d]] += not below[node]
            saved[node[:d]] += (len(members[node]) - 1) * words[node]
    return Counter(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(below[p]), leaves[p], saved[p],
         hashlib.sha256(",".join(str(c) for c in sorted(m) if len(built[c]) == len(p)).encode()).hexdigest())
        for p, m in members.items()
    )


def nodes(spark, rows, **how):
    table = spark.createDataFrame([(*r, 1, 2, "x", "y", 9) for r in rows], TURNS).repartition(3)
    return Counter(map(tuple, prefix_trie.trie(table, **how).select(*NODE).collect()))


@pytest.fixture(scope="module")
def talks():
    dice = random.Random(3)
    rows = [
        (c, t if dice.random() > 0.05 else None, dice.choice(["u", "a", None]), dice.choice(["x y", "z", None, "", "w\x1fv é"]))
        for c in range(-45, 130) for t in range(dice.randint(1, 9))
    ]
    rows += [(c, t, "u", "same text") for c in range(200, 300) for t in range(4)]  # copies
    rows += [(300 + c, 0, "u", "hot start") for c in range(60)] + [(300 + c, 1, "a", f"tail {c}") for c in range(60)]
    rows += [(41, 1, "u", "twice"), (41, 1, "u", "twice"), (None, 1, "u", "nobody"), (1000, None, None, None)]
    rows += [(500, t, "u", f"long {t}") for t in range(70)] + [(520, t, "u", f"long {t}") for t in range(65)]
    return [*rows, (900, 1, "u", "a b " * 50_000)]


@pytest.mark.parametrize("segment", [prefix_trie.SEGMENT, 30])
def test_trie_against_plain_python(spark, talks, segment):
    assert nodes(spark, talks, segment=segment) == trie_by_hand(talks)


def test_trie_over_many_ranges_and_shuffled_parents(spark, talks, monkeypatch):
    monkeypatch.setattr(prefix_trie, "RANGE", 60)
    monkeypatch.setattr(prefix_trie, "FEW", 0)
    monkeypatch.setattr(prefix_trie, "PACK", 10)
    monkeypatch.setattr(prefix_trie, "ROWS", 7)
    assert nodes(spark, talks) == trie_by_hand(talks)


@pytest.mark.parametrize("rows", [[], [(None, 1, "u", "x")], [(7, 1, "u", "x")], [(20, 1, "u", "x"), (23, 1, "u", "y")]])
def test_trie_of_few_conversations(spark, rows):
    assert nodes(spark, rows) == trie_by_hand(rows)


def test_radix_tree_layouts_grow():
    dice = random.Random(8)
    for width in (2, 5, 17, 49, 256):
        keys = sorted({bytes(dice.randrange(width) for _ in range(dice.randint(0, 4))) for _ in range(900)})
        tree = radix_tree.preorder(radix_tree.grown(keys))
        assert sorted(n.last for n, _ in tree if n.last >= 0) == list(range(len(keys)))
        for node, above in tree:
            assert node.layout >= len(node.items()) and (above < 0 or node.start < node.end)
            assert [keys[n.row][node.end] for _, n in node.items()] == [b for b, _ in node.items()]
            for byte, below in node.items():
                assert node.child(byte) is below
            # only a root or an end of a key may have a single child: paths are compressed
            assert above < 0 or node.last >= 0 or len(node.items()) > 1
        layouts = {n.layout for n, _ in tree}
        assert max(layouts) == next(x for x in radix_tree.LAYOUTS if x >= min(width, 256))


def clusters_by_hand(rows, k=16, rounds=3, size=64):
    kept = []
    for name, v in rows:
        if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v):
            kept.append((name, [math.floor(x) * 64 if abs(x) > 1e15 else math.floor(64 * x) for x in v], v))
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[2]))
    centres = [v for _, v, _ in order[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(centres))

    for _ in range(rounds):
        own = defaultdict(list)
        for _, v, _ in kept:
            own[near(v)[1]].append(v)
        centres = [[sum(x) // len(own[i]) for x in zip(*own[i])] if i in own else c for i, c in enumerate(centres)]
    found = [(name, *reversed(near(v))) for name, v, _ in kept]
    inertia = Counter()
    for _, c, d in found:
        inertia[c] += d

    def long(x):
        return x if x < 1 << 63 else None

    every = long(sum(inertia.values())) if all(d < 1 << 63 for _, _, d in found) else None
    whole = {c: all(d < 1 << 63 for _, k_, d in found if k_ == c) for c in inertia}
    return Counter(
        (name, c, long(d), long(inertia[c]) if whole[c] else None, every, hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest())
        for name, c, d in found
    )


def clusters(spark, rows):
    table = spark.createDataFrame([(*r, 3, 4.0) for r in rows], "vec_id long, embedding array<double>, cluster int, distance double")
    return Counter(map(tuple, bisector_clusters.cluster(table.repartition(3)).collect()))


def test_clusters_against_plain_python(spark):
    dice = np.random.default_rng(4)
    rows = [(i, dice.normal(dice.integers(0, 6) * 0.7, 1, 64).tolist()) for i in range(200)]
    grid = [(1000 + i, [float(x) / 64 for x in dice.integers(-1, 2, 64)]) for i in range(120)]  # many ties
    odd = [
        (2000, None), (2001, []), (2002, [1.0] * 63), (2003, [1.0] * 65), (2004, [float("nan")] * 64), (2005, [*[1.0] * 63, float("-inf")]),
        (2006, [*[1.0] * 63, None]), (None, [0.25] * 64), (5, rows[5][1]), (5, rows[5][1]), (6, grid[3][1]),
    ]
    table = rows + grid + odd
    assert clusters(spark, table) == clusters_by_hand(table)


def test_clusters_of_huge_components(spark):
    dice = random.Random(1)
    rows = [(i, [dice.choice([1.0, -1.0]) * 10.0 ** dice.randint(-3, e) for _ in range(64)]) for i, e in enumerate([3] * 30 + [8] * 8 + [30, 150, 306])]
    assert clusters(spark, rows) == clusters_by_hand(rows)


@pytest.mark.parametrize("rows", [[], [(1, [2.0])], [(1, [0.5] * 64)], [(1, [0.5] * 64), (1, [0.5] * 64), (2, [1.5] * 64)]])
def test_clusters_of_few_vectors(spark, rows):
    assert clusters(spark, rows) == clusters_by_hand(rows)


RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"),
    ("a.co", "m/", "block"), ("a.com", "/", "allow"), ("example.com", "", "block"), ("net", "/es/", "allow"), ("Org", "/é/", "block"),
    (None, "/", "block"), ("x", "/", None), ("net", None, "allow"), ("b.c.d", "/q", "block"),
]
BAD = ["casino", "ads", None, "ADS", ""]


def judged_by_hand(url, rules=RULES, words=BAD):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host, path = re.match(r"[^/?#]*", rest)[0].translate(lower), re.match(r"[^/?#]*([^?#]*)", rest)[1]
    fits = {}
    for h, p, verdict in rules:
        if h is not None and verdict is not None:
            h, p = h.translate(lower), p or ""
            if (host == h or host.endswith("." + h)) and path.startswith(p) and host:
                fits[h, p] = "block" if "block" in (verdict, fits.get((h, p))) else "allow"
    if fits:
        h, p = max(fits, key=lambda r: (len(r[0]) + len(r[1]), len(r[0])))
        return host, path, h + p, fits[h, p]
    listed = {w.translate(lower) for w in words if w is not None}
    return host, path, None, "block" if listed & set(re.split(r"[.-]", host)) - {""} or ("" in listed and "" in re.split(r"[.-]", host)) else "allow"


URLS = [
    None, "", "no scheme", "http://", "https://Example.COM/en/x?y#z", "https://www.example.com/en/", "https://m.www.example.com/en", "http://com",
    "http://com/", "x://notexample.com/en/", "http://t.net/es/", "http://t.net/es", "http://t.net?/es/", "http://t.net#/es/", "a://b://c.net/es/",
    "http://a.com/", "http://a.co/m/", "http://my-casino.org/é/", "http://ADS.example.org/", "http://b.c.d/q\nr", "http://.com/", "http://x..net/es/",
    "http://" + "a." * 3000 + "com/en/" + "z" * 5000, "http://" + "y" * 20_000 + ".b.c.d/q", "http://my-casino.org/e", "http://loads.org",
]


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_urls_against_plain_python(spark, most):
    table = spark.createDataFrame([(i % 20, u, "h", "r") for i, u in enumerate([*URLS, *URLS])], "page_id int, url string, host string, rule string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    words = spark.createDataFrame([(w,) for w in BAD], "word string")
    found = url_filter.judge(table.repartition(4), rules, words, most)
    assert found.columns == ["page_id", "host", "path", "rule", "verdict"]
    assert Counter(map(tuple, found.collect())) == Counter((i % 20, *judged_by_hand(u)) for i, u in enumerate([*URLS, *URLS]))
    assert url_filter.judge(table.limit(0), rules, words, most).count() == 0
    plain = url_filter.judge(table, rules.limit(0), words.limit(0), most).collect()
    assert len(plain) == 2 * len(URLS) and {(r["rule"], r["verdict"]) for r in plain} == {(None, "allow")}


def test_digests_that_collide():
    rules = [(f"h{i}.com", f"/p{i % 7}", i % 2 == 0) for i in range(300)]

    def few(key):
        return len(key) % 3

    array = url_filter.DigestArray(np.frombuffer(url_filter.DigestArray.build(rules, ["w1", "w2"], few), dtype=np.uint8), few)
    got = array.judge([f"s.h{i}.com" for i in range(400)], [f"/p{i % 5}x" for i in range(400)])
    hosts = {h: (p, b) for h, p, b in rules}
    for i, (rule, verdict) in enumerate(zip(*got, strict=True)):
        path, blocks = hosts.get(f"h{i}.com", ("/none", False))
        fits = f"/p{i % 5}x".startswith(path)
        assert (rule, verdict) == ((f"h{i}.com{path}", "block" if blocks else "allow") if fits else (None, "allow"))
