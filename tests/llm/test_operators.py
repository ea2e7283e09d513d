"""The corpus operators on a table of edge cases, against plain Python."""

import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from latchflow.llm import (
    common, decontaminate, jaccard_join, language, mixing, mixing_coder, perspectives, rule_ledger, sharding,
    signature_trees, token_files, toxicity, weak_labels,
)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, key string, block long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
RNG = random.Random(5)
NAMES = ["".join(RNG.choice("abcdeéñ") for _ in range(RNG.randint(1, 7))) for _ in range(300)]


def prose(n):
    return " ".join(RNG.choice(NAMES) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    base = prose(120)
    near = base.split(" ")
    near[60] = "changed"
    texts = [
        None, "", " \t\n", "one", "one two three", base, base, " ".join(near), base.upper().replace("É", "é").replace("Ñ", "ñ"),
        prose(40) + "\n" + prose(3) + "\n\n" + prose(3), "a b c d e a b c d e\r\na b c d e\nx\nx", "#*$%&|<> " * 12, " é " * 30,
        prose(30_000), *(prose(RNG.randint(5, 200)) for _ in range(30)),
    ]
    out = [(i * 3, t, ["en", "de", None][i % 3], [None, "s1", "s2", "s10"][min(i % 5, 3)], 1, 7, "k", 2) for i, t in enumerate(texts)]
    return [*out, out[5], (None, base, None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_rule_ledger_against_plain_python(docs, rows, empty):
    def by_hand(text):
        words = WORD.findall(text or "")
        runs = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        twice = {i + k for i in range(len(words) - 4) if runs[tuple(words[i : i + 5])] > 1 for k in range(5)}
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(twice)

    found = Counter(tuple(r) for r in rule_ledger.ledger(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect())
    assert found == Counter((r[0], *by_hand(r[1])) for r in rows)
    ledger = rule_ledger.ledger(docs)
    bits = [r[0] for r in ledger.select("fail_bits").collect()]
    for r in rule_ledger.ablations(ledger).collect():
        mask, bit = rule_ledger.POLICIES[r["policy"]], rule_ledger.BIT[r["rule"]]
        assert r["n_only"] == sum(b & mask == bit for b in bits)
        assert r["n_rejected"] == (sum(b & mask != 0 for b in bits) if r["n_rejected"] else 0)
    assert rule_ledger.ledger(empty).count() == 0


def test_shards_are_a_permutation(docs, rows, empty):
    found = sharding.shard(docs, 4).collect()
    n = len(rows)
    assert sorted(r["slot"] * 4 + r["shard"] for r in found) == list(range(n))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == Counter(
        (r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    shard, slot = sharding.shard_and_slot(np.array([r["row_no"] for r in found]), n, 4)
    assert shard.tolist() == [r["shard"] for r in found] and slot.tolist() == [r["slot"] for r in found]
    for size in (1, 2, 3, 17, 1000):
        assert sorted(common.feistel(np.arange(size), size, 9)) == list(range(size))
    assert sharding.shard(empty).count() == 0


def _links_by_hand(rows, words, percent):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets, parent = {}, {}
    for i, r in enumerate(rows):
        w = WORD.findall((r[1] or "").translate(lower))
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
        parent[i] = i

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    known = [i for i, r in enumerate(rows) if r[0] is not None and sets[i]]
    for a, b in itertools.combinations(known, 2):
        if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            parent[root(a)] = root(b)
    out = []
    for i, r in enumerate(rows):
        if r[0] is None:
            out.append((None, len(sets[i]), None))
        else:
            out.append((r[0], len(sets[i]), min(rows[k][0] for k in known if root(k) == root(i)) if sets[i] else r[0]))
    return Counter(out)


@pytest.mark.parametrize(("words", "percent", "block"), [(4, 85, 1_000_000), (5, 80, 150), (4, 85, 1)])
def test_jaccard_join_against_all_pairs(spark, rows, words, percent, block):
    more = []
    for i in range(12):  # chains of near copies, and texts that share a passage
        text = prose(90).split(" ")
        for k in range(4):
            text[RNG.randrange(90)] = f"w{k}"
            more.append((1000 + i * 10 + k, " ".join(text), None, None, None, None, None, None))
    table = [*rows, *more]
    found = jaccard_join.join(spark.createDataFrame(table, SCHEMA), words, percent, block)
    assert Counter(map(tuple, found.collect())) == _links_by_hand(table, words, percent)


def test_distinct_pairs():
    u, v = [np.array([3, 1, 3]), np.array([1, 3])], [np.array([1, 0, 1]), np.array([2, 1])]
    a, b = jaccard_join._distinct(u, v)
    assert list(zip(a.tolist(), b.tolist(), strict=True)) == [(1, 0), (1, 2), (3, 1)]


def test_join_whatever_a_task_gathers(spark, rows, monkeypatch):
    table = spark.createDataFrame([(r[0], r[1]) for r in rows], "doc_id long, text string")
    whole = Counter(map(tuple, jaccard_join.join(table).collect()))
    monkeypatch.setattr(jaccard_join, "GATHER", 3)
    # copies are told apart only inside what a task gathers, so more of them tie, never fewer
    ties = jaccard_join._ties(table, 4, 85, 60)
    assert ties.where("u <= v").isEmpty()
    assert Counter(map(tuple, jaccard_join.join(table).collect())) == whole


def test_join_sends_tasks_small_batches(spark, monkeypatch):
    name, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before = spark.conf.get(name)
    kept = jaccard_join.checkpointed

    def checkpointed(df):
        rows = spark.range(0, 2000, 1, 1).mapInArrow(
            lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long")
        seen.append(max(r["n"] for r in rows.collect()))
        return kept(df)

    monkeypatch.setattr(jaccard_join, "checkpointed", checkpointed)
    table = [(i, prose(30)) for i in range(20)]
    jaccard_join.join(spark.createDataFrame([*table, (99, table[0][1])], "doc_id long, text string")).collect()
    assert len(seen) >= 3 and max(seen) <= common.BATCH_ROWS
    assert spark.conf.get(name) == before
    with pytest.raises(KeyError), common.small_batches(spark):
        raise KeyError
    assert spark.conf.get(name) == before


def test_jaccard_join_of_nothing(empty):
    assert jaccard_join.join(empty).count() == 0


def test_bucket_hashes_meet_for_all_linked_sets():
    rng = np.random.default_rng(3)
    for percent in (80, 85):
        for n in (1, 2, 5, 9, 20, 60, 200):
            for _ in range(30):
                a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
                drop = rng.random(len(a)) > (100 - percent) / 100 * rng.random()
                b = np.unique(np.concatenate([a[drop], rng.integers(0, 2**64, int(n * 0.1 * rng.random()), dtype=np.uint64)]))
                if len(b) and signature_trees.similar(a, b, percent):
                    x, y = (set(jaccard_join.bucket_hashes(s, percent).tolist()) for s in (a, b))
                    assert x & y


@pytest.mark.parametrize("percent", [80, 85])
def test_bucket_hashes_meet_at_the_border_and_not_by_a_passage(percent):
    rng = np.random.default_rng(7)

    def hashes(found):
        return set(jaccard_join.bucket_hashes(np.sort(found), percent).tolist())

    for n in (3, 10, 40, 150, 333, 500, 700, 1200):
        for _ in range(12):
            a = rng.integers(0, 2**64, n, dtype=np.uint64)
            b = a[: -(-n * percent // 100)]  # the smallest subset that links
            new = (n * (100 - percent)) // (100 + percent)  # as many shingles exchanged as a link allows
            c = np.concatenate([a[new:], rng.integers(0, 2**64, new, dtype=np.uint64)])
            for other in (b, c):
                if len(other) and signature_trees.similar(np.sort(a), np.sort(other), percent):
                    assert hashes(a) & hashes(other)
    # texts of about one size that have a passage of an eighth in common don't link, and few of them meet
    passage = rng.integers(0, 2**64, 50, dtype=np.uint64)
    shown = [hashes(np.concatenate([passage, rng.integers(0, 2**64, int(n), dtype=np.uint64)])) for n in rng.integers(300, 400, 60)]
    met = sum(bool(x & y) for i, x in enumerate(shown) for y in shown[:i])
    assert met < 0.1 * 60 * 59 / 2


def test_trees_find_all_links():
    rng = np.random.default_rng(4)
    base = [np.unique(rng.integers(0, 2**64, 40, dtype=np.uint64)) for _ in range(30)]
    sets = [np.unique(np.concatenate([s[rng.random(len(s)) > 0.05], s[:3]])) for s in base for _ in range(5)]
    labels = signature_trees.link(sets, np.arange(len(sets)), 85)
    want = np.arange(len(sets))
    for a, b in itertools.combinations(range(len(sets)), 2):
        if signature_trees.similar(sets[a], sets[b], 85):
            want[want == want[b]] = want[a]
    same = lambda x: {frozenset(np.flatnonzero(x == v).tolist()) for v in x}
    assert same(labels) == same(want)


def test_every_window_is_hit_by_a_mask():
    for n in range(decontaminate.SHORT.stop, decontaminate.WINDOW + 1):
        lost = n - -(-n * decontaminate.SHARE // 100)
        for gone in itertools.combinations(range(n), lost):
            assert any(
                all(c == "0" or s + i not in gone for i, c in enumerate(m))
                for m in decontaminate.MASKS for s in range(n - len(m) + 1)
            )


def test_decontamination(spark, docs, empty):
    item, short = [f"item{i}" for i in range(20)], ["only", "four", "tokens", "here"]
    changed = list(item)
    changed[4] = changed[9] = changed[14] = "other"
    bench = spark.createDataFrame([(1, " ".join(item), "x"), (2, " ".join(short), "x"), (3, None, "x"), (4, "too short", "x"), (None, "", "x")],
                                  "item_id long, text string, doc_id string")
    texts = [(1, prose(30) + " " + ", ".join(item).upper() + ". " + prose(9)), (2, " ".join(changed)), (3, prose(20) + " Only four, tokens here!"),
             (4, " ".join(item[:9])), (5, "too short"), (6, " ".join(item[:12]) + " z"), (7, None), (None, " ".join(item))]
    table = spark.createDataFrame(texts, "doc_id long, text string")
    for block in (50_000, 5):
        found = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(table, bench, block=block).collect()}
        assert found == {(1, 1), (2, 1), (3, 2), (6, 1), (None, 1)}
    assert decontaminate.leaks(empty, bench).count() == decontaminate.leaks(docs, bench.limit(0)).count() == 0


def test_decontamination_of_long_texts(spark):
    """200,000 tokens with 22,000 hits: a task that takes along all tokens for each of them needs 100 GB."""
    item, some = [f"item{i}" for i in range(20)], [f"w{i}" for i in range(380)]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(item[1:]))], "item_id long, text string")
    table = spark.createDataFrame(
        [(1, " ".join([*item, *some] * 500)), (2, " ".join([*item, *some])), (3, " ".join(item[:9])), (4, None)], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["n_agreeing"], r["agreement"]) for r in decontaminate.leaks(table, bench).collect()}
    assert set(got) == {(d, k) for d in (1, 2) for k in (1, 2)}
    for k in (1, 2):
        assert got[2, k][0] > 10 and got[1, k] == (500 * got[2, k][0], 100.0)


def test_unseen_documents_of_long_texts(spark, tmp_path):
    """The stage drops a text of 150,000 tokens with many passages and keeps one without, in rows of all columns."""
    item, some = [f"item{i}" for i in range(20)], [f"w{i}" for i in range(380)]
    spark.createDataFrame([(1, " ".join(item)), (2, " ".join(item[1:]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    texts = [(1, " ".join([*item, *some] * 375)), (2, " ".join(some * 390)), (None, " ".join(item)), (4, None)]
    docs = spark.createDataFrame([(i, x, "en") for i, x in texts], "doc_id long, text string, lang string")
    kept = dict(corpus_pipeline.STAGES)["unseen_documents"](spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and {(r["doc_id"], r["text"], r["lang"]) for r in kept.collect()} == {(*texts[1], "en"), (*texts[3], "en")}


def test_decontamination_with_blocks(spark):
    """A benchmark of many blocks gives the same rows, with rows that repeat and without ids."""
    text = prose(300).split(" ")
    items = [(i % 7 or None, " ".join(text[i * 9 : i * 9 + (i % 5) * 5 + 4])) for i in range(30)] * 2
    bench = spark.createDataFrame(items, "item_id long, text string")
    table = spark.createDataFrame([(1, " ".join(text)), (None, " ".join(text[:280])), (1, " ".join(text[40:100]))], "doc_id long, text string")
    one, many = (sorted(map(repr, decontaminate.leaks(table, bench, block=n).collect())) for n in (50_000, 100))
    assert one == many and len(one) > 10


def test_mix(docs, rows, empty):
    found = mixing.mix(docs).collect()
    assert len(found) == len(rows)
    names = sorted({r[3] for r in rows if r[3] is not None}) + [None]
    size = {n: sum(len(WORD.findall(r[1] or "")) for r in rows if r[3] == n) for n in names}
    weight = {n: (3, 1, 2)[i % 3] for i, n in enumerate(names)}
    target, open_, left = {}, set(names), 1.5 * sum(size.values())
    while True:
        share = left / sum(weight[n] for n in open_)
        above = {n for n in open_ if share * weight[n] > 2 * size[n]}
        if not above:
            break
        for n in above:
            target[n] = 2.0 * size[n]
            left -= target[n]
        open_ -= above
    target |= {n: share * weight[n] for n in open_}
    for n in names:
        key = "1" if n is None else "0" + n
        own = [r for r in found if r["key"] == key]
        assert own[0]["target"] == pytest.approx(target[n]) and own[0]["source_size"] == size[n]
        assert all(r["times"] <= 2 and len(r["shards"] or []) == r["times"] for r in own)
    assert Counter(map(repr, found)) == Counter(map(repr, mixing.mix(docs.repartition(5)).collect()))
    drawn = mixing.draws(docs)
    order = [(r["shard"], r["rank"]) for r in drawn.collect()]
    assert order == sorted(order) and len({s for s, _ in order}) > 1
    assert drawn.count() == sum(r["times"] for r in found) and mixing.mix(empty).count() == 0
    split = mixing._split(np.array([5, 0, 9]), np.array([4, 3, 4, 3]), np.random.default_rng(1))
    assert split.sum(axis=0).tolist() == [5, 0, 9] and split.sum(axis=1).tolist() == [4, 3, 4, 3]


@pytest.mark.parametrize("n", [0, 1, 100, 2049])
def test_coder_round_trip(n):
    ids = (np.random.default_rng(n).zipf(1.2, n) % 49_408).astype(np.uint32)
    frame = mixing_coder.write_frame([None, 3], np.array([n, 0]), ids, 512)
    names, lengths, back = mixing_coder.read_frame(frame)
    assert names == [None, 3] and lengths.tolist() == [n, 0] and (back == ids).all()
    if n > 512:
        assert (mixing_coder.read_block(frame, 2) == ids[1024:1536]).all()
        broken = bytearray(frame)
        broken[-9] ^= 1
        with pytest.raises(ValueError, match="damaged"):
            mixing_coder.read_frame(bytes(broken))


def test_token_files(docs, rows, empty):
    tokenizers = pytest.importorskip("tokenizers")
    pytest.importorskip("public_tokenizers")
    tokenizer = tokenizers.Tokenizer.from_file(token_files.vocabulary())
    want, start = Counter(), 0
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = np.array([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1], dtype="<u4")
        want[r[0], start, len(ids), zlib.crc32(ids.tobytes())] += 1
        start += len(ids)
    assert Counter(tuple(r)[:4] for r in token_files.encode(docs).collect()) == want
    odd = ["".join(RNG.choice("aAΣſİß́ \n 'st#1<|endoftext|>日") for _ in range(40)) for _ in range(200)]
    ids = np.concatenate([i for i, _ in token_files.encoded(pa.array(odd), token_files.vocabulary())]).tolist()
    assert ids == [i for t in odd for i in [*tokenizer.encode(t, add_special_tokens=False).ids, 1]]
    assert token_files.encode(empty).count() == 0


def test_token_files_of_rows_without_ids(spark):
    pytest.importorskip("public_tokenizers")
    tokenizer = pytest.importorskip("tokenizers").Tokenizer.from_file(token_files.vocabulary())
    texts = sorted(prose(6) for _ in range(400))
    docs = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string").repartition(4)
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesce, "false")
    try:
        found = token_files.encode(docs).orderBy("start").collect()
    finally:
        spark.conf.unset(coalesce)
    assert len({r["part"] for r in found}) > 2
    want, start = [], 0
    for text in texts:
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 1], dtype="<u4")
        want.append((None, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert [tuple(r)[:4] for r in found] == want


def test_long_words_are_not_remembered():
    pytest.importorskip("public_tokenizers")
    tokenizer = pytest.importorskip("tokenizers").Tokenizer.from_file(token_files.vocabulary())
    words = ["ab" * n for n in (3, token_files.KEPT // 2, token_files.KEPT // 2 + 1, 50_000)]
    for _ in range(2):
        (ids, lengths), = token_files.encoded(pa.array([" ".join(words)]), token_files.vocabulary())
        assert ids.tolist() == [*tokenizer.encode(" ".join(words), add_special_tokens=False).ids, 1] and lengths.tolist() == [len(ids)]
    held = token_files._worker(token_files.vocabulary())
    assert max(map(len, [*held.words, *held.older])) == token_files.KEPT


def test_words_share_their_pieces():
    """Words that differ in case or by signs cost the library one call, and ids stay those of whole texts."""
    path = token_files.vocabulary()
    tokenizer = pytest.importorskip("tokenizers").Tokenizer.from_file(path)
    rng = np.random.default_rng(9)
    bits = [*"abzAKZ019.,-!_'\"<|>#", "'s", "'RE", "don't", " ", "\n", "é", "É", "ß", "Ÿ", "×", "÷", "İ", "ı", "ŉ", "ſ", "\u0307", "\u0338",
            "中", "…", "\u00a0", "\x1c", "\x7f", "²", "\u212a", "ª", "<|endoftext|>", "<|STARTOFTEXT|>"]
    for some in (bits, [b for b in bits if "|" not in b]):
        texts = ["".join(rng.choice(some, n)) for n in rng.integers(0, 25, 1500)]
        want = [i for t in texts for i in [*tokenizer.encode(t, add_special_tokens=False).ids, token_files.END]]
        assert np.concatenate([i for i, _ in token_files.encoded(pa.array(texts), path)]).tolist() == want
    held = token_files._worker(path)
    held.words, held.older = {}, {}
    list(token_files.encoded(pa.array(["qzxv Qzxv, (QZXV) qzxv... qzxv-qzxv\" qZxV7"]), path))
    assert [w for w in held.words if w.lower().count(b"qzxv")] == [b"qzxv"]


def test_toxicity_on_held_out_documents(spark, docs, rows, empty):
    def made(i):
        words = prose(60).split(" ")
        if i % 2:
            for k in range(0, 60, 15 if i % 4 == 1 else 6):
                words[k] = RNG.choice(["vileword", "nastyword"])
        return (i, " ".join(words))

    table = spark.createDataFrame([made(i) for i in range(400)], "doc_id long, text string")
    labels = table.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    model = toxicity.fit(table, labels.where("doc_id < 300"))
    held = toxicity.grade(table.where("doc_id >= 300"), model).join(labels.withColumnRenamed("toxic", "y"), "doc_id").collect()
    assert sum(r["toxic"] == bool(r["y"]) for r in held) >= 0.95 * len(held)
    heavy = [r["expected_severity"] for r in held if r["doc_id"] % 4 == 3]
    light = [r["expected_severity"] for r in held if r["doc_id"] % 4 == 1]
    assert np.mean(heavy) > np.mean(light) > 0.7
    assert toxicity.grade(docs, model).count() == len(rows) and toxicity.grade(empty, model).count() == 0
    none = toxicity.fit(table, labels.limit(0))
    assert toxicity.grade(docs, none).where("toxic").count() == 0


def test_weak_labels(spark, docs, rows, empty):
    table = spark.createDataFrame(
        [(i, prose(80) if i % 4 else " ".join(w + "%%%" for w in prose(80).split(" "))) for i in range(400)], "doc_id long, text string")
    model, weights, limit = weak_labels.fit(table)
    found = weak_labels.score(table, weights, limit).collect()
    assert sum(r["kept"] == bool(r["doc_id"] % 4) for r in found) >= 0.95 * len(found)
    assert model["accuracy"]["symbols"] > 0.9
    assert weak_labels.score(docs, weights, limit).count() == len(rows)
    assert weak_labels.score(empty, *weak_labels.fit(empty)[1:]).count() == 0


def test_language(spark, docs, empty):
    letters = {"xx": "abcdefg", "yy": "opqrstu"}
    word = lambda l: "".join(RNG.choice(letters[l]) for _ in range(5))
    text = lambda l, n: " ".join(word(l) for _ in range(n))
    known = spark.createDataFrame([(i, text(l, 50), l) for i, l in enumerate(["xx", "yy"] * 40)], "doc_id long, text string, lang string")
    names, table = language.train(known)
    assert names == ["xx", "yy"]
    pages = [(i, f"http://h{i % 2}.example.{'xx' if i % 2 else 'yy'}/a", f'<html lang="{l}"><p>{text(l, 20)}</p></html>')
             for i in range(60) for l in [["yy", "xx"][i % 2]]]
    pages += [(100, "http://h1.example.xx/b", '<html lang="xx"></html>'), (101, None, None), (102, "none", "<p></p>")]
    found = {r["page_id"]: r for r in language.identify(
        language.page_rows(spark.createDataFrame(pages, "page_id long, url string, html string")), names, table).collect()}
    assert len(found) == 63 and all(found[i]["lang"] == ["yy", "xx"][i % 2] for i in range(60))
    assert found[100]["lang"] == "xx" and found[100]["probability"] > 0.9  # no text: markup, address and host decide
    assert 0.3 < found[101]["probability"] < 0.7 and found[102]["lang"] is not None
    assert language.train(empty)[0] == []


def test_perspectives(spark):
    turns = [(1, 0, "system", "s <|x"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 2, "ann", "tie"), (1, None, None, "first"),
             (2, 0, "system", "only"), (None, 5, "ann", "n"), (1, 1, "ann", "hi")]
    table = spark.createDataFrame([(*t, "x") for t in turns], "conv_id long, turn long, role string, text string, head string")
    found = perspectives.rotate(table).orderBy("conv_id", "perspective", "position").collect()
    seen = Counter((r["conv_id"], r["perspective"]) for r in found)
    assert seen == {(1, "ann"): 6, (1, "bob"): 6, (1, "unknown"): 6, (None, "ann"): 1}
    for who in ("ann", "bob", "unknown"):
        own = [r for r in found if (r["conv_id"], r["perspective"]) == (1, who)]
        whole = "".join(r["segment"] for r in own)
        assert whole.count("<|assistant|>") == sum(r["trained"] for r in own) and "<\\|x" in whole
        for r in own:
            assert whole[r["start"] : r["stop"]] == r["segment"]
            assert r["trained"] == (r["speaker"] == who)
        assert [whole[r["content_start"] : r["content_stop"]] for r in own][0] == "first"
    assert perspectives.rotate(table.limit(0)).count() == 0


def test_perspectives_of_more_segments_than_one_long_held(spark):
    n = (1 << 23) + 3
    turns = spark.range(n).select(
        F.lit(None).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("a").alias("role"), F.lit("").alias("text"))
    placed = perspectives.rotate(turns)
    long = len("<|assistant|>\n<|end|>\n")
    right = (F.col("position") == F.col("turn")) & (F.col("start") == F.col("turn") * long) & (F.col("stop") == F.col("start") + long)
    found = placed.agg(F.count("*").alias("n"), F.count_if(right).alias("right"), F.max("position").alias("last")).first()
    assert tuple(found) == (n, n, n - 1)


def test_pipeline_stages_in_turn(spark, tmp_path):
    RNG.seed(17)
    item = " ".join(f"item{i}" for i in range(20))
    base = prose(100)
    texts = [base, base, prose(30) + " " + item, None, *(prose(50) for _ in range(40))]
    bad = [" ".join(["vileword", *prose(6).split(" ")] * 6) for _ in range(30)]
    docs = spark.createDataFrame(
        [(i, t, "en", f"s{i % 3}", 1) for i, t in enumerate([*texts, *bad])], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(i, int(i >= len(texts)), 1) for i in range(len(texts + bad))], "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    clean = stages["clean_documents"](spark, docs, str(tmp_path))
    assert clean.columns == docs.columns and {r["doc_id"] for r in clean.collect()} == set(range(len(texts)))
    single = stages["distinct_documents"](spark, clean, str(tmp_path))
    assert single.columns == docs.columns and {r["doc_id"] for r in single.collect()} == set(range(len(texts))) - {1}
    unseen = stages["unseen_documents"](spark, single, str(tmp_path))
    assert unseen.columns == docs.columns and {r["doc_id"] for r in unseen.collect()} == set(range(len(texts))) - {1, 2}
    mixed = stages["mixed_documents"](spark, unseen, str(tmp_path))
    times = {r["doc_id"]: r["times"] for r in mixing.mix(unseen).collect()}
    assert Counter(r["doc_id"] for r in mixed.collect()) == Counter({d: n for d, n in times.items() if n})
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == mixed.count()


def test_every_declared_language_is_a_class(spark, monkeypatch):
    letters = [f"{a}{b}" for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz"]
    alphabet = [RNG.sample("abcdefghijklmnopqrstuvwxyz", 6) for _ in range(36)]
    text = lambda l, n: " ".join("".join(RNG.choice(alphabet[l]) for _ in range(5)) for _ in range(n))
    known = spark.createDataFrame(
        [(i, text(i % 34, 60), letters[i % 34]) for i in range(136) if i % 34 < 33 or i < 102] + [(None, text(34, 60), letters[34])] * 3,
        "doc_id long, text string, lang string").repartition(2)
    # language 33 is the rarest of the documents with an id, 34 stands at documents without one, 35 at pages only
    raw = [(i, f"http://h{i}.example.org/a", f'<html lang="{letters[i % 36]}"><p>{text(i % 36, 30)}</p></html>') for i in range(108)]
    pages = language.page_rows(spark.createDataFrame(raw, "page_id long, url string, html string").repartition(2))
    found = []
    for block in (32, 64):
        monkeypatch.setattr(language, "BLOCK", block)
        names, table = language.train(known, pages=pages)
        assert names == letters[:36]
        found.append({r["page_id"]: r for r in language.identify(pages, names, table).collect()})
    for got in found:
        assert len(got) == 108 and all(got[i]["lang"] == got[i]["text_lang"] == letters[i % 36] for i in range(108))
    assert all(found[0][i]["probability"] == pytest.approx(found[1][i]["probability"], rel=1e-9) for i in range(108))


def test_near_copies_whatever_their_ids(spark):
    base, other, third, fourth = (prose(100) for _ in range(4))
    near = " ".join(["changed", *base.split(" ")[1:]])
    rows = [(None, base, "a"), (None, base, "b"), (None, near, "a"), (None, other, "a"), (None, other, "a"), (7, third, "a"), (7, fourth, "a"),
            (7, fourth, "b"), (9, near, "a"), (5, base, "a"), (None, third, "a"), (8, None, "a"), (None, None, "a"), (3, "", "a"), (4, "", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    found = corpus_pipeline.distinct_documents(spark, docs, "")
    want = [(5, base), (None, other), (7, third), (7, fourth), (8, None), (None, None), (3, ""), (4, "")]
    assert found.columns == docs.columns and Counter((r["doc_id"], r["text"]) for r in found.collect()) == Counter(want)
    assert corpus_pipeline.distinct_documents(spark, docs.limit(0), "").count() == 0


@pytest.mark.parametrize("split", [None, 1])
def test_two_sets_pass_through_the_trees(monkeypatch, split):
    seen, possible = [], signature_trees._possible

    def counted(*args):
        seen.append(args[2])
        return possible(*args)

    monkeypatch.setattr(signature_trees, "_possible", counted)
    rng = np.random.default_rng(3)
    for size, changed, linked in ((100, 5, True), (100, 30, False), (1, 0, True), (1, 1, False), (5000, 100, True)):
        one = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
        other = np.unique(np.concatenate([one[changed:], rng.integers(0, 1 << 63, changed).astype(np.uint64)]))
        seen.clear()
        found = signature_trees.link([one, other], np.arange(2), 85, split)
        assert (found[0] == found[1]) == signature_trees.similar(one, other, 85) == linked and seen


def _thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n)), "".join("ba"[bin(i).count("1") % 2] for i in range(n))


@pytest.mark.parametrize("n", [7, 8, 1024, 1 << 16])
def test_texts_that_sums_of_powers_confuse(spark, n):
    one, other = _thue_morse(n)
    docs = spark.createDataFrame([(0, f"{one}\n{other}"), (1, one), (2, other), (3, f"{one} {other} {one} {other}")], "doc_id long, text string")
    assert {r["doc_id"]: r["n_dup_lines"] for r in rule_ledger.ledger(docs).collect()}[0] == 0
    assert {r["doc_id"]: r["component_id"] for r in jaccard_join.join(docs.where("doc_id IN (1, 2)")).collect()} == {1: 1, 2: 2}
    if n < 1 << 16:
        tokenizer = pytest.importorskip("tokenizers").Tokenizer.from_file(token_files.vocabulary())
        ids = np.concatenate([i for i, _ in token_files.encoded(pa.array([f"{one} {other}"]), token_files.vocabulary())]).tolist()
        assert ids == [*tokenizer.encode(f"{one} {other}", add_special_tokens=False).ids, 1]


def test_hashes_of_byte_ranges():
    texts = ["a", "aa", "a\0", "\0", "abcdefg", "abcdefgh", "abcdefghi", "", "ab" * 500, "a"]
    part = next(iter(common.slices(pa.array(texts))))
    hashes = part.hashes(part.offsets[:-1], part.offsets[1:])
    assert len(set(hashes.tolist())) == len(set(texts)) and hashes[0] == hashes[-1]
    inner = part.hashes(part.offsets[4:7], part.offsets[4:7] + 7)
    assert len(set(inner.tolist())) == 1


CLASHING = (
    "doc_id long, text string, lang string, source string, toxic int, severity string, expected_severity double, _key string, _tx long, "
    "_k int, _d int, _t int, _time int, _shard int, shard int, rank int, _copies int, _copy int, _at int, _part int, _base int, _row int, _id int, item_id int"
)


def test_pipeline_stages_keep_rows_whose_columns_or_ids_clash(spark, tmp_path):
    item, clean, near = " ".join(f"item{i}" for i in range(20)), prose(60), prose(80)
    texts = [(7, f"{clean} {item}"), (7, clean), (None, f"x {item}"), (None, near), (None, near), (8, None), (9, ""), (9, prose(50))]
    rows = [(i, t, "en", "s", *[k % 3 for _ in range(2)], 0.5, "q", *[k] * 16) for k, (i, t) in enumerate(texts)]
    rows = [(*r[:4], int(r[4]), str(r[5]), *r[6:]) for r in rows]
    docs = spark.createDataFrame(rows, CLASHING).repartition(2)
    spark.createDataFrame([], "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item, "x")], "item_id long, text string, _key string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    for name, lost in (("clean_documents", []), ("distinct_documents", [4]), ("unseen_documents", [0, 2])):
        found = stages[name](spark, docs, str(tmp_path))
        assert found.columns == docs.columns
        assert Counter(map(tuple, found.collect())) == Counter(r for k, r in enumerate(rows) if k not in lost), name
        assert stages[name](spark, docs.limit(0), str(tmp_path)).count() == 0
    mixed = stages["mixed_documents"](spark, docs, str(tmp_path))
    assert mixed.columns == docs.columns
    # of rows alike in id, text and source the smallest stands for all
    assert {r["rank"] for r in mixed.collect()} <= {0, 1, 2, 3, 6, 7}
    assert stages["mixed_documents"](spark, docs.limit(0), str(tmp_path)).count() == 0
    assert stages["encoded_documents"](spark, docs, str(tmp_path)).count() == len(rows)


def test_names_cannot_break_headers(spark):
    turns = [(1, 0, "bob|>\n<", "a|>b <|end|> \\ <\\|"), (1, 1, "ann", "hi"), (1, 2, "x\\n\r|\\>", "\n")]
    table = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    found = perspectives.rotate(table).collect()

    def undone(text):
        out, i = "", 0
        while i < len(text):
            if text[i] == "\\":
                out += {"n": "\n", "r": "\r"}.get(text[i + 1], text[i + 1] if text[i + 1] == "\\" else text[i + 1])
                i += 2
            else:
                out += text[i]
                i += 1
        return out

    for who in {r["perspective"] for r in found}:
        own = sorted((r for r in found if r["perspective"] == who), key=lambda r: r["position"])
        whole = "".join(r["segment"] for r in own)
        heads = re.findall(r"<\|([^\n]*?)\|>\n", whole)
        assert [h for h in heads if h != "end"] == ["assistant" if t[2] == who else "user name=" + h[10:] for t, h in zip(turns, [h for h in heads if h != "end"])]
        assert [undone(h[10:]) if h != "assistant" else who for h in heads if h != "end"] == [t[2] for t in turns]
        assert [undone(r["segment"][r["content_start"] - r["start"] : r["content_stop"] - r["start"]]) for r in own] == [t[3] for t in turns]


def test_items_in_scripts_without_spaces(spark):
    item = "彼女は毎朝駅まで歩いて新聞を買い、喫茶店で静かに読んだ。"
    bench = spark.createDataFrame([(1, item), (2, "ฉันชอบกินข้าวกับปลาทุกวัน")], "item_id long, text string")
    docs = spark.createDataFrame(
        [(1, f"昨日の話です。{item}それから家に帰った。"), (2, item.replace("新聞", "雑誌")), (3, "彼は夜に家へ帰り、テレビを見た。"), (4, "x ฉันชอบกินข้าวกับปลาทุกวัน y"), (5, "plain words")],
        "doc_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, bench).collect()} == {(1, 1), (2, 1), (4, 2)}


def test_quotas_of_very_many_blocks():
    quota = np.array([6 * 10**11, 0, 10**12 + 1, 7, 3 * 10**9])
    totals = np.diff(np.arange(17) * int(quota.sum()) // 16)
    split = mixing._split(quota, totals, np.random.default_rng(2))
    assert split.sum(axis=0).tolist() == quota.tolist() and split.sum(axis=1).tolist() == totals.tolist() and split.min() >= 0
    assert abs(split[:, 0] / (quota[0] / 16) - 1).max() < 1e-6


def test_scores_of_long_texts_in_parts(monkeypatch):
    table = np.random.default_rng(1).random((1 << language.BITS, 3)).astype(np.float32)
    index = np.random.default_rng(2).integers(0, 1 << language.BITS, 5000)
    borders = np.array([0, 0, 1, 4000, 4000, 4999, 5000])
    want = np.array([table[index[a:b]].sum(axis=0, dtype=np.float64) for a, b in zip(borders, borders[1:])])
    for grams in (1 << 16, 7, 1000):
        monkeypatch.setattr(language, "GRAMS", grams)
        assert np.allclose(language._row_sums(table, index, borders), want, rtol=1e-12)
    assert language._row_sums(table, index[:0], np.array([0, 0])).tolist() == [[0, 0, 0]]


def test_taken_words_come_near_the_target(spark):
    RNG.seed(3)
    rows = [(i, prose(RNG.randint(1, 60)), None, f"s{min(i % 9, 4)}", 1, 1, "k", 1) for i in range(3000)]
    found = mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    taken, goal = Counter(), {}
    for r in found:
        taken[r["key"]] += r["size"] * r["times"]
        goal[r["key"]] = r["target"]
    assert all(abs(taken[k] / goal[k] - 1) < 0.01 for k in goal)
    # each time a document is drawn it lies in one shard, and shards are nearly equal in words
    words = Counter(s for r in found for s in (r["shards"] or []) for _ in range(r["size"]))
    assert len(words) == 16 and max(words.values()) < 1.3 * min(words.values())


def test_ablations_against_plain_python(docs):
    ledger = rule_ledger.ledger(docs)
    bits = [r[0] for r in ledger.select("fail_bits").collect()]
    found = rule_ledger.ablations(ledger).collect()
    for r in found:
        mask = rule_ledger.POLICIES[r["policy"]]
        assert r["n_rejected"] == sum(b & mask != 0 for b in bits) > 0
        assert r["n_failed"] == sum(b & rule_ledger.BIT[r["rule"]] != 0 for b in bits)
        assert r["n_only"] == sum(b & mask == rule_ledger.BIT[r["rule"]] for b in bits)
    assert {(r["policy"], r["rule"]) for r in found} == {(p, n) for p, m in rule_ledger.POLICIES.items() for n, b in rule_ledger.BIT.items() if m & b}
