"""Near-duplicates, repeated passages, components and the pipeline against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest


import corpus_pipeline
from courtledger.llm.components import connected_components
from courtledger.llm.lpf_dedup import repeat_digests, without_repeats
from courtledger.llm.lsh_forest import near_duplicates, one_of_each
from courtledger.llm.queries import QUERIES
from courtledger.llm.texts import words, SPACES

SMALL = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _set(text, size):
    w = re.findall("[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[k:k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset()


def _components(rows, size, percent=80):
    sets = {i: _set(t, size) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                low, high = sorted((find(i), find(j)))
                root[high] = low
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def _families(seed=1):
    """Groups of variants of one text: copies, light and heavy changes."""
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(3000)]
    rows = []
    for size, changes in ((25, 2), (30, 6), (20, 12), (1, 0), (40, 4)):
        base = r.choices(vocabulary, k=r.randint(60, 150))
        for _ in range(size):
            text = list(base)
            for _ in range(r.randint(0, changes)):
                text[r.randrange(len(text))] = r.choice(vocabulary)
            rows.append(" ".join(text) if r.random() < 0.9 else " ".join(base).upper())
    rows += ["", None, " \n", "one two", "One  two", "one two three"]
    r.shuffle(rows)
    return list(enumerate(rows))


def test_groups_against_brute_force(docs):
    for size in (4, 5):
        rows = _families(size)
        got = {r.doc_id: tuple(r)[1:] for r in near_duplicates(docs(rows), size).collect()}
        assert got == _components(rows, size)


def test_a_large_group(docs):
    """More variants than a region holds, few of them linked with each other directly."""
    r = random.Random(9)
    base = [f"b{k}" for k in range(200)]
    rows = []
    for k in range(700):
        text = list(base)
        for _ in range(r.randint(0, 9)):
            text[r.randrange(200)] = f"x{r.random()}"
        rows.append((k, " ".join(text)))
    got = {x.doc_id: x.component_id for x in near_duplicates(docs(rows), 4).collect()}
    expected = {i: c for i, (_, c, _) in _components(rows, 4).items()}
    assert sum(got[i] != expected[i] for i in got) <= 0.002 * len(got)


def _pairs_of_one_template(pairs, seed=11):
    """Texts that are similar (J 0.807) in pairs, and nearly so (J 0.74 to 0.80) with all others."""
    r = random.Random(seed)
    base = [f"t{k}" for k in range(1200)]
    rows = []
    for k in range(pairs):
        own = r.sample(range(300), 38)
        for places in (own[:22], own[:6] + own[22:]):
            text = list(base)
            for at in places:
                text[4 * at] = f"p{k}_{at}"
            rows.append((len(rows), " ".join(text)))
    return rows


def test_pairs_in_dense_regions(docs):
    rows = _pairs_of_one_template(200)
    got = {x.doc_id: x.component_id for x in near_duplicates(docs(rows), 4).collect()}
    assert got == {i: c for i, (_, c, _) in _components(rows, 4).items()}


def test_pairs_in_regions_that_are_cut(docs):
    got = {x.doc_id: x.component_id for x in near_duplicates(docs(_pairs_of_one_template(1000)), 4).collect()}
    assert [k for k in range(0, 2000, 2) if got[k] != got[k + 1]] == []


def test_groups_of_odd_rows(odd):
    got = near_duplicates(odd)
    assert got.count() == odd.count()
    rows = {(r.doc_id, r.n_shingles): r for r in got.collect()}
    assert rows[2, 0].kept and rows[2, 0].component_id == 2 and rows[None, 0].component_id is None
    assert got.where("doc_id = 1 and component_id = 1").count() == 2
    assert near_duplicates(odd.limit(0)).count() == 0
    kept = one_of_each(odd)
    assert kept.columns == odd.columns and kept.where("doc_id = 1").count() == 1
    assert kept.count() == odd.count() - 1
    assert one_of_each(odd.limit(0)).count() == 0


def test_one_of_each_group_stays(docs):
    rows = _families(3)
    expected = {i for i, (_, _, kept) in _components(rows, 5).items() if kept}
    assert {r.doc_id for r in one_of_each(docs(rows)).collect()} == expected
    same_id = docs([(1, "a b c d e f g h"), (1, "a b c d e f g h"), (1, "other words in this text"), (0, "other words in this text")])
    assert sorted((r.doc_id, r.text) for r in one_of_each(same_id).collect()) == [(0, "other words in this text"), (1, "a b c d e f g h")]


def _repeats(rows, length=200):
    texts = {i: (t or "").encode() for i, t in rows}
    seen = Counter(t[k:k + length] for t in texts.values() for k in range(len(t) - length + 1))
    out = {}
    for i, t in texts.items():
        gone = np.zeros(len(t) + 1, int)
        for k in range(len(t) - length + 1):
            if seen[t[k:k + length]] > 1:
                gone[k] += 1
                gone[k + length] -= 1
        gone = np.cumsum(gone[:-1]) > 0
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        out[i] = (len(t), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def _passages(seed=1):
    r = random.Random(seed)
    text = lambda n: "".join(r.choices("abcdéfgh \n", k=n))
    shared = [text(n) for n in (150, 199, 200, 201, 260, 900)]
    rows = []
    for k in range(60):
        rows.append("".join(r.choice([text(r.randint(0, 300)), r.choice(shared), r.choice(shared)[:r.randint(100, 300)]]) for _ in range(r.randint(0, 6))))
    rows += ["", None, "z" * 199, "y" * 200, "x" * 450, "ab" * 300, rows[5], rows[5], text(5000) + shared[5]]
    return list(enumerate(rows))


def test_repeats_against_brute_force(docs):
    rows = _passages()
    got = {r.doc_id: tuple(r)[1:] for r in repeat_digests(docs(rows)).collect()}
    assert got == _repeats(rows)


def test_long_texts_are_read_in_stretches(docs):
    r = random.Random(4)
    long = "".join(r.choices("abcdefghij", k=2_300_000))
    rows = [(1, long), (2, "q" * 300 + long[1_048_400:1_048_900] + "r" * 100 + long[2_200_000:2_200_300]), (3, long[5:205])]
    got = {r.doc_id: tuple(r)[1:3] for r in repeat_digests(docs(rows)).collect()}
    assert got == {1: (2_300_000, 1000), 2: (1200, 1100), 3: (200, 200)}


def test_the_first_copy_stays(docs):
    r = random.Random(6)
    text = lambda n: "".join(r.choices("abcdefgh ", k=n))
    shared = text(400)
    rows = [(5, text(50) + shared + text(60)), (2, text(30) + shared), (9, shared), (7, text(500)), (8, None), (4, shared[:250] + text(99))]
    got = {r.doc_id: r.text for r in without_repeats(docs(rows)).collect()}
    plain = dict(rows)
    assert got[2] == plain[2] and got[7] == plain[7] and got[8] is None and got[9] == ""
    assert len(got[5]) <= 112 and got[5].startswith(plain[5][:49]) and len(got[4]) in range(97, 101)
    twice = without_repeats(docs([(1, shared + text(20) + shared)])).first().text
    assert twice.startswith(shared) and len(twice) <= 425
    every = {r.doc_id: r.text for r in without_repeats(docs(rows), keep_first=False).collect()}
    assert len(every[2]) <= 32


def test_a_full_filter_changes_no_result(spark, docs, monkeypatch):
    from courtledger.llm import hash_filter as filters
    from courtledger.llm import lpf_dedup

    keys = spark.range(5_000).selectExpr("xxhash64(id) as k", "id").unionByName(spark.range(1).selectExpr("cast(null as long) as k", "id"))
    found = filters.hash_filter(keys, "k").value
    inside = np.array([r[0] for r in keys.where("k is not null").select("k").collect()]).view(np.uint64)
    outside = np.array([r[0] for r in spark.range(5_000, 45_000).selectExpr("xxhash64(id)").collect()]).view(np.uint64)
    assert filters.contains(found, inside).all() and filters.contains(found, outside).mean() < 0.03
    assert len(found) == 1 << 14  # the least that holds the keys sparsely, not the greatest
    r = random.Random(3)
    passages = ["".join(r.choice("abcdefghij ") for _ in range(r.choice((150, 260, 400)))) for _ in range(6)]
    rows = docs([(k, "".join(r.choice("klmnopqrst ") for _ in range(300)) + r.choice(passages) + str(k)) for k in range(40)])
    wanted = sorted(map(tuple, lpf_dedup.repeat_digests(rows).collect()))
    monkeypatch.setattr(lpf_dedup, "hash_filter", lambda df, column: filters.hash_filter(df, column, most_bits=6))
    assert sorted(map(tuple, lpf_dedup.repeat_digests(rows).collect())) == wanted and any(w[2] for w in wanted)


def test_repeats_of_odd_rows(odd):
    got = repeat_digests(odd)
    assert got.count() == odd.count() and repeat_digests(odd.limit(0)).count() == 0
    assert got.where("doc_id = 5 and n_removed = 70000").count() == 1
    kept = without_repeats(odd)
    assert kept.columns == odd.columns and kept.count() == odd.count() and kept.where("doc_id = 2 and text is null").count() == 1


def test_cut_characters_go(docs):
    shared = "é" * 200
    rows = docs([(1, "a" + shared + "b"), (2, "ü" + shared + "è")])
    assert all(isinstance(r.text, str) for r in without_repeats(rows, keep_first=False).collect())


def test_components(spark):
    r = random.Random(2)
    pairs = [(k, k + 1) for k in range(300)] + [(r.randrange(400, 900), r.randrange(400, 900)) for _ in range(300)] + [(1000, k) for k in range(1001, 1400)] + [(5, 5)]
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    got = dict(map(tuple, connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()))
    assert got == {i: find(i) for p in pairs if p[0] != p[1] for i in p}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_words_end_at_rows():
    raw = np.frombuffer(b"abcd ef", np.uint8)
    starts, ends, row = words(raw, np.array([0, 2, 2, 7]), SPACES)
    assert (starts.tolist(), ends.tolist(), row.tolist()) == ([0, 2, 5], [2, 4, 7], [0, 2, 2])


@pytest.mark.parametrize("name", ["op7_lsh_forest", "op10_lpf_dedup"])
def test_whole_tables_against_brute_force(spark, name):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES[name](spark, SMALL).collect()}
    assert got == (_components(rows, 4) if name.startswith("op7") else _repeats(rows))


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    ids, before = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, SMALL).cache()
        ids[name] = {r.doc_id for r in after.select("doc_id").collect()}
        if name == "minhash_near_dedup":
            kept = _components([(r.doc_id, r.text) for r in before.collect()], 5)
            assert ids[name] == {i for i, (_, _, k) in kept.items() if k}
        if name != "bpe_encoding":
            assert after.columns == docs.columns
            before = after
    order = list(ids.values())
    assert all(b <= a for a, b in zip(order, order[1:])) and order[-1] == order[-2]
    assert {r.doc_id for r in corpus_pipeline.run(spark, SMALL).collect()} == order[-1]
