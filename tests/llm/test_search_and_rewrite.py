"""Filter audit, nearest neighbours and fill-in-the-middle."""

import hashlib
import math
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from courtledger.llm.block_neighbours import Quantised, cosines, nearest
from courtledger.llm.chunked_fim import Chunks, Layout, chunk_ends, digests, fill_in_middle, restored, summary
from courtledger.llm.potential_audit import audit, coalitions, failures, filter_audit, measure, potentials

LABELS = "doc_id long, quality int, toxic int"
VECTORS = "vec_id long, embedding array<float>"


# --- filter audit -----------------------------------------------------------


def _audit_by_hand(docs, labels):
    """Every order applied filter by filter to every document."""
    least = {}
    for doc_id, text, _ in docs:
        if doc_id is not None:
            least[text or ""] = min(doc_id, least.get(text or "", doc_id))
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}

    def fails(doc_id, text):
        text = text or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
        return {
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), "D": bool(re.search(r"[#$%&*|]", text)),
            "E": doc_id is not None and doc_id > least[text],
        }

    rows, shapley = {}, Counter()
    parts = {}
    for doc_id, text, lang in docs:
        parts.setdefault(lang or "", []).append((doc_id, fails(doc_id, text)))
    for part, members in parts.items():
        for order in permutations("ABCDE"):
            left = members
            for step, name in enumerate(order, 1):
                gone = [(d, f) for d, f in left if f[name]]
                kept = [(d, f) for d, f in left if not f[name]]
                failing = sum(f[name] for _, f in members)
                rows[part, "".join(order), step] = [
                    len(kept), len(gone), failing - len(gone), sum(f[name] and sum(f.values()) == 1 for _, f in members),
                    sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone),
                ]
                shapley[part, name] += len(gone)
                left = kept
    return {(*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in rows.items()}


def test_audit_against_every_order_applied(spark, docs):
    r = random.Random(3)
    words = ["alpha", "Beta", "GAMMA", "d$", "e", "f", "x|y", *(f"w{k}" for k in range(120))]
    texts = [" ".join(r.choices(words[:r.randint(3, len(words))], k=r.randint(0, 220))) for _ in range(60)]
    rows = [(k, r.choice(texts + [None, "", " \x0b\x0c"]), r.choice(["en", "fr", None, ""])) for k in range(200)]
    rows += [(None, texts[0], "en"), (None, texts[0], "en"), (5, texts[1], "en"), (5, texts[1], "en"), (7, "Ünï É " * 50, "de")]
    labels = [(k, r.choice([0, 1, None]), r.choice([0, 1])) for k in range(0, 220, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1)]
    r.shuffle(rows)
    got = filter_audit(docs(rows), spark.createDataFrame(labels, LABELS))
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    found = [tuple(row) for row in got.collect()]
    assert len(found) == len(set(found)) == 4 * 600
    assert set(found) == _audit_by_hand(rows, labels)


def test_potentials_are_those_of_the_definition(spark):
    """Shapley from marginals of all orders, for a game of three and its potential."""
    worth = [0, 3, 5, 9, 2, 4, 8, 11]
    got = spark.range(1).select(potentials(F.array(*(F.lit(w).cast("long") for w in worth)), 3).alias("p")).first().p
    for s in range(1, 8):
        members = [1 << k for k in range(3) if s >> k & 1]
        assert len(members) * got[s] == 6 * worth[s] + sum(got[s - m] for m in members)
    for i in range(3):
        total = sum(worth[before | 1 << i] - worth[before] for order in permutations(range(3)) for before in [sum(1 << x for x in order[:order.index(i)])])
        assert got[7] - got[7 - (1 << i)] == total
    assert got[7] - got[0] <= math.factorial(3) * sum(worth)


def test_coalitions_sum_what_meets_them(spark):
    counted = spark.createDataFrame([("p", 0, 4, 1, 0), ("p", 1, 2, 1, 1), ("p", 3, 5, 0, 2), ("q", 2, 1, 1, 1)], "part string, bits int, n long, good long, toxic long")
    got = {row.part: row for row in coalitions(counted, 2).collect()}
    assert (got["p"].n, got["p"].good, got["p"].toxic, got["p"]["size"]) == ([0, 7, 5, 7], [0, 1, 0, 1], [0, 3, 2, 3], 11)
    assert (got["q"].n, got["q"]["size"]) == ([0, 0, 1, 1], 1)
    assert audit(counted, ("A", "B")).count() == 2 * 2 * 2


def test_audit_of_odd_and_no_rows(spark, docs, odd):
    labels = spark.createDataFrame([], LABELS)
    counted = failures(odd, labels)
    assert counted.agg(F.sum("n")).first()[0] == odd.count()
    rows = [(r.doc_id, r.text, r.lang) for r in odd.collect()]
    extra = labels.withColumns({"bits": F.lit(1), "part": F.lit("x"), "digest": F.lit("y")})
    assert {tuple(r) for r in filter_audit(odd, extra).collect()} == _audit_by_hand(rows, [])
    assert filter_audit(docs([]), labels).count() == 0
    assert measure(b"")[1:] == (0, 0, 0, 0, False)


# --- nearest neighbours -----------------------------------------------------


def _neighbours_by_hand(rows, every=50, k=5):
    usable = []
    for vec_id, v in rows:
        ok = vec_id is not None and v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)
        if ok and (vec_id, tuple(v)) not in usable:
            usable.append((vec_id, tuple(v)))
    out = []
    for q, a in usable:
        if q % every == 0:
            found = []
            for c, b in usable:
                if c != q and len(b) == len(a):
                    x, y = np.float32(a).astype(float), np.float32(b).astype(float)
                    found.append((-cosines(x[None], y[None])[0], c))
            out += [(q, n, c, -s) for n, (s, c) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("size", [1 << 30, 4_000])  # one block of queries, or many
def test_neighbours_against_brute_force(spark, size):
    r = np.random.default_rng(8)
    rows = [(k, r.normal(size=24).tolist()) for k in range(900)]
    rows += [(1_000 + k, rows[k % 40][1]) for k in range(60)]  # copies
    rows += [(2_000 + k, (np.array(rows[50][1]) + r.normal(size=24) * 1e-6).tolist()) for k in range(200)]  # nearly one vector
    rows += [(3_000 + k, r.normal(size=3).tolist()) for k in range(4)]  # fewer than five of this length
    got = sorted(tuple(x) for x in nearest(spark.createDataFrame(rows, VECTORS), query_bytes=size, block_bytes=size, least_blocks=3).collect())
    assert got == _neighbours_by_hand(rows)


def test_one_vector_held_by_a_third_of_the_rows(spark):
    r = np.random.default_rng(9)
    hot = r.normal(size=8).tolist()
    rows = [(k, hot if k % 3 == 0 else r.normal(size=8).tolist()) for k in range(600)]
    got = sorted(tuple(x) for x in nearest(spark.createDataFrame(rows, VECTORS)).collect())
    assert got == _neighbours_by_hand(rows)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [0.0, 1.0]), (50, [1.0, 1.0]), (50, None), (1, [2.0, 0.0]), (2, [0.0, -0.0]), (3, [nan, 1.0]),
        (4, [inf, 1.0]), (5, [None, 1.0]), (6, []), (None, [1.0, 0.0]), (7, [-1.0, 0.0]), (8, [4.0, 0.0]), (9, [1.0]), (100, [0.0, 0.0]),
    ]
    frame = spark.createDataFrame(rows, VECTORS).withColumns({c: F.lit(c) for c in ("q", "b", "dim", "rank", "score", "vector", "query_id")})
    got = sorted(tuple(x) for x in nearest(frame).collect())
    assert got == _neighbours_by_hand(rows)
    assert nearest(spark.createDataFrame([], VECTORS)).count() == 0
    assert nearest(spark.createDataFrame([(0, [1.0, 2.0])], VECTORS)).count() == 0


def test_bounds_hold_for_every_pair():
    r = np.random.default_rng(10)
    for dim in (1, 3, 64, 1_500):
        a, b = r.normal(size=(40, dim)) * 10.0 ** r.integers(-20, 20, size=(40, 1)), r.standard_cauchy(size=(50, dim))
        low, high = Quantised(a).bounds(slice(None), Quantised(b), slice(None))
        real = cosines(np.repeat(a, 50, axis=0), np.tile(b, (40, 1))).reshape(40, 50)
        assert (low <= real).all() and (real <= high).all()
    low, high = Quantised(r.normal(size=(200, 64))).bounds(slice(0, 100), Quantised(r.normal(size=(50, 64))), slice(None))
    assert low.shape == (100, 50) and (high - low).max() < 0.06


# --- fill-in-the-middle -----------------------------------------------------


def _fim_by_hand(doc_id, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k:k + 8], 16) for k in range(0, 32, 8))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 100:
        form, output, sizes = "plain", text, (None, None)
    elif h4 % 100 < 50:
        form, output, sizes = "spm", f"<S>{s}<P>{p}<M>{m}", (len(p), len(m))
    else:
        form, output, sizes = "psm", f"<P>{p}<S>{s}<M>{m}", (len(p), len(m))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return doc_id, n, form, *sizes, sha(output), sha(text)


def test_fim_against_the_pattern(docs):
    r = random.Random(4)
    lines = ["a\n", "\n", "ünï 日本\n", "x" * 3_000 + "\n", "<P\n", "S><M\n", "\r\n", "\U0001f600" * 90 + "\n", "<", "> end"]
    rows = [(k, "".join(r.choices(lines, k=r.randint(0, 400)))) for k in range(150)]
    rows += [(200, "\n"), (201, "no line end"), (202, "has <M> inside\nand more\n"), (203, "y" * 200_000), (204, "y" * 100_000 + "\n" + "z" * 50_000), (205, "\n" * 30_000)]
    got = sorted(tuple(x) for x in digests(fill_in_middle(docs(rows))).collect())
    assert got == sorted(_fim_by_hand(*row) for row in rows)


def test_fim_of_odd_and_no_rows(docs, odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    key = lambda x: (x[0] is None, x)
    assert sorted((tuple(x) for x in digests(fill_in_middle(odd)).collect()), key=repr) == sorted((_fim_by_hand(*row) for row in rows), key=repr)
    assert digests(fill_in_middle(docs([]))).count() == 0


def test_rates_and_restoring(docs):
    rows = [(k, f"one {k}\ntwo\nthree <S\n") for k in range(300)]
    plain = fill_in_middle(docs(rows), rate=0)
    assert {x.form for x in plain.collect()} == {"plain"}
    some = fill_in_middle(docs(rows), rate=50, spm=0).cache()
    forms = Counter(x.form for x in some.collect())
    assert set(forms) == {"plain", "psm"} and 100 < forms["psm"] < 200
    texts = dict(rows)
    assert all(x.text == texts[x.doc_id] for x in some.select("doc_id", restored(F.col("output"), F.col("form")).alias("text")).collect())


def test_chunks_follow_the_content():
    r = random.Random(6)
    shared = bytes(r.choices(range(97, 123), k=40_000))
    chunks = []
    for text in (shared, b"something else in front\n" * 40 + shared):
        ends = chunk_ends(np.frombuffer(text, np.uint8))
        chunks.append({text[a:b] for a, b in zip([0, *ends], ends)})
    assert len(chunks[0] & chunks[1]) > 0.8 * len(chunks[0])
    for text in (b"", b"a", b"\n" * 20_000, shared * 60):
        e = chunk_ends(np.frombuffer(text, np.uint8))
        assert sorted(set(e)) == e and (e[-1:] == [len(text)] if text else not e)
        assert all(b - a <= 8_192 for a, b in zip([0, *e], e))


def test_cache_is_bounded_and_compares_content():
    cache = Chunks(most_bytes=10_000)
    for k in range(500):
        chunk = f"line {k}\n".encode() * (k % 7 + 1)
        assert cache[chunk] == summary(chunk)
        assert sum(map(len, (*cache.new, *cache.old))) <= 10_000
    text = ("é\n" * 5_000).encode()
    whole = Layout(text, Chunks())
    assert whole.n == 5_000 and whole.cut(1_234) == (1_234 * 3, 1_234 * 2) and whole.cut(5_000) == (15_000, 10_000)
