"""Decontamination, rules, language, quality and page text."""

import hashlib
import random
import re
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from courtledger.llm.aho_decontaminate import contamination, contamination_digests, uncontaminated
from courtledger.llm.cotrain_quality import ROUNDS, SHARED_WEIGHT, SURE, Learner, Logistic, accepted_documents, exchange, packed, quality_scores, sure_sums, unpacked
from courtledger.llm.cotrain_quality import fit as fit_quality
from courtledger.llm.dom_content import labelled_pages, main_text, page_texts, trained
from courtledger.llm.oracles import ORACLES
from courtledger.llm.ppm_language import fit, held_out_languages, predict
from courtledger.llm.queries import QUERIES
from courtledger.llm.rule_ledger import POLICIES, ablations, ledger, measure, verdicts

SMALL = "/root/testdata/sf0.001"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, name):
    duck = duckdb.connect()
    for file in Path(SMALL).glob("*.parquet"):
        duck.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    df = QUERIES[name](spark, SMALL)
    expected = duck.sql(ORACLES[name]).select(*df.columns).fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(expected)


def _brute(text, items, window=10):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))
    hit, found = set(), set()
    for item, body in items:
        own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (body or "").translate(UPPER))
        if not own:
            continue
        size = min(window, len(own))
        windows = {tuple(own[k:k + size]) for k in range(len(own) - size + 1)}
        for k in range(len(words) - size + 1):
            if tuple(words[k:k + size]) in windows:
                hit.update(range(k, k + size))
                if item is not None:
                    found.add(str(item))
    return len(words), len(hit), sorted(found)


def test_contamination_against_brute_force(spark, docs, odd):
    r = random.Random(5)
    vocabulary = ["a", "B", "c", "É", "1", "x-y"]
    items = [(k, " ".join(r.choices(vocabulary, k=r.randint(0, 14)))) for k in range(30)] + [(3, "a b"), (None, "c c c"), (99, None)]
    texts = [(k, " ".join(r.choices(vocabulary, k=r.randint(0, 200)))) for k in range(40)] + [(50, "?".join(["a", "B"])), (51, None)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for limit in (1 << 20, 60):  # one automaton, or many
        got = {row.doc_id: row for row in contamination(docs(texts), benchmark, pattern_bytes=limit).collect()}
        for doc_id, text in texts:
            n, hit, names = _brute(text, items)
            row = got[doc_id]
            assert (row.n_words, sum(x.word_hi - x.word_lo for x in row.runs), list(row["items"])) == (n, hit, names)
            raw = (text or "").encode()
            for x in row.runs:
                assert len(re.findall(rb"[a-z0-9\x80-\xff]+", raw[x.byte_lo:x.byte_hi].lower())) == x.word_hi - x.word_lo
    assert contamination_digests(odd, benchmark).count() == odd.count()
    assert contamination_digests(odd.limit(0), benchmark).count() == 0
    none = contamination_digests(odd, benchmark.limit(0))
    assert none.where("contaminated or n_items > 0").count() == 0
    assert {r.items_sha256 for r in none.collect()} == {hashlib.sha256(b"").hexdigest()}
    kept = uncontaminated(docs(texts), benchmark)
    assert {r.doc_id for r in kept.collect()} == {d for d, t in texts if _brute(t, items)[1] == 0}
    assert uncontaminated(odd, benchmark).columns == odd.columns


def test_ledger_of_odd_rows_and_policies(odd):
    book = ledger(odd)
    rows = {(r.doc_id, r.n_words): r for r in book.collect()}
    assert book.count() == odd.count() and rows[2, 0].failed == rows[3, 0].failed == rows[4, 0].failed == 1
    assert rows[8, 3000].n_repeat_words == 3000 and rows[8, 3000].n_same_next == 2999
    found = verdicts(book)
    for version, policy in POLICIES.items():
        one = verdicts(book, version)
        table = {r.rule: r for r in ablations(book).where(f"version = {version}").collect()}
        assert set(table) == set(policy)
        assert {r.n_kept for r in table.values()} == {one.where("kept").count()}
        assert {r.n_docs for r in table.values()} == {odd.count()}
    assert found.where("base_failed and kept").count() == 0 and ledger(odd.limit(0)).count() == 0


def test_measures_do_not_cross_rows():
    batch = pa.RecordBatch.from_pydict({"text": ["a b c d e f", "a b c d e f", "l\nl\n l\nl", None]})
    m = measure(batch)
    assert m["n_repeat_words"].tolist() == [0, 0, 0, 0] and m["n_dup_lines"].tolist() == [0, 0, 2, 0]


def test_held_out_languages(spark, odd):
    rows = QUERIES["op2_ppm_language"](spark, SMALL).where("held_out").join(spark.read.parquet(f"{SMALL}/documents.parquet"), "doc_id")
    n = rows.count()
    assert rows.where("lang_pred = lang").count() >= 0.95 * n > 10
    got = held_out_languages(odd)
    assert got.count() == odd.count() and got.where("score < 0 or score > 1 or score is null").count() == 0
    assert {r.lang_pred for r in got.where("doc_id in (2, 3, 4)").collect()} == {"und"}
    assert {r.lang_pred for r in predict(odd, fit(odd.limit(0))).collect()} == {"und"}


def test_code_lengths_are_those_of_a_distribution(docs):
    (model,) = fit(docs([(k, "abracadabra " * 9, "x") for k in range(4)] + [(9, "zzz", "y")]))
    assert model.languages == ["x", "y"]
    for cost in model.costs:
        assert np.allclose(np.exp2(-cost.reshape(-1, 256).astype(float)).sum(axis=1), 1, atol=1e-4)


def _bits_by_hand(sample, text):
    """Escapes with exclusion, one byte after the other, over contexts seen often enough."""
    from collections import Counter, defaultdict

    counts = defaultdict(Counter)
    for known in sample:
        data = b"\n\n\n" + known.encode()
        for k in range(3, len(data)):
            for depth in range(4):
                counts[data[k - depth:k]][data[k]] += 1
    tree = {c for c, n in counts.items() if len(c) < 2 or sum(n.values()) >= 16}
    data, bits = b"\n\n\n" + text.encode(), 0.0
    for k in range(3, len(data)):
        context, offered, p = data[k - 3:k], set(), 1.0
        while context not in tree:
            context = context[1:]
        while True:
            left = {b: n for b, n in counts[context].items() if b not in offered}
            total = sum(left.values()) + len(left)
            if data[k] in left:
                p *= left[data[k]] / total
                break
            if left:
                p *= len(left) / total
                offered |= set(left)
            if not context:
                p /= 256 - len(offered)
                break
            context = context[1:]
        bits -= np.log2(p)
    return bits


def test_code_lengths_against_a_coder_byte_by_byte(docs):
    from courtledger.llm.texts import text_bytes

    r = random.Random(12)
    samples = {lang: [" ".join("".join(r.choices(letters, k=r.randint(1, 6))) for _ in range(60)) for _ in range(6)] for lang, letters in (("x", "abcde"), ("y", "cdefgé"), ("z", "aeiou"))}
    (model,) = fit(docs([(n, text, lang) for n, (lang, text) in enumerate((lang, t) for lang, texts in samples.items() for t in texts)]))
    texts = ["abc cde", "é q", "a", "", "\n\n", samples["y"][0]]
    raw, at = text_bytes(pa.array(texts))
    got = model.lengths(model.index(), raw, at)
    expected = [[_bits_by_hand(samples[lang], text) for lang in model.languages] for text in texts]
    assert np.allclose(got, expected, rtol=1e-4, atol=1e-3)


def test_other_languages_change_no_code_length_and_blocks_no_prediction(spark, docs):
    r = random.Random(13)
    words = {lang: ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(2, 7))) for _ in range(40)] for lang in [f"l{k:02d}" for k in range(30)]}
    rows = [(k, " ".join(r.choices(words[lang], k=120)), lang) for k, lang in enumerate(sorted(words) * 3)]
    few = docs([row for row in rows if row[2] < "l04"])
    held = docs([(1_000 + k, " ".join(r.choices(words[lang], k=50)), lang) for k, lang in enumerate(sorted(words))])
    alone, (together,) = fit(few)[0], fit(docs(rows))
    for k in range(4):
        assert together.languages[k] == alone.languages[k] and (together.costs[k] == alone.costs[k]).all()
    blocks = fit(docs(rows), table_bytes=400_000)
    assert len(blocks) > 4 and [x for m in blocks for x in m.languages] == sorted(words)
    once, parts = ({x.doc_id: (x.lang_pred, x.score) for x in predict(held, m).collect()} for m in ([together], blocks))
    assert once == {k: (lang, pytest.approx(score, abs=1e-9)) for k, (lang, score) in parts.items()}
    assert sum(once[1_000 + k][0] == lang for k, lang in enumerate(sorted(words))) >= 29


def test_quality_on_labels_left_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    test = labels.where("doc_id % 4 = 0")
    got = quality_scores(docs, labels.where("doc_id % 4 <> 0")).join(test, "doc_id")
    n = got.count()
    assert got.where("(quality_score >= 0.5) = (quality = 1)").count() >= 0.93 * n > 50
    assert got.where("(toxic_score >= 0.5) = (toxic = 1)").count() >= 0.88 * n


def test_quality_of_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1, 0), (8, 0, 0), (8, 0, None), (None, 1, 1), (77, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int")
    got = quality_scores(odd, labels)
    assert got.count() == odd.count() and got.where("accepted is null or isnan(quality_score)").count() == 0
    without = quality_scores(odd, labels.limit(0))
    assert {tuple(r)[1:] for r in without.collect()} == {(1.0, 0.0, True)}
    kept = accepted_documents(odd, labels.limit(0))
    assert kept.columns == odd.columns and sorted(map(str, kept.collect())) == sorted(map(str, odd.collect()))
    assert quality_scores(odd.limit(0), labels).count() == 0


def test_stored_vectors_are_small_and_whole(spark):
    x = np.array([[0, 1.5, 0], [0, 0, 0], [-2, 0, 1e-30]], "<f4")
    stored = pa.RecordBatch.from_arrays([packed(x), packed(x[:, :2])], ["content", "page"])
    for begin in (0, 1, 3):
        for found, full in zip(unpacked(stored.slice(begin), (3, 2)), (x, x[:, :2]), strict=True):
            assert (found == full[begin:]).all() and found.dtype == full.dtype
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model, vectors = fit_quality(docs, labels)
    n, size = vectors.selectExpr("count(*)", "sum(length(content) + length(page))").first()
    # In full each row takes 4 bytes a column, which filled the executors.
    assert n == docs.count() and size / n < 0.5 * 4 * (2 * len(model.telling) + 3 + 133)


def test_cotraining_helps_the_weaker_view():
    r = np.random.default_rng(1)
    n = 400
    y = (r.random(n) < 0.5).astype(float)
    views = (y[:, None] * 4 + r.normal(size=(n, 1)), y[:, None] * 2 + r.normal(size=(n, 3)))
    few = np.arange(n) < 12
    held = np.arange(12) % 3 == 0
    rest = tuple(v[~few] for v in views)
    learner = Learner(np.arange(1), tuple(v[few] for v in views), y[few], np.ones(12), held)
    alone = learner.fitted[1].logit(rest[1])
    for _ in range(ROUNDS):
        learner.learn(learner.shared(sure_sums(rest, learner.fitted)))
    right = lambda z: ((z >= 0) == (y[~few] == 1)).mean()
    assert right(learner.fitted[1].logit(rest[1])) > right(alone)
    assert right(learner.target().score(rest) - 0.5) > 0.93
    assert Logistic.fit(np.zeros((3, 1)), np.ones(3), np.ones(3)).logit(np.zeros((1, 1)))[0] > 0


def _pool(n, rare, seed=5):
    """Vectors of a class of one in ``rare`` that both views tell."""
    r = np.random.default_rng(seed)
    y = (np.arange(n) % rare == 0).astype(float)
    return y, (np.round(y[:, None] * 8 + r.normal(size=(n, 1)), 3).astype("<f4"), np.round(y[:, None] * 8 + r.normal(size=(n, 2)), 3).astype("<f4"))


def test_every_sure_verdict_becomes_a_label(spark, docs):
    docs([])
    y, views = _pool(20_000, 1_000)
    y_few, few = _pool(60, 2, seed=6)
    rows = [(v.tobytes(), w.tobytes()) for v, w in zip(*views, strict=True)]
    pool = spark.createDataFrame(rows, "content binary, page binary").repartition(7)
    learner = Learner(np.arange(1), tuple(v.astype(float) for v in few), y_few, np.ones(60), np.arange(60) % 3 == 0)
    before, got = learner.fitted, []
    learner.learn = got.append
    exchange(pool, {"toxic": learner})
    for k, (x, labels, weight) in enumerate(got[0]):
        p = 1 / (1 + np.exp(-before[1 - k].logit(views[1 - k])))
        for label, sure in ((1, p >= SURE), (0, 1 - p >= SURE)):
            mine = labels == label
            # The rare class has few labels, each with its weight; the other weighs as much as its labelled rows allow.
            most = SHARED_WEIGHT * min(sure.sum(), (~learner.held & (y_few == label)).sum())
            assert np.isclose(weight[mine].sum(), most)
            mean = (x[mine] * weight[mine][:, None]).sum(axis=0) / weight[mine].sum()
            assert np.allclose(mean, views[k][sure].mean(axis=0, dtype=float), atol=1e-4)
        assert 18 <= (p >= SURE).sum() <= 22


def test_pages_of_the_sample(spark):
    rows = QUERIES["op9_dom_content"](spark, SMALL).join(spark.read.parquet(f"{SMALL}/pages.parquet").drop("url"), "page_id").collect()
    import html

    for row in rows:
        article = re.search(r"(?s)<article>(.*?)</article>", row.html).group(1).replace("<br>", " ")
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", "", b))).strip() for b in re.split(r"</?(?:p|h1)>", article)]
        assert row.text == "\n\n".join(b for b in blocks if b) and row.n_chars == len(row.text)


@pytest.mark.parametrize(("page", "text"), [
    ("", ""), ("<nav>a b</nav>", ""), ("<p>one<p>two", "one\n\ntwo"),
    ("<div id=content><h1>T</h1><p>A &amp;\n b&nbsp;c</p></div><div class='sidebar'><p>more text here, as long as any</p></div>", "T\n\nA & b c"),
    ("<header><a href=/>Home</a></header><div class=post><header><h1>T</h1></header><p>x<br>y</p><div class=comments><p>I like it</p></div></div><form><p>Name</p></form>", "T\n\nx y"),
    ("<article><p>x</p><script>var t='</p>';</script><aside>no</aside><p>y &lt;b&gt;</p></article><div class='cookie-notice'>We use</div>", "x\n\ny <b>"),
    ("<!-- <p>hidden</p> --><main><h1>A</h1>loose<p>b</p></main><footer>c", "A\n\nloose\n\nb"),
    ("<article><p>Text of it</p><button>Share <b>now</b></button><p>and on</p></article>", "Text of it\n\nand on"),
    ("<article><p>a b</p><select><option>One<option>Two</select><object>old <object>x</object> page</object><video src=v>No video</video><p>c</p></article>", "a b\n\nc"),
    ("<article><p>a <button>never closed</p><p>b</p></article>", "a never closed\n\nb"),
    ('<article><p>He said <a title="x>y and more</p><p>z</p></article>', "He said y and more\n\nz"),
    ("<article><p>1 < 2 and <a href='", "1 < 2 and"),
])
def test_page_shapes(page, text):
    assert main_text(page, trained()) == text


def test_marginals_are_those_of_every_assignment():
    """All marks of a small tree, weighted by the model's potentials."""
    import itertools

    from courtledger.llm.dom_content import _describe, _kind, parse

    model = trained()
    page = "<nav><a>x</a></nav><div class='post body'><h1>T</h1><p>some words</p></div><aside>y</aside><footer>c"
    nodes = parse(page)
    looks, _ = _describe(nodes)
    assert 8 <= len(nodes) <= 14
    odds = [np.exp(np.clip(sum(model.look.get(f, 0.0) for f in features), -8, 8)) for features in looks]
    total = np.zeros((len(nodes), 2))
    for marks in itertools.product((0, 1), repeat=len(nodes)):
        weight = (0.99, 0.01)[marks[0]]
        for k, mark in enumerate(marks):
            weight *= odds[k] ** mark
            if k:
                weight *= model.pair.get(_kind(nodes, nodes[k]), model.any_pair)[marks[nodes[k].parent]][mark]
        for k, mark in enumerate(marks):
            total[k, mark] += weight
    assert np.allclose(model.marginals(nodes, looks), total[:, 1] / total.sum(axis=1), atol=1e-9)


def test_deep_and_broken_pages_take_linear_time():
    import time

    model = trained()
    begun = time.monotonic()
    for page in ("<div>" * 100_000 + "deep", "<ul><li>" * 50_000 + "x", "<button>" * 50_000 + "<p>end", "<p>" * 100_000, "<b>x</div></p>" * 50_000):
        main_text(page, model)
    assert time.monotonic() - begun < 60


def test_marginals_on_pages_left_out():
    model, right, n = trained(), 0, 0
    for page in labelled_pages(60, seed=2):
        marked = re.sub(r"qqin|qqout", "", page)
        got = set(main_text(marked, model).split("\n\n"))
        inside = re.search(r"(?s)<h1[^>]*>(.*?)</h1>", page)
        footer = re.search(r"<footer class='qqout '>(?:<p>)?([^<]+)", page)
        if inside:
            n, right = n + 1, right + (inside[1] in got)
        if footer:
            n, right = n + 1, right + (footer[1] not in got)
    assert right >= 0.95 * n > 40


def test_pages_of_odd_rows(spark):
    pages = spark.createDataFrame([(1, None, None), (None, "u", "<p>a</p>"), (1, None, None), (2, "v", "<div>" * 3000 + "deep")], "page_id long, url string, html string")
    got = page_texts(pages.selectExpr("*", "1 as text", "2 as n_chars"))
    assert sorted(map(tuple, got.collect()), key=str)[0][2:] == ("", 0) and got.count() == 4
    assert page_texts(pages.limit(0)).count() == 0
