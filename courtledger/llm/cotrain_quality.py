"""Quality and toxicity of documents by co-training two views.

One view is the text's content: words, and beginnings
of words, that tell the classes apart, and how much
of the text repeats itself. The other is what a page says about itself without
being read: source, language, length, lines and typography. Each view has its own
logistic classifier, learned on labelled documents. Over some rounds all unlabelled
documents are scored, and each view gives every verdict it is sure of to the other
as a label. These labels are as many as the corpus yields, so the other view learns
from their sums: documents of one label that it takes for about equally likely are
added up inside the tasks and count as their mean with their number as weight. Both
views are then calibrated on labelled documents that neither has learned from,
combined, and applied to all documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from courtledger.llm.aho_decontaminate import WORD_SEPARATORS
from courtledger.llm.rule_ledger import measure
from courtledger.llm.texts import LOWER, distinct, mix, seeded, slices, text_bytes, word_hashes, words
from courtledger.llm.workers import give_back
from courtledger.session import fresh_folder

LABELLED_DOCS = 1_500  # of each combination of labels, those with the least hash of doc_id
PARTS = 64
TELLING_WORDS = 256  # per target
LEAST_DIFFERENCE = 28.0  # G squared of a telling word: by chance about one word in ten million
BEGINNINGS = (4, 5, 6, 7)  # bytes of a word that may tell as well
SOURCES = 64  # buckets for the source and for the language
ROUNDS = 3
SURE = 0.98  # a verdict at least this sure becomes a label for the other view
SHARED_WEIGHT = 0.5  # of a shared label; all of a class together weigh at most this share of its labelled rows
BINS, BIN_WIDTH = 32, 0.5  # of the logarithmic odds in which shared labels are added up
SUM_UNIT = 2.0**20  # sums are whole numbers of its inverse, so that they do not depend on the order of tasks
ROWS = 2_000  # vectors looked at in one step
CONTENT_MEASURES, PAGE_MEASURES = 3, 5
CELL = np.dtype([("at", "<u2"), ("value", "<f4")])  # of a stored vector
TARGETS = ("quality", "toxic")


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """A share between 0 and about 1, small ones spread out."""
    return np.log1p(50 * part / np.maximum(whole, 1)) / 4


def content_measures(m: dict[str, np.ndarray]) -> np.ndarray:
    n = m["n_words"]
    return np.stack([_share(m["n_repeat_words"], n), _share(m["n_same_next"], n), n == 0], axis=1).astype(np.float64)


def page_measures(m: dict[str, np.ndarray], source: np.ndarray, lang: np.ndarray) -> np.ndarray:
    numbers = np.stack([
        np.log1p(m["word_chars"]) / 10, np.log1p(m["n_lines"]) / 10, _share(m["n_dup_lines"], m["n_lines"]),
        _share(m["n_symbols"], m["n_words"]), _share(m["n_capitals"], m["n_letters"]),
    ], axis=1)
    hot = np.zeros((len(source), 2 * SOURCES))
    hot[np.arange(len(source)), source] = 0.3
    hot[np.arange(len(lang)), SOURCES + lang] = 0.3
    return np.concatenate([numbers, hot], axis=1)


def widths(telling: np.ndarray) -> tuple[int, int]:
    """The columns of both views."""
    return CONTENT_MEASURES + 2 * len(telling), PAGE_MEASURES + 2 * SOURCES


def _words(part: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Hashes of the words and of their beginnings, one kind after the other, with the words' hashes and rows."""
    raw, at = text_bytes(part.column("text"))
    raw = LOWER[raw]
    starts, ends, row = words(raw, at, WORD_SEPARATORS)
    whole = word_hashes(raw, starts, ends)
    yield whole, whole, row
    for length in BEGINNINGS:
        take = np.flatnonzero(ends - starts > length)
        begin = np.zeros(len(take), np.uint64)
        for k, factor in enumerate(seeded(31, length) | np.uint64(1)):
            begin += mix(raw[starts[take] + k].astype(np.uint64) + np.uint64(1)) * factor
        yield mix(begin + np.uint64(length)), whole[take], row[take]


def features(part: pa.RecordBatch, telling: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both views of the texts: content, page.

    The content has two columns for each telling word or beginning: whether it is
    there, and the share of the text's words.
    """
    m = measure(part)
    rows, columns = [], []
    likely = np.zeros(1 << 16, bool)
    likely[(telling >> np.uint64(48)).astype(np.int64)] = True
    for values, whole, row in _words(part):
        if not len(telling):
            break
        some = np.flatnonzero(likely[(values >> np.uint64(48)).astype(np.int64)])
        at = np.minimum(np.searchsorted(telling, values[some]), len(telling) - 1)
        hit = telling[at] == values[some]
        # Each different word counts once.
        place = row[some][hit] * len(telling) + at[hit]
        _, cell = distinct(whole[some][hit], place)
        rows.append(cell // len(telling))
        columns.append(cell % len(telling))
    count = np.zeros((part.num_rows, len(telling)))
    if rows:
        np.add.at(count, (np.concatenate(rows), np.concatenate(columns)), 1)
    buckets = [part.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("source_bucket", "lang_bucket")]
    content = np.stack([count > 0, _share(count, m["n_words"][:, None])], axis=2).reshape(part.num_rows, -1)
    return np.concatenate([content_measures(m), content], axis=1), page_measures(m, *buckets)


@dataclass
class Logistic:
    """Weights and bias; x is scaled by nothing."""

    weights: np.ndarray
    bias: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights + self.bias

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.01, steps: int = 30) -> Logistic:
        """Newton's method; the bias is not held back. One class only: its logarithmic odds, smoothed."""
        share = (weight @ y + 0.5) / (weight.sum() + 1)
        bias = float(np.log(share / (1 - share)))
        if len(y) == 0 or y.min() == y.max():
            return cls(np.zeros(x.shape[1]), bias)
        full = np.concatenate([x, np.ones((len(x), 1))], axis=1)
        w = np.append(np.zeros(x.shape[1]), bias)
        held = np.append(np.full(x.shape[1], ridge), 1e-6)
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(full @ w, -30, 30)))
            slope = full.T @ (weight * (p - y)) + held * w
            curve = (full * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ full + np.diag(held)
            step = np.linalg.solve(curve, slope)
            w = w - step * min(1.0, 4 / max(np.abs(step).max(), 1e-9))
            if np.abs(step).max() < 1e-4:
                break
        return cls(w[:-1], float(w[-1]))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class Target:
    """Both views of one target, calibrated and combined; own: the content columns it looks at."""

    own: np.ndarray
    views: list[Logistic]
    calibrated: list[Logistic]
    combined: Logistic

    def score(self, views: tuple[np.ndarray, ...]) -> np.ndarray:
        views = (views[0][:, self.own], views[1])
        z = [np.clip(c.logit(np.clip(v.logit(x), -15, 15)[:, None]), -15, 15) for v, c, x in zip(self.views, self.calibrated, views, strict=True)]
        return _sigmoid(self.combined.logit(np.stack(z, axis=1)))


@dataclass
class Learner:
    """One target being learned: the labelled rows in both views, and which of them are held for calibration."""

    own: np.ndarray
    views: tuple[np.ndarray, ...]
    y: np.ndarray
    weight: np.ndarray
    held: np.ndarray

    def __post_init__(self):
        learn = ~self.held
        self.open = len(set(self.y[learn])) == 2  # one class teaches nothing to share
        self.learn([(np.zeros((0, x.shape[1])), np.zeros(0), np.zeros(0)) for x in self.views])

    def learn(self, shared: list[tuple[np.ndarray, ...]]) -> None:
        """Fit both views on the labelled rows that are not held, and on rows, labels and weights from the other."""
        learn = ~self.held
        self.fitted = [
            Logistic.fit(*(np.concatenate(c) for c in zip((x[learn], self.y[learn], self.weight[learn]), more, strict=True)))
            for x, more in zip(self.views, shared, strict=True)
        ]

    def shared(self, sums: list[np.ndarray]) -> list[tuple[np.ndarray, ...]]:
        """For each view the means of ``sure_sums``, their labels and their weights."""
        learn, out = ~self.held, []
        for cells in sums:
            n = cells[:, :, -1]
            most = np.array([self.weight[learn & (self.y == label)].sum() for label in (0, 1)])
            each = SHARED_WEIGHT * np.minimum(1, most / np.maximum(n.sum(axis=1), 1))
            label, at = np.nonzero(n > 0)
            out.append((cells[label, at, :-1] / n[label, at][:, None], label.astype(float), each[label] * n[label, at]))
        return out

    def target(self) -> Target:
        """Both views calibrated on the held rows and combined."""
        test = self.held if self.held.any() else ~self.held
        logits = [np.clip(f.logit(x[test]), -15, 15) for f, x in zip(self.fitted, self.views, strict=True)]
        calibrated = [Logistic.fit(z[:, None], self.y[test], self.weight[test], ridge=0.1) for z in logits]
        z = np.stack([np.clip(c.logit(z[:, None]), -15, 15) for c, z in zip(calibrated, logits, strict=True)], axis=1)
        return Target(self.own, self.fitted, calibrated, Logistic.fit(z, self.y[test], self.weight[test], ridge=0.1))


def sure_sums(views: tuple[np.ndarray, ...], fitted: list[Logistic]) -> list[np.ndarray]:
    """What each view gets from the other: label x bin of its own odds x (sum of its columns, number)."""
    logits, out = [f.logit(x) for f, x in zip(fitted, views, strict=True)], []
    for k, x in enumerate(views):
        sums = np.zeros((2 * BINS, x.shape[1] + 1))
        p = _sigmoid(logits[1 - k])
        rows = np.flatnonzero((p >= SURE) | (1 - p >= SURE))
        at = np.clip(np.floor(logits[k][rows] / BIN_WIDTH) + BINS // 2, 0, BINS - 1).astype(np.int64)
        cell = np.where(p[rows] >= SURE, BINS, 0) + at
        order = np.argsort(cell, kind="stable")
        cells, first, n = np.unique(cell[order], return_index=True, return_counts=True)
        if len(cells):
            sums[cells, :-1] = np.add.reduceat(x[rows[order]], first, axis=0, dtype=np.float64)
            sums[cells, -1] = n
        out.append(sums.reshape(2, BINS, -1))
    return out


def _stored_form(views: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    return tuple(x.astype("<f4") for x in views)


def _stored_bytes(part: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """All values of a binary column as one byte array, and where each begins (one more at the end)."""
    column = part.column(name).cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def _views(part: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """The vectors of both views, stored in full."""
    return tuple(_stored_bytes(part, name)[0].view("<f4").reshape(part.num_rows, -1) for name in ("content", "page"))


def packed(x: np.ndarray) -> pa.Array:
    """The cells of each row that are not zero: most are, and rows in full would fill the memory of an executor."""
    row, at = np.nonzero(x)
    cells = np.empty(len(row), CELL)
    cells["at"], cells["value"] = at, x[row, at]
    ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(x)))]) * CELL.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(x), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(cells.tobytes())]).cast(pa.binary())


def unpacked(part: pa.RecordBatch, widths: tuple[int, ...]) -> tuple[np.ndarray, ...]:
    """The vectors of both views, stored by ``packed``."""
    out = []
    for name, width in zip(("content", "page"), widths, strict=True):
        raw, at = _stored_bytes(part, name)
        cells = raw.view(CELL)
        x = np.zeros((part.num_rows, width), "<f4")
        x[np.repeat(np.arange(part.num_rows), np.diff(at) // CELL.itemsize), cells["at"]] = cells["value"]
        out.append(x)
    return tuple(out)


def _in_steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, ROWS):
            yield batch.slice(k, ROWS)


def _gives_back(step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The step, whose Python worker keeps no memory of it for the next tasks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from step(batches)
        give_back()
    return run


def exchange(pool: DataFrame, learners: dict[str, Learner], read: Callable[[pa.RecordBatch], tuple[np.ndarray, ...]] = _views) -> None:
    """One round: score every row of pool (content, page), let each view learn from what the other is sure of.

    read: the vectors of both views from rows of pool, by default stored in full.
    """
    models = [(at, found.own, found.fitted) for at, found in enumerate(learners.values()) if found.open]
    if not models:
        return
    spread = pool.sparkSession.sparkContext.broadcast(models)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for part in _in_steps(batches):
            content, page = read(part)
            for at, own, fitted in spread.value:
                for k, found in enumerate(sure_sums((content[:, own], page), fitted)):
                    total[at, k] = total.get((at, k), 0) + found
        for (at, k), found in total.items():
            flat = np.rint(found.ravel() * SUM_UNIT).astype(np.int64)
            place = np.flatnonzero(flat)
            ends = [pa.array(np.full(len(place), v), pa.int32()) for v in (at, k)]
            yield pa.RecordBatch.from_arrays([*ends, pa.array(place, pa.int32()), pa.array(flat[place])], ["target", "view", "place", "value"])

    found = pool.select("content", "page").mapInArrow(_gives_back(sums), "target int, view int, place int, value long")
    found = found.groupBy("target", "view", "place").agg(F.sum("value").alias("value")).toArrow().to_pandas()
    for at, learner in enumerate(learners.values()):
        if learner.open:
            cells = []
            for k, x in enumerate(learner.views):
                mine = found[(found["target"] == at) & (found["view"] == k)]
                flat = np.zeros(2 * BINS * (x.shape[1] + 1))
                flat[mine["place"]] = mine["value"] / SUM_UNIT
                cells.append(flat.reshape(2, BINS, -1))
            learner.learn(learner.shared(cells))


def _buckets(docs: DataFrame) -> list[Column]:
    """The buckets of source and lang; a column that is not there has one."""
    return [(F.pmod(F.xxhash64(c), F.lit(SOURCES)) if c in docs.columns else F.lit(0)).cast("int") for c in ("source", "lang")]


def _rows(docs: DataFrame) -> DataFrame:
    source, lang = _buckets(docs)
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"),
        source.alias("source_bucket"), lang.alias("lang_bucket"),
    )


def _telling(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word, quality, toxic: the words and beginnings of each labelled text, once each."""
    for batch in batches:
        for part in slices(batch):
            found = list(_words(part))
            values, rows = distinct(np.concatenate([f[0] for f in found]), np.concatenate([f[2] for f in found]))
            row = pa.array(rows)
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), part.column("quality").take(row), part.column("toxic").take(row)], ["word", "quality", "toxic"])


def telling_words(counts: DataFrame, totals: dict[int, int], target: str, most: int) -> list[int]:
    """The words whose documents are of the two classes in shares that differ most (G squared)."""
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    if not n1 or not n0:
        return []
    a = F.sum(F.when(F.col(target) == 1, F.col("n")).otherwise(0))
    b = F.sum(F.when(F.col(target) == 0, F.col("n")).otherwise(0))
    found = counts.groupBy("word").agg(a.alias("a"), b.alias("b"))
    term = lambda o, e: F.when(o > 0, o * F.log(o / e)).otherwise(0.0)
    n = n1 + n0
    seen = F.col("a") + F.col("b")
    g = term(F.col("a"), seen * n1 / n) + term(F.col("b"), seen * n0 / n) + term(n1 - F.col("a"), (n - seen) * n1 / n) + term(n0 - F.col("b"), (n - seen) * n0 / n)
    return [r[0] for r in found.select("word", g.alias("g")).where(F.col("g") > LEAST_DIFFERENCE).orderBy(F.desc("g"), "word").limit(most).collect()]


@dataclass
class Model:
    telling: np.ndarray
    targets: dict[str, Target]


VECTORS = "content binary, page binary"


def _vectors(words_: np.ndarray, keep: tuple[str, ...]):
    """Rows with their columns in keep and the vectors of both views."""
    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _in_steps(slices(batch)):
                binary = [packed(x) for x in _stored_form(features(part, words_))]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *binary], [*keep, "content", "page"])
    return _gives_back(vectors)


def fit(docs: DataFrame, labels: DataFrame) -> tuple[Model, DataFrame] | tuple[None, None]:
    """Learn from labels (doc_id, quality, toxic): the model, and the stored vectors of all documents, packed.

    Reads at most LABELLED_DOCS labelled documents of each combination of labels, and
    every document that has no label in each round. A null label leaves the row out for
    that target; of several labels of a document the largest counts. None without any
    labelled document.
    """
    marks = labels.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic"))
    marks = marks.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic")).where("quality is not null or toxic is not null")
    marks = marks.withColumn("h", F.xxhash64("doc_id"))
    kind = Window.partitionBy("quality", "toxic").orderBy("h", "doc_id")
    # Most labels may be alike: each of many parts is cut first.
    part = Window.partitionBy("quality", "toxic", F.pmod("h", F.lit(PARTS))).orderBy("h", "doc_id")
    chosen = marks
    for window in (part, kind):
        chosen = chosen.withColumn("k", F.row_number().over(window)).where(F.col("k") <= LABELLED_DOCS).drop("k")
    rows = _rows(docs)
    # At most 8 * LABELLED_DOCS ids.
    labelled = rows.join(F.broadcast(chosen.select("doc_id", "quality", "toxic", "h")), "doc_id").dropDuplicates(["doc_id"])
    folder = fresh_folder(docs.sparkSession, "cotrain")

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return docs.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")

    labelled = stored(labelled, "labelled")
    counts = labelled.select("text", "quality", "toxic").mapInArrow(_gives_back(_telling), "word long, quality int, toxic int").groupBy("word", "quality", "toxic").agg(F.count("*").alias("n"))
    telling: dict[str, list[int]] = {}
    for target in TARGETS:
        totals = {r[0]: r[1] for r in labelled.where(F.col(target).isNotNull()).groupBy(target).count().collect()}
        telling[target] = telling_words(counts, totals, target, TELLING_WORDS)
    words_ = np.unique(np.array(sum(telling.values(), []), np.int64).view(np.uint64))
    own = ("doc_id", "quality", "toxic", "h")
    got = labelled.mapInArrow(_vectors(words_, own), f"doc_id long, quality int, toxic int, h long, {VECTORS}").orderBy("h", "doc_id").toPandas()
    if not len(got):
        return None, None
    read = partial(unpacked, widths=widths(words_))
    views = tuple(x.astype(np.float64) for x in read(pa.RecordBatch.from_pydict({c: pa.array(got[c], pa.binary()) for c in ("content", "page")})))
    # What the sample stands for: combinations of labels are sampled unlike their shares.
    sizes = {(r[0], r[1]): r[2] for r in marks.groupBy("quality", "toxic").agg(F.count("*")).collect()}
    keys = [(None if q != q else int(q), None if t != t else int(t)) for q, t in zip(got["quality"], got["toxic"], strict=True)]
    weight = np.array([max(1.0, sizes.get(k, 1) / LABELLED_DOCS) for k in keys])
    held = (got["h"].to_numpy() % 3) == 0
    learners = {}
    for target in TARGETS:
        has = got[target].notna().to_numpy()
        share = weight[has] / weight[has].mean() if has.any() else weight[has]
        mine = np.array(sorted(telling[target]), np.int64).view(np.uint64)
        at = CONTENT_MEASURES + 2 * np.searchsorted(words_, mine)
        columns = np.concatenate([np.arange(CONTENT_MEASURES), at, at + 1])
        learners[target] = Learner(columns, (views[0][has][:, columns], views[1][has]), got[target].to_numpy(dtype=float)[has], share, held[has])
    every = stored(rows.mapInArrow(_vectors(words_, ("doc_id",)), f"doc_id long, {VECTORS}"), "vectors")
    pool = stored(every.join(marks.select("doc_id"), "doc_id", "left_anti").select("content", "page"), "unlabelled")
    for _ in range(ROUNDS):
        exchange(pool, learners, read)
    return Model(words_, {target: learner.target() for target, learner in learners.items()}), every


SCORES = "doc_id long, quality_score double, toxic_score double, accepted boolean"
LEAST_QUALITY, MOST_TOXIC = 0.5, 0.5


def _verdicts(model: Model, views: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """quality, toxic, accepted."""
    quality, toxic = (model.targets[t].score(views) for t in TARGETS)
    return quality, toxic, (quality >= LEAST_QUALITY) & (toxic < MOST_TOXIC)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from the labels and score every document from its whole text.

    docs: doc_id, text, and source and lang if there are; labels: doc_id, quality,
    toxic; other columns are ignored. One row per input row: doc_id,
    quality_score, toxic_score, accepted. Null text counts as empty. Without any
    label every document is accepted with scores 1 and 0.
    """
    model, vectors = fit(docs, labels)
    if model is None:
        return _rows(docs).select("doc_id", F.lit(1.0).alias("quality_score"), F.lit(0.0).alias("toxic_score"), F.lit(True).alias("accepted"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    stored = widths(model.telling)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _in_steps(batches):
            found = _verdicts(shared.value, unpacked(part, stored))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, found)], ["doc_id", "quality_score", "toxic_score", "accepted"])

    return vectors.mapInArrow(_gives_back(scored), SCORES)


def accepted_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, all their columns, that are accepted (see ``quality_scores``)."""
    model, _ = fit(docs, labels)
    if model is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)
    extra = ["source_bucket", "lang_bucket"]
    while set(extra) & set(docs.columns):
        extra = [f"_{c}" for c in extra]
    buckets = _buckets(docs)

    def accepted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _in_steps(slices(batch)):
                seen = pa.RecordBatch.from_arrays([pc.fill_null(part.column("text"), ""), *(part.column(c) for c in extra)], ["text", "source_bucket", "lang_bucket"])
                yield part.filter(pa.array(_verdicts(shared.value, _stored_form(features(seen, shared.value.telling)))[2])).drop_columns(extra)

    return docs.select("*", *(b.alias(c) for b, c in zip(buckets, extra, strict=True))).mapInArrow(_gives_back(accepted), docs.schema)
