"""Language of texts by prediction by partial matching.

For each language a tree of byte contexts up to ORDER holds how often each byte
followed. A byte unseen in its longest context escapes to the next shorter one
(escape estimate: distinct bytes / (distinct bytes + all), bytes already offered
excluded), and at last to all bytes alike. The statistics are frozen, so the cost
in bits of a byte after a context is a table, and the code length of a text under
a language is the sum of its bytes' costs. The shortest code wins.

Each language has a tree of its own, which no other language changes. Languages
are scored in blocks whose tables fit a bound; with several blocks the documents
pass through one after the other, and the best code so far and the weight of the
others go with them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from courtledger.llm.texts import slices, text_bytes
from courtledger.session import fresh_folder

ORDER = 3
SAMPLE_DOCS = 1_000  # labelled documents per language, whole texts
PARTS = 64
MIN_CONTEXT = 16  # a longer context seen less often in a language is no node of its tree
TABLE_BYTES = 64 << 20  # of a block of languages; one language may take more, as its sample allows
START = 10  # every text begins after line feeds
UNKNOWN = "und"


def _contexts(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte the ORDER bytes before it, as one number, and the byte."""
    rows = len(at) - 1
    padded = np.full(len(raw) + ORDER * rows, START, np.uint8)
    place = np.arange(len(raw)) + ORDER * (np.repeat(np.arange(rows), np.diff(at)) + 1)
    padded[place] = raw
    context = np.zeros(len(raw), np.int64)
    for back in range(ORDER, 0, -1):
        context = context << 8 | padded[place - back]
    return context, raw.astype(np.int64)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, depth, context, byte, n of the sampled texts."""
    for batch in batches:
        for part in slices(batch):
            langs = part.column("lang").dictionary_encode()
            raw, at = text_bytes(part.column("text"))
            context, byte = _contexts(raw, at)
            lang = np.repeat(langs.indices.to_numpy(), np.diff(at)).astype(np.int64)
            for depth in range(ORDER + 1):
                own = context & ((1 << 8 * depth) - 1)
                keys, n = np.unique(lang << 40 | own << 8 | byte, return_counts=True)
                yield pa.RecordBatch.from_arrays([
                    langs.dictionary.take(pa.array(keys >> 40)), pa.array(np.full(len(keys), depth), pa.int32()),
                    pa.array(keys >> 8 & 0xFFFFFFFF, pa.int64()), pa.array(keys & 0xFF, pa.int32()), pa.array(n, pa.int64()),
                ], ["lang", "depth", "context", "byte", "n"])


class Tree:
    """A language's contexts, and the cost of each byte after each."""

    def __init__(self, nodes: list[tuple[int, int]], counts: np.ndarray):
        """nodes: (depth, context), shorter first, the root first of all, with every node's suffixes; counts: node, byte."""
        self.number = {node: k for k, node in enumerate(nodes)}
        parents = np.array([self.number[shorter(node)] if node[0] else -1 for node in nodes])
        own = counts.astype(np.float64)
        offered = np.zeros(own.shape, bool)
        chance, escape = np.zeros(own.shape), np.ones(len(nodes))
        at = np.arange(len(nodes))  # the context each node has come down to
        live = np.ones(len(nodes), bool)
        while live.any():
            seen = np.where(offered, 0, own[at])
            seen[~live] = 0
            kinds, total = (seen > 0).sum(axis=1), seen.sum(axis=1)
            some = kinds > 0
            share = np.where(some, escape / np.maximum(total + kinds, 1), 0)
            chance += share[:, None] * seen
            escape = np.where(some, escape * kinds / np.maximum(total + kinds, 1), escape)
            offered |= seen > 0
            up = parents[at]
            live &= up >= 0
            at = np.where(up >= 0, up, at)
        rest = (~offered).sum(axis=1)
        chance = np.where(offered, chance, (escape / np.maximum(rest, 1))[:, None])
        self.cost = -np.log2(np.maximum(chance, 1e-12)).astype(np.float32)


def shorter(node: tuple[int, int]) -> tuple[int, int]:
    """A context without its first byte."""
    depth, context = node
    return depth - 1, context & ((1 << 8 * (depth - 1)) - 1)


class Model:
    """The trees of a block of languages, and where any context leads in each."""

    def __init__(self, trees: dict[str, Tree]):
        self.languages, self.costs = list(trees), [t.cost.ravel() for t in trees.values()]
        self.nodes = sorted(set().union(*(t.number for t in trees.values())))
        place = {node: k for k, node in enumerate(self.nodes)}
        #: For every context of any tree its longest suffix in each.
        self.longest = np.zeros((len(trees), len(self.nodes)), np.int32)
        for row, tree in zip(self.longest, trees.values(), strict=True):
            for k, node in enumerate(self.nodes):
                row[k] = tree.number[node] if node in tree.number else row[place[shorter(node)]]

    def index(self) -> np.ndarray:
        """The longest context of any tree for every ORDER bytes."""
        by_depth: list[list[tuple[int, int]]] = [[] for _ in range(ORDER + 1)]
        for k, (depth, context) in enumerate(self.nodes):
            by_depth[depth].append((context, k))
        table = np.zeros(1, np.uint16 if len(self.nodes) <= 1 << 16 else np.int32)
        for depth in range(1, ORDER + 1):
            table = np.tile(table, 256)
            if by_depth[depth]:
                contexts, numbers = zip(*by_depth[depth], strict=True)
                table[list(contexts)] = numbers
        return table

    def lengths(self, index: np.ndarray, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Bits of each text under each language."""
        out = np.zeros((len(at) - 1, len(self.languages)))
        full = np.flatnonzero(np.diff(at))
        if len(full):
            context, byte = _contexts(raw, at)
            met = index[context]
            for lang, (cost, longest) in enumerate(zip(self.costs, self.longest, strict=True)):
                out[full, lang] = np.add.reduceat(cost[longest[met] << 8 | byte], at[full], dtype=np.float64)
        return out


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, table_bytes: int = TABLE_BYTES) -> list[Model]:
    """Learn from documents (doc_id, text, lang): blocks of languages in the order of their names.

    At most ``sample_docs`` documents of each language are read, those with the
    least hash of doc_id; rows with a null text or lang are left out.
    """
    usable = docs.where("lang is not null and text is not null and doc_id is not null")
    least = Window.partitionBy("lang").orderBy("h", "doc_id")
    # Most documents may be of one language: each of many parts is cut first.
    part = Window.partitionBy("lang", F.pmod("h", F.lit(PARTS))).orderBy("h", "doc_id")
    ids = usable.select("doc_id", "lang", F.xxhash64("doc_id").alias("h"))
    for window in (part, least):
        ids = ids.withColumn("k", F.row_number().over(window)).where(F.col("k") <= sample_docs).drop("k")
    ids = ids.select("doc_id", "lang")
    sample = usable.select("doc_id", "lang", "text").join(ids.distinct(), ["doc_id", "lang"], "left_semi").select("lang", "text")
    schema = "lang string, depth int, context long, byte int, n long"
    sampled = sample.mapInArrow(_counts, schema).groupBy("lang", "depth", "context", "byte").agg(F.sum("n").alias("n"))
    folder = fresh_folder(docs.sparkSession, "ppm")
    sampled.write.parquet(folder)
    counts = docs.sparkSession.read.schema(schema).parquet(folder)
    spark = docs.sparkSession
    totals = counts.groupBy("lang", "depth", "context").agg(F.sum("n").alias("seen")).where((F.col("depth") < 2) | (F.col("seen") >= MIN_CONTEXT))
    counts.join(totals, ["lang", "depth", "context"]).select("lang", "depth", "context", "byte", "n").write.parquet(f"{folder}-trees")
    trees = spark.read.schema(schema).parquet(f"{folder}-trees")
    sizes = dict(trees.select("lang", "depth", "context").distinct().groupBy("lang").count().collect())
    blocks: list[list[str]] = []
    room = 0
    for lang in sorted(sizes):
        room -= 1024 * sizes[lang]
        if room < 0:
            blocks.append([])
            room = table_bytes - 1024 * sizes[lang]
        blocks[-1].append(lang)
    return [Model({lang: _tree(trees.where(F.col("lang") == lang)) for lang in block}) for block in blocks]


def _tree(counts: DataFrame) -> Tree:
    """The tree of one language's counts, of which there are as many as its sample allows."""
    found = counts.select("depth", "context", "byte", "n").toArrow()
    depth, context, byte, n = (found.column(c).to_numpy() for c in ("depth", "context", "byte", "n"))
    nodes, number = np.unique(depth.astype(np.int64) << 32 | context, return_inverse=True)
    table = np.zeros((len(nodes), 256), np.int64)
    table[number, byte] = n
    return Tree([(int(v) >> 32, int(v) & 0xFFFFFFFF) for v in nodes], table)


BEST = "doc_id long, text string, lang_pred string, bits double, weight double"


def predict(docs: DataFrame, models: list[Model]) -> DataFrame:
    """doc_id, lang_pred and score of every whole text; only the text is looked at.

    A null text, or one without a letter, is ``und`` with score 0, as is every text
    if there is no model. The score is the share of the chosen language when each
    has weight 2**-bits. Ties go to the first language by name.
    """
    spark = docs.sparkSession
    best = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.lit(UNKNOWN).alias("lang_pred"),
        F.lit(float("inf")).alias("bits"), F.lit(0.0).alias("weight"),
    )
    for k, model in enumerate(models):
        last = k + 1 == len(models)
        best = best.mapInArrow(_better(spark.sparkContext.broadcast(model), last), BEST)
        if not last:
            folder = fresh_folder(spark, "ppm-scored")
            best.write.parquet(folder)
            best = spark.read.schema(BEST).parquet(folder)
    return best.select("doc_id", "lang_pred", F.when(F.col("weight") > 0, 1 / F.col("weight")).otherwise(F.lit(0.0)).alias("score"))


def _better(shared: Broadcast, last: bool) -> Callable:
    """The best language so far and this block's; weight: of all languages, that of the best being 1. The last needs no texts."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        index = model.index()
        letter = np.zeros(256, bool)
        letter[list(range(65, 91)) + list(range(97, 123))] = True
        for batch in batches:
            for part in slices(batch):
                raw, at = text_bytes(part.column("text"))
                langs = part.column("lang_pred").to_pylist()
                before, weight = (part.column(c).to_numpy(zero_copy_only=False).copy() for c in ("bits", "weight"))
                found = model.lengths(index, raw, at)
                first = found.argmin(axis=1)
                least = np.minimum(before, found.min(axis=1))
                share = np.exp2(np.maximum(least[:, None] - found, -1000)).sum(axis=1)
                share += np.where(weight > 0, weight * np.exp2(np.maximum(least - np.where(weight > 0, before, least), -1000)), 0)
                has = np.concatenate([[0], np.cumsum(letter[raw])])
                has = has[at[1:]] > has[at[:-1]]
                for k in range(part.num_rows):
                    if has[k] or any(map(str.isalpha, part.column("text")[k].as_py())):
                        if found[k, first[k]] < before[k]:
                            langs[k] = model.languages[first[k]]
                        before[k], weight[k] = least[k], share[k]
                texts = pa.nulls(part.num_rows, pa.string()) if last else part.column("text")
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), texts, pa.array(langs, pa.string()), pa.array(before, pa.float64()), pa.array(weight, pa.float64())], ["doc_id", "text", "lang_pred", "bits", "weight"])

    return scored


def held_out_languages(docs: DataFrame) -> DataFrame:
    """Learn on four fifths of the documents by crc32 of doc_id, predict all.

    docs: doc_id, text, lang; other columns are ignored. doc_id, held_out (null
    doc_id: false, and not learned from), lang_pred, score; one row per input row.
    """
    fold = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 5
    learned = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").where(fold != 0)
    found = predict(docs, fit(learned))
    return found.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")
