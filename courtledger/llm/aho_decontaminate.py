"""Benchmark passages in texts, found by one Aho-Corasick automaton over words.

Texts and items are read as words, lower-cased in ASCII. The automaton holds every
window of consecutive words of every item; a text is read through it once. Places
of hit words are mapped back to bytes of the original text.

The automaton is broadcast while the items are of PATTERN_BYTES or less; more
items go through several automata of at most that size, one after the other.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtledger.llm.texts import slices, text_bytes, words

WINDOW = 10
PATTERN_BYTES = 8 << 20

# Word bytes: digits, letters and all of other scripts; ASCII capitals become small.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
WORD_SEPARATORS = np.array([b == 32 for b in _TABLE])


def word_list(raw: bytes) -> list[bytes]:
    return raw.translate(_TABLE).split()


class Windows:
    """The automaton of one block of items: (item id, text) pairs."""

    def __init__(self, items: list[tuple[object, str]], window: int = WINDOW):
        self.number: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for item_id, text in items:
            ids = [self.number.setdefault(w, len(self.number) + 1) for w in word_list((text or "").encode())]
            for k in range(max(1, len(ids) - window + 1) if ids else 0):
                # An item without an id marks words but is not listed.
                owners.setdefault(tuple(ids[k:k + window]), set()).update([] if item_id is None else [str(item_id)])
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for pattern, ids in owners.items():
            self.automaton.add_word(pattern, (len(pattern), frozenset(ids)))
        self.empty = not owners
        if owners:
            self.automaton.make_automaton()

    def find(self, raw: bytes) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Number of words, runs [lo, hi) of hit words in order, items found."""
        text = word_list(raw)
        if self.empty or not text:
            return len(text), [], set()
        runs, items = [], set()
        for end, (size, ids) in self.automaton.iter(tuple(map(self.number.get, text, (0,) * len(text)))):
            items |= ids
            lo = end - size + 1
            while runs and lo <= runs[-1][1]:
                lo = min(lo, runs.pop()[0])
            runs.append((lo, end + 1))
        return len(text), runs, items


RUN = "struct<word_lo:long,word_hi:long,byte_lo:long,byte_hi:long>"
FOUND = f"doc_id long, text_key long, n_words long, runs array<{RUN}>, items array<string>"


def _merged(runs: list[dict]) -> list[dict]:
    """Runs of several automata as one ordered list without overlaps."""
    out: list[dict] = []
    for r in sorted(runs, key=lambda r: (r["word_lo"], r["word_hi"])):
        if out and r["word_lo"] <= out[-1]["word_hi"]:
            out[-1] = {"word_lo": out[-1]["word_lo"], "byte_lo": out[-1]["byte_lo"], "word_hi": max(out[-1]["word_hi"], r["word_hi"]), "byte_hi": max(out[-1]["byte_hi"], r["byte_hi"])}
        else:
            out.append(r)
    return out


def _scan(rows: DataFrame, items: list[tuple[object, str]], window: int) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(items)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(shared.value, window)
        kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("word_lo", "word_hi", "byte_lo", "byte_hi")]))
        for batch in batches:
            for part in slices(batch):
                counts, runs, names = [], [], []
                for k, raw in enumerate(part.column("text").cast(pa.large_binary()).to_pylist()):
                    n, hit, ids = windows.find(raw)
                    counts.append(n)
                    names.append(sorted(ids))
                    if hit:
                        starts, ends, _ = words(*text_bytes(part.column("text").slice(k, 1)), WORD_SEPARATORS)
                        hit = [{"word_lo": a, "word_hi": b, "byte_lo": int(starts[a]), "byte_hi": int(ends[b - 1])} for a, b in hit]
                    runs.append(hit)
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), part.column("text_key"), pa.array(counts, pa.int64()),
                    pa.array(runs, kind), pa.array(names, pa.list_(pa.string())),
                ], ["doc_id", "text_key", "n_words", "runs", "items"])

    return rows.mapInArrow(scan, FOUND)


def _blocks(benchmark: DataFrame, most: int) -> Iterator[list[tuple[object, str]]]:
    """All items in blocks of at most ``most`` bytes of text (a longer item alone), one at a time on the driver."""
    items = benchmark.select("item_id", "text").where("text is not null")
    block, size = [], 0
    for item_id, text in items.toLocalIterator():
        if block and size + len(text.encode()) > most:
            yield block
            block, size = [], 0
        block.append((item_id, text))
        size += len(text.encode())
    yield block


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, pattern_bytes: int = PATTERN_BYTES) -> DataFrame:
    """Occurrences of benchmark items in every whole text.

    docs: doc_id and text; benchmark: item_id and text; other columns are ignored.
    An item's windows are its runs of ``window`` words, or all its words if it has
    fewer; an item without words has none. One row per input row: doc_id,
    text_key, n_words, runs (maximal runs of words inside an occurrence, as word
    numbers and as bytes of the text) and items (ids found, as strings, in order).
    Null and empty texts have no words. Repeated items count once per id; the
    windows of an item with a null id mark words but name no item.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.coalesce("text", F.lit("")).alias("text"))
    found = [_scan(rows, block, window) for block in _blocks(benchmark, pattern_bytes)]
    if len(found) == 1:
        return found[0]
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    blocks = len(found)
    every = every.groupBy("doc_id", "text_key").agg(
        (F.count("*") / blocks).cast("int").alias("copies"), F.max("n_words").alias("n_words"),
        F.array_distinct(F.flatten(F.collect_set("runs"))).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = pa.array([_merged(r) for r in batch.column("runs").to_pylist()], batch.schema.field("runs").type)
            yield batch.set_column(batch.schema.names.index("runs"), "runs", runs)

    copies = every.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
    return copies.select("doc_id", "text_key", "n_words", "runs", "items").mapInArrow(merge, FOUND)


def uncontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, pattern_bytes: int = PATTERN_BYTES) -> DataFrame:
    """The documents, all their columns, without an occurrence of an item (see ``contamination``)."""
    kept = docs
    for block in _blocks(benchmark, pattern_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            windows = Windows(shared.value, window)
            for batch in batches:
                for part in slices(batch):
                    texts = part.column("text").cast(pa.large_binary()).to_pylist()
                    yield part.filter(pa.array([not windows.find(t or b"")[1] for t in texts], pa.bool_()))

        kept = kept.mapInArrow(clean, docs.schema)
    return kept


def contamination_digests(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every document."""
    n_hit = F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r["word_hi"] - r["word_lo"])
    found = contamination(docs, benchmark).withColumn("n_hit", n_hit)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )
