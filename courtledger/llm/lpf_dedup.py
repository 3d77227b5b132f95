"""Repeated passages of whole texts: which bytes have an earlier (or any other) copy.

A byte is repeated when a string of LENGTH bytes over it also starts elsewhere.
That is the longest-previous-factor question cut at LENGTH: among the suffixes
that share their first LENGTH bytes - neighbours in suffix order - the previous
smaller position is an earlier match. Only equality up to LENGTH bytes matters,
so suffixes are put into such classes by hash instead of being sorted, from
coarse to fine, each step looking only at what the step before left open:

1. Every window of LENGTH bytes has an anchor, its least-hashed piece of CORE
   bytes. Neighbouring windows with one anchor are a run. An anchor that occurs
   once has no repeated window.
2. Runs equal as a whole are repeated in all windows. Where an anchor has several
   different runs, these are cut into nodes of at most 16 windows, at fixed
   distances from the anchor; what all windows of a node share must occur twice.
3. Nodes equal as a whole are repeated; where several differ they are cut into
   nodes of 4 windows, and these into single windows. Of equal runs or nodes one
   stands for all in the next step.

Each class is counted where it is found, so a passage in a third of all texts
meets as one count per task. Hashes have 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtledger.llm.hash_filter import contains, hash_filter
from courtledger.llm.texts import mix, seeded, slices, text_bytes
from courtledger.session import fresh_folder

LENGTH = 200
WINDOWS = 128  # a power of two: windows that may share an anchor
CORE = LENGTH - WINDOWS + 1
LEVELS = (16, 4, 1)  # windows of a node
STRETCH = 1 << 18  # windows looked at in one step; places take 21 bits

_BYTE = seeded(21, 256)
_BASE = int(seeded(22, 1)[0]) | 1


def _powers(base: int) -> np.ndarray:
    out = np.full(STRETCH + 2 * LENGTH, np.uint64(base))
    out[0] = 1
    return np.cumprod(out)


_UP, _DOWN = _powers(_BASE), _powers(pow(_BASE, -1, 2**64))


class Stretch:
    """Windows of consecutive texts: anchors, runs and hashes of byte ranges."""

    def __init__(self, raw: np.ndarray, at: np.ndarray):
        n = len(raw)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[raw] * _DOWN[:n], out=self.sums[1:])
        pieces = mix(self.ranges(np.arange(n - CORE + 1), np.arange(CORE, n + 1)))
        low = np.uint64((1 << 21) - 1)
        key = (pieces & ~low) | np.arange(len(pieces), dtype=np.uint64)
        for step in (1, 2, 4, 8, 16, 32, 64):
            key = np.minimum(key[:-step], key[step:])
        # Windows inside one text.
        starts = np.arange(len(key))
        row = np.searchsorted(at, starts, side="right") - 1
        inside = starts + LENGTH <= at[row + 1]
        windows, anchors = starts[inside], (key & low).astype(np.int64)[inside]
        new = np.ones(len(windows), bool)
        new[1:] = (anchors[1:] != anchors[:-1]) | (windows[1:] != windows[:-1] + 1)
        first = np.flatnonzero(new)
        self.row = row[windows[first]]
        self.lo, self.hi = windows[first], windows[np.append(first, len(windows))[1:] - 1]
        self.anchor = anchors[first]
        self.core = pieces[self.anchor]

    def ranges(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A hash of each byte range, whatever its place."""
        return (self.sums[end] - self.sums[begin]) * _UP[begin]

    def run_keys(self) -> np.ndarray:
        shape = ((self.anchor - self.lo) << 8 | (self.hi - self.lo)).astype(np.uint64)
        return mix(self.core ^ mix(self.ranges(self.lo, self.hi + LENGTH) + shape))

    def nodes(self, size: int, run: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, ...]:
        """The windows lo..hi of each run cut into nodes of ``size``.

        Run, first and last window, key of the bytes that all windows of the
        full node share, key of all bytes of the windows that are there.
        """
        first, last = (self.anchor[run] - hi) // size, (self.anchor[run] - lo) // size
        count = last - first + 1
        each = np.repeat(np.arange(len(run)), count)
        node = np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count) + first[each]
        run, lo, hi = run[each], lo[each], hi[each]
        near, far = node * size, node * size + size - 1  # distances to the anchor
        anchor = self.anchor[run]
        lo, hi = np.maximum(anchor - far, lo), np.minimum(anchor - near, hi)
        name = mix(self.core[run] + (node << 8 | size).astype(np.uint64))
        common = mix(name ^ mix(self.ranges(anchor - near, anchor - far + LENGTH)))
        shape = ((anchor - lo) << 8 | (hi - lo)).astype(np.uint64)
        return run, lo, hi, common, mix(~common ^ mix(self.ranges(lo, hi + LENGTH) + shape))

    def levels(self, cores: np.ndarray, opened: list[np.ndarray], names: Callable) -> Iterator[tuple[np.ndarray, ...]]:
        """Runs of repeated anchors, then the nodes of each level in those that stand for others.

        Each level is run, first and last window, common key and key; ``names``
        gives the name of an occurrence from its key, run and first window.
        """
        run = np.flatnonzero(contains(cores, self.core))
        found = run, self.lo[run], self.hi[run], self.core[run], self.run_keys()[run]
        yield found
        for size, bitmap in zip(LEVELS, opened, strict=False):
            run, lo, hi, _, key = found
            loose = contains(bitmap, names(key, run, lo))
            found = self.nodes(size, run[loose], lo[loose], hi[loose])
            yield found


def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Stretch, np.ndarray]]:
    """Rows, their windows, and what to add to a place to get the place in the row's text."""
    for batch in batches:
        for part in slices(batch, most=STRETCH):
            raw, at = text_bytes(part.column("text"))
            for k in range(0, len(raw) - LENGTH + 1, STRETCH):  # more than one only for one long text
                piece = raw[k:k + STRETCH + LENGTH - 1]
                yield part, Stretch(piece, np.clip(at - k, 0, len(piece))), k - at[:-1]


def _name(key: np.ndarray, doc_key: np.ndarray, text_key: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """A name for one occurrence of a key."""
    place = mix(doc_key.view(np.uint64) ^ mix(text_key.view(np.uint64) + lo.astype(np.uint64)))
    return mix(key ^ place)


def _names(part: pa.RecordBatch, s: Stretch, shift: np.ndarray) -> tuple[Callable, Callable]:
    """Functions of runs and windows in a stretch: where they are in the table, and their names."""
    doc_key, text_key = (part.column(c).to_numpy() for c in ("doc_key", "text_key"))

    def places(run: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, ...]:
        row = s.row[run]
        return doc_key[row], text_key[row], lo + shift[row]

    return places, lambda key, run, lo: _name(key, *places(run, lo))


def _cores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, s, _ in stretches(batches):
        core, n = np.unique(s.core, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(core.view(np.int64)), pa.array(n, pa.int64())], ["core", "n"])


PLACE = ("doc_key", "text_key", "lo")


def _keys(cores: Broadcast, opened: list[Broadcast], keep_first: bool) -> Callable:
    """The keys of the level below those that are known, their numbers, and one occurrence of each.

    That is the first place if ``keep_first``, else the least name.
    """
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, s, shift in stretches(batches):
            places, names = _names(part, s, shift)
            *_, (run, lo, _, common, key) = s.levels(cores.value, [b.value for b in opened], names)
            extra = places(run, lo) if keep_first else (names(key, run, lo).view(np.int64),)
            order = np.lexsort((*extra[::-1], key, common))
            new = np.ones(len(order), bool)
            new[1:] = (key[order][1:] != key[order][:-1]) | (common[order][1:] != common[order][:-1])
            first = np.flatnonzero(new)
            n = np.diff(np.append(first, len(order)))
            columns = [c[order][first] for c in (common.view(np.int64), key.view(np.int64), *extra)]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in (*columns, n))], ["core", "key", *(PLACE if keep_first else ("name",)), "n"])
    return keys


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key and place -> name."""
    for batch in batches:
        key, *place = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        yield pa.RecordBatch.from_arrays([pa.array(_name(key.view(np.uint64), *place).view(np.int64))], ["name"])


def _items(cores: Broadcast, equal: list[Broadcast], opened: list[Broadcast]) -> Callable:
    """Places of everything that may be repeated: runs, and nodes of every level."""

    def items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, s, shift in stretches(batches):
            places, names = _names(part, s, shift)
            kept = []
            for bitmap, (run, lo, hi, _, key) in zip(equal, s.levels(cores.value, [b.value for b in opened], names), strict=True):
                take = contains(bitmap.value, key)
                kept.append([c[take] for c in (run, lo, hi, key)])
            run, lo, hi, key = (np.concatenate(c) for c in zip(*kept, strict=True))
            doc_key, text_key, begin = places(run, lo)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in (doc_key, text_key, key.view(np.int64), begin, begin + hi - lo))], ["doc_key", "text_key", "key", "lo", "hi"])
    return items


def _keyed(docs: DataFrame) -> DataFrame:
    """A key for every document: equal rows share it."""
    doc_id = F.col("doc_id").cast("long")
    return docs.select(
        doc_id.alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(doc_id, F.lit(-1)).alias("doc_key"), F.xxhash64(doc_id, "text").alias("text_key"),
    )


def repeated_spans(docs: DataFrame, keep_first: bool) -> DataFrame:
    """doc_key, text_key and spans, the byte ranges [lo, hi) to remove, of documents that have any."""
    spark = docs.sparkSession
    folder = fresh_folder(spark, "repeats")

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    rows = _keyed(docs).where(F.octet_length("text") >= LENGTH).select("text", "doc_key", "text_key")
    counts = rows.select("text").mapInArrow(_cores, "core long, n long").groupBy("core").agg(F.sum("n").alias("n"))
    cores = hash_filter(counts.where("n > 1"), "core")
    one = PLACE if keep_first else ("name",)
    chosen = F.min(F.struct(*one) if keep_first else F.col("name")).alias("one")
    schema = ", ".join(f"{c} long" for c in ("core", "key", *one, "n"))
    equal, opened = [], []
    for level in range(len(LEVELS) + 1):
        found = rows.mapInArrow(_keys(cores, opened, keep_first), schema)
        keys = stored(found.groupBy("core", "key").agg(F.sum("n").alias("n"), chosen), f"keys-{level}")
        equal.append(hash_filter(keys.where("n > 1"), "key"))
        if level < len(LEVELS):
            # Where different keys share an anchor or common bytes, their windows may still be equal;
            # if all of them are repeated anyway, that matters only for which copy is the first.
            several = keys.groupBy("core").agg(F.count("*").alias("d"), F.min("n").alias("least")).where("d > 1" if keep_first else "d > 1 and least = 1")
            stand = keys.join(several.select("core"), "core", "left_semi")
            names = stand.select("key", "one.*").mapInArrow(_named, "name long") if keep_first else stand.select(F.col("one").alias("name"))
            opened.append(hash_filter(names, "name"))
    found = rows.mapInArrow(_items(cores, equal, opened), "doc_key long, text_key long, key long, lo long, hi long")
    found = stored(found, "places")
    first = [F.min(F.struct("doc_key", "text_key", "lo")).alias("first")] if keep_first else []
    spans = found.join(found.groupBy("key").agg(F.count("*").alias("n"), *first).where("n > 1"), "key")
    if keep_first:
        same = (F.col("doc_key") == F.col("first.doc_key")) & (F.col("text_key") == F.col("first.text_key"))
        spans = spans.where(~same | (F.col("lo") >= F.col("first.lo") + LENGTH))
    spans = spans.select("doc_key", "text_key", "lo", (F.col("hi") + LENGTH).alias("hi")).distinct()
    return spans.groupBy("doc_key", "text_key").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))


def _stays(spans: pa.Scalar, size: int) -> np.ndarray | None:
    """Which bytes stay; None if all do."""
    if not spans.is_valid:
        return None
    edges = np.zeros(size + 1, np.int64)
    lo, hi = spans.values.flatten()
    np.add.at(edges, lo.to_numpy(), 1)
    np.add.at(edges, hi.to_numpy(), -1)
    return np.cumsum(edges[:-1]) == 0


DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def repeat_digests(docs: DataFrame, keep_first: bool = False) -> DataFrame:
    """What removing repeated bytes leaves of every document.

    docs: doc_id and text, other columns are ignored. One row per input row:
    doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and the SHA-256 of
    the bytes that stay. A byte goes if a string of LENGTH bytes over it also
    starts anywhere else, in the same document or another; judged on the input.
    With ``keep_first`` only later copies go (see ``without_repeats``). Null
    text counts as empty; a text shorter than LENGTH stays whole.
    """

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = []
                for text, spans in zip(part.column("text").cast(pa.large_binary()), part.column("spans"), strict=True):
                    raw = np.frombuffer(text.as_buffer(), np.uint8)
                    stays = _stays(spans, len(raw))
                    if stays is None:
                        found.append((len(raw), 0, 0, hashlib.sha256(raw.tobytes()).hexdigest()))
                    else:
                        n_spans = int(np.count_nonzero(np.diff((~stays).astype(np.int8), prepend=0) == 1))
                        found.append((len(raw), int((~stays).sum()), n_spans, hashlib.sha256(raw[stays].tobytes()).hexdigest()))
                columns = [pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    rows = _keyed(docs).join(repeated_spans(docs, keep_first), ["doc_key", "text_key"], "left")
    return rows.select("doc_id", "text", "spans").mapInArrow(digests, DIGEST)


def without_repeats(docs: DataFrame, keep_first: bool = True) -> DataFrame:
    """The documents, all their columns, with repeated bytes removed from text.

    The copy that comes first by doc_id and place stays, unless ``keep_first`` is
    false; within one document a copy must not overlap the first. Equal rows
    (doc_id and text) count as one document here. A character cut by the edge of a
    removed run goes with it. Null text stays null.
    """
    spans = repeated_spans(docs, keep_first)
    extra = ["doc_key", "text_key", "spans"]
    while set(extra) & set(docs.columns):
        extra = [f"_{c}" for c in extra]
    doc_id = F.col("doc_id").cast("long")
    keyed = docs.withColumns({extra[0]: F.coalesce(doc_id, F.lit(-1)), extra[1]: F.xxhash64(doc_id, "text")})

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, spans in zip(batch.column("text"), batch.column(extra[2]), strict=True):
                raw = np.frombuffer(text.as_buffer(), np.uint8) if text.is_valid else np.zeros(0, np.uint8)
                stays = _stays(spans, len(raw))
                texts.append(text.as_py() if stays is None else raw[stays].tobytes().decode("utf-8", "ignore"))
            at = batch.schema.names.index("text")
            yield batch.set_column(at, "text", pa.array(texts, batch.schema.field("text").type)).drop_columns(extra[2])

    joined = keyed.join(spans.toDF(*extra), extra[:2], "left").drop(*extra[:2])
    return joined.select(*docs.columns, extra[2]).mapInArrow(remove, docs.schema)
