"""Fill-in-the-middle texts, cut at lines that counts of shared chunks locate.

A rolling hash cuts a text into chunks where its last bytes say so, so equal
passages give equal chunks wherever they stand. What a chunk holds in lines and
code points is kept in a cache under the chunk's own bytes (a look-up compares
them, not only a hash). Adding up the counts of a text's chunks gives its number
of lines, and tells in which chunk the k-th line ends; only that chunk is
searched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtledger.llm.texts import seeded, slices

WINDOW = 32  # bytes the rolling hash looks at
CHUNK_BITS = 10  # chunks of about 1 024 bytes
LEAST_CHUNK, MOST_CHUNK = 256, 8_192
CACHE_BYTES = 32 << 20
STRETCH = 1 << 20

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

_GEAR = (seeded(13, 256) >> np.uint64(32)).astype(np.uint32)


class Summary(NamedTuple):
    """What a chunk holds: line ends, code points, and whether its last byte ends a line."""

    lines: int
    points: int
    closed: bool


def rolling_hash(raw: np.ndarray) -> np.ndarray:
    """The hash of the last WINDOW bytes at every byte, by doubling the bytes it covers."""
    h = _GEAR[raw]
    width = 1
    while width < WINDOW:
        h[width:] = h[width:] + (h[:-width] << np.uint32(width))
        width *= 2
    return h


def chunk_ends(raw: np.ndarray) -> list[int]:
    """Where the chunks of a text end.

    A chunk ends at the first byte from LEAST_CHUNK on whose hash has CHUNK_BITS
    zero bits, and after MOST_CHUNK bytes anyway.
    """
    places = []
    for start in range(0, len(raw), STRETCH):
        before = min(start, WINDOW - 1)
        h = rolling_hash(raw[start - before:start + STRETCH])[before:]
        places.append(np.flatnonzero(h >> np.uint32(32 - CHUNK_BITS) == 0) + start + 1)
    marks = np.concatenate(places) if places else np.zeros(0, np.int64)
    ends, last = [], 0
    while last < len(raw):
        k = np.searchsorted(marks, last + LEAST_CHUNK)
        end = int(marks[k]) if k < len(marks) else len(raw)
        last = min(end, last + MOST_CHUNK, len(raw))
        ends.append(last)
    return ends


def summary(chunk: bytes) -> Summary:
    whole = np.frombuffer(chunk, np.uint8)
    return Summary(chunk.count(b"\n"), int(np.count_nonzero((whole & 0xC0) != 0x80)), chunk.endswith(b"\n"))


class Chunks:
    """Summaries by content, in two generations bounded by their bytes.

    What is used moves to the new generation; when that is full the old one goes.
    """

    def __init__(self, most_bytes: int = CACHE_BYTES):
        self.most, self.held = most_bytes // 2, 0
        self.new: dict[bytes, Summary] = {}
        self.old: dict[bytes, Summary] = {}

    def __getitem__(self, chunk: bytes) -> Summary:
        found = self.new.get(chunk)
        if found is None:
            found = self.old.pop(chunk, None) or summary(chunk)
            if self.held + len(chunk) > self.most:
                self.old, self.new, self.held = self.new, {}, 0
            self.new[chunk] = found
            self.held += len(chunk)
        return found


class Layout:
    """A text as chunks with their counts added up."""

    def __init__(self, text: bytes, cache: Chunks):
        self.text = text
        ends = chunk_ends(np.frombuffer(text, np.uint8))
        self.starts = [0, *ends[:-1]] if ends else []
        found = [cache[text[a:b]] for a, b in zip(self.starts, ends, strict=True)]
        self.lines = np.concatenate([[0], np.cumsum([s.lines for s in found], dtype=np.int64)])
        self.points = np.concatenate([[0], np.cumsum([s.points for s in found], dtype=np.int64)])
        #: Lines of the text: those that end, and one more if the last does not.
        self.n = int(self.lines[-1]) + (not found[-1].closed if found else 0)

    def cut(self, units: int) -> tuple[int, int]:
        """The bytes and code points of the first lines."""
        if units == 0:
            return 0, 0
        if units > self.lines[-1]:
            return len(self.text), int(self.points[-1])
        k = int(np.searchsorted(self.lines, units)) - 1  # the line ends in this chunk
        at = self.starts[k]
        for _ in range(units - int(self.lines[k])):
            at = self.text.index(b"\n", at) + 1
        return at, int(self.points[k]) + summary(self.text[self.starts[k]:at]).points


def draws(seed: int, doc_id: int | None) -> list[int]:
    """Four numbers of a document: the first 32-bit groups of a SHA-256."""
    name = f"{seed}:{'' if doc_id is None else doc_id}"
    digest = hashlib.sha256(name.encode()).digest()
    return [int.from_bytes(digest[k:k + 4]) for k in range(0, 16, 4)]


def transformed(text: bytes, doc_id: int | None, cache: Chunks, seed: int, rate: int, spm: int, markers: tuple[bytes, ...]) -> tuple:
    """(n, form, prefix_chars, middle_chars, output) of a text."""
    whole = Layout(text, cache)
    h1, h2, h3, h4 = draws(seed, doc_id)
    if not text or any(m in text for m in markers) or h3 % 100 >= rate:
        return whole.n, "plain", None, None, text
    first, second = sorted((h1 % (whole.n + 1), h2 % (whole.n + 1)))
    (a, prefix_chars), (b, chars) = whole.cut(first), whole.cut(second)
    p, s, m = markers
    if h4 % 100 < spm:
        form, pieces = "spm", (s, text[b:], p, text[:a], m, text[a:b])
    else:
        form, pieces = "psm", (p, text[:a], s, text[b:], m, text[a:b])
    return whole.n, form, prefix_chars, chars - prefix_chars, b"".join(pieces)


def fill_in_middle(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50, markers: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> DataFrame:
    """Rearrange every text as prefix, middle and suffix of whole lines.

    docs: doc_id and text, other columns are ignored. One row per input row:
    doc_id, n (lines), form (``psm``, ``spm`` or ``plain``), prefix_chars and
    middle_chars (null if plain), output (the text with markers). ``rate`` of a
    hundred documents are rearranged, ``spm`` of a hundred of them with the
    suffix first; both, and the cuts, follow from ``seed`` and doc_id alone, so
    repeated rows give equal rows. Null text counts as empty; empty texts and
    texts that hold a marker stay as they are. A null doc_id draws as an empty
    name.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    marks = tuple(m.encode() for m in markers)

    def rearranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Chunks()  # of this task, gone with it
        for batch in batches:
            for part in slices(batch):
                texts = part.column("text").cast(pa.large_binary()).to_pylist()
                ids = part.column("doc_id").to_pylist()
                found = [transformed(t, d, cache, seed, rate, spm, marks) for t, d in zip(texts, ids, strict=True)]
                n, form, prefix, middle, output = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()),
                    pa.array(middle, pa.int64()), pa.array(output, pa.large_binary()).cast(pa.large_string()).cast(pa.string()),
                ], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return rows.mapInArrow(rearranged, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column, markers: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The text that an output of a form was made from; no piece holds a marker."""
    prefix, suffix, middle = markers
    size = {m: len(m) for m in markers}

    def between(after: str, until: str | None) -> Column:
        begin = F.locate(after, output) + size[after]
        length = F.locate(until, output) - begin if until else F.length(output)
        return F.substring(output, begin, length)

    psm = F.concat(between(prefix, suffix), between(middle, None), between(suffix, middle))
    spm = F.concat(between(prefix, middle), between(middle, None), between(suffix, prefix))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(found: DataFrame) -> DataFrame:
    """The transformation with digests of its outputs and of the texts restored from them."""
    return found.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )
