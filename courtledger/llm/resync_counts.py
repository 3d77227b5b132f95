"""Token counts of whole texts, huge ones by overlapping chunks.

A huge document is cut into chunks that overlap; each is encoded by itself with
the place of every token. Neighbours are spliced at a token that both have at
the same place: adjacent pairs left of it are the encoder's own in the left
chunk, right of it in the right chunk, and that makes the spliced sequence the
encoding of the whole. Without such a token the overlap is doubled and encoded
again. Other texts split where no piece of the vocabulary can reach across: after
a character other than a blank and before a blank.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from courtledger.llm.texts import slices

CHUNK_CHARS = 65_536
OVERLAP = 256
CACHED_WORDS = 400_000
TOKEN_LIMIT = 4_096
BLANK = "▁"  # stands for a blank inside pieces

SEGMENT = re.compile("^[^ ]+| +[^ ]*")


class PieceCounts(dict):
    """Token counts of blank-led segments; a missing one is encoded on first use."""

    def __init__(self, path: str):
        super().__init__()
        self.model = SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        across = any(BLANK in p.lstrip(BLANK) for p in pieces)
        blanks = [len("".join(self.model.encode(t, out_type=str))) for t in ("a", "  a ")]
        self.splits = not across and blanks == [2, 5]  # one blank put in front, none taken away
        self.blank = 1 if BLANK in pieces else len(BLANK.encode())
        # Places are in characters: a piece has as many as it shows, a blank included;
        # a character without a piece is a run of byte pieces.
        self.byte = [self.model.is_byte(i) for i in range(len(pieces))]
        self.value = [int(p[3:5], 16) if b else -1 for p, b in zip(pieces, self.byte, strict=True)]
        self.width = np.array([0 if b else len(p) for p, b in zip(pieces, self.byte, strict=True)])
        # The first byte piece of a character counts for it, the next ones count nothing.
        for i, v in enumerate(self.value):
            if v >= 0 and v & 0xC0 != 0x80:
                self.width[i] = 1

    def __missing__(self, segment: str) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        # Only a last blank by itself leaves an empty segment.
        self[segment] = n = len(self.model.encode(segment)) if segment else self.blank
        return n

    def count(self, text: str) -> int:
        """Tokens of a text that is encoded in one go."""
        if not self.splits:
            return len(self.model.encode(text))
        text = text.replace(BLANK, " ")
        parts = text.split(" ")
        if "" in parts:
            # The encoder puts one blank in front, so each blank-led segment gives one up.
            parts = [p[1:] if k else p for k, p in enumerate(SEGMENT.findall(text))]
        return sum(map(self.__getitem__, parts))

    def chunk(self, text: str, begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of text[begin:end] encoded by itself, and where each begins in the text."""
        ids = np.array(self.model.encode(text[begin:end].replace(BLANK, " ")), np.int64)
        width = self.width[ids]
        starts = np.cumsum(width) - np.maximum(width, 1)
        return ids, np.maximum(begin, starts + begin - 1)  # less the blank put in front


def shared_token(left: tuple, right: tuple, low: int, high: int) -> tuple[int, int] | None:
    """Places in both sequences of the first token in low..high that they share."""
    (lids, lat), (rids, rat) = left, right
    for j in range(int(np.searchsorted(rat, low)), int(np.searchsorted(rat, high))):
        i = int(np.searchsorted(lat, rat[j]))
        if i < len(lat) and lat[i] == rat[j] and lids[i] == rids[j] and rat[j - 1] < rat[j]:
            return i, j
    return None


@lru_cache(maxsize=2)
def counter(path: str) -> PieceCounts:
    """One counter for a Python worker."""
    return PieceCounts(path)


def spliced(counts: PieceCounts, text: str, chunks: list[tuple[int, int, np.ndarray, np.ndarray]], overlap: int = OVERLAP) -> int:
    """Tokens of the text from its chunks (begin, end, ids, places)."""
    if not any(counts.byte):
        return counts.count(text)  # places are not known without byte pieces
    _, end, ids, at = chunks[0]
    for start, next_end, *right in chunks[1:]:
        reach = overlap
        # The blank put in front of a chunk touches its first tokens only.
        while not (found := shared_token((ids, at), right, start + 1, end)):
            if start == 0:
                ids, at = right
                break
            reach *= 2
            start = max(0, end - reach)
            right = counts.chunk(text, start, next_end)
        else:
            i, j = found
            ids, at = np.concatenate([ids[:i], right[0][j:]]), np.concatenate([at[:i], right[1][j:]])
        end = next_end
    return len(ids)


COUNTS = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def token_counts(docs: DataFrame, path: str, limit: int = TOKEN_LIMIT, chunk_chars: int = CHUNK_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """Bytes and tokens of every whole text.

    docs: doc_id and text, other columns are ignored. One row per input row, also
    for repeated ones; null text counts as empty: no bytes, no tokens.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = F.length("text")

    def table(doc_ids, n_bytes, n_tokens) -> pa.RecordBatch:
        n_tokens = pa.array(n_tokens, pa.int64())
        return pa.RecordBatch.from_arrays([doc_ids, pa.array(n_bytes, pa.int64()), n_tokens, pc.greater(n_tokens, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counter(path)
        for batch in batches:
            for part in slices(batch):
                column = part.column("text")
                yield table(part.column("doc_id"), pc.binary_length(column), [counts.count(t) for t in column.to_pylist()])

    step = chunk_chars - overlap

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, key, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text_key", "text")), strict=True):
                for k in range(max(1, -(-(len(text) - overlap) // step))):
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array([d], pa.int64()), "text_key": [key], "chunk": pa.array([k], pa.int32()), "text": [text[k * step:k * step + chunk_chars]]})

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counter(path)
        for batch in batches:
            for part in slices(batch):
                found = [counts.chunk(t, 0, len(t)) for t in part.column("text").to_pylist()]
                extra = [pa.array([f[k].astype("<i8").tobytes() for f in found], pa.binary()) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*part.columns, *extra], [*part.schema.names, "ids", "places"])

    def joined(group: pa.Table) -> pa.Table:
        counts = counter(path)
        held, copies = {}, 0
        for row in group.to_pylist():
            copies += row["chunk"] == 0
            held[row["chunk"]] = row
        order = sorted(held)
        text = "".join(held[k]["text"][overlap if k else 0:] for k in order)
        chunks = [
            (k * step, k * step + len(held[k]["text"]), np.frombuffer(held[k]["ids"], "<i8"), np.frombuffer(held[k]["places"], "<i8") + k * step)
            for k in order
        ]
        n = spliced(counts, text, chunks, overlap)
        return pa.Table.from_batches([table(pa.array([held[0]["doc_id"]] * copies, pa.int64()), [len(text.encode())] * copies, [n] * copies)])

    whole = rows.where(size <= chunk_chars).mapInArrow(short, COUNTS)
    keys = "doc_id long, text_key long, chunk int, text string"
    pieces = rows.where(size > chunk_chars).withColumn("text_key", F.xxhash64("text")).mapInArrow(cut, keys)
    places = pieces.repartition("doc_id", "text_key", "chunk").mapInArrow(encoded, keys + ", ids binary, places binary")
    return whole.unionByName(places.groupBy("doc_id", "text_key").applyInArrow(joined, COUNTS))
