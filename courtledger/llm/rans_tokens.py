"""Token files coded with a static range asymmetric numeral system.

A file set is a folder with ``table`` (one frequency per token, shared by all
blocks) and ``blocks`` (Parquet, one frame per row). Documents lie in ascending
doc_id order: by shard, block and place. A frame codes whole documents in LANES
interleaved states and is independent of all others; it keeps checkpoints (lane
states and the place in the stream) and a checksum, so blocks, and stretches
within a block, decode in parallel.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from courtledger.llm.texts import slices
from courtledger.llm.tree_bpe import encoder
from courtledger.session import fresh_folder

SCALE = 20  # frequencies add up to 2**SCALE
LOW = 1 << 31  # states stay in LOW .. 2**63
LANES = 1024
BLOCK_TOKENS = 1 << 19
CHECKPOINT_STEPS = 128
HEAD = struct.Struct("<4sBxHIQQ")  # magic, scale, lanes, checkpoints, symbols, words
MAGIC = b"RTF1"
END_ID = 1


def frequencies(counts: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Counts scaled to 2**scale; every token that occurs keeps at least one part."""
    total = 1 << scale
    seen = np.flatnonzero(counts)
    freq = np.zeros(len(counts), np.int64)
    if not len(seen):
        return freq
    if len(seen) > total:
        raise ValueError(f"{len(seen)} tokens do not fit a table of {total} parts")
    share = counts[seen].astype(np.float64) / counts[seen].sum()
    freq[seen] = np.maximum(1, np.floor(share * total)).astype(np.int64)
    order = seen[np.argsort(-freq[seen], kind="stable")]
    rest = total - int(freq.sum())
    if rest > 0:
        freq[order[0]] += rest
    for token in order:
        if rest >= 0:
            break
        less = min(-rest, int(freq[token]) - 1)
        freq[token] -= less
        rest += less
    return freq


class Coder:
    """Encodes and decodes frames with one frequency table."""

    def __init__(self, freq: np.ndarray, scale: int = SCALE):
        self.scale = scale
        self.freq = freq.astype(np.uint64)
        self.begin = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq.astype(np.int64))

    def encode(self, ids: np.ndarray, lanes: int = LANES, every: int = CHECKPOINT_STEPS) -> bytes:
        """A frame: head, checkpoints, word counts up to them, words, checksum."""
        n = len(ids)
        steps = -(-n // lanes)
        state = np.full(lanes, LOW, np.uint64)
        words, points = [], []
        shift, whole = np.uint64(32), np.uint64(1 << self.scale)
        room = np.uint64((LOW >> self.scale) << 32)
        stretch = every * lanes
        for begin in range((steps - 1) // every * stretch, -1, -stretch):  # from one checkpoint back to the one before
            part = ids[begin:begin + stretch]
            freq, first = self.freq[part], self.begin[part]
            most, rest = freq * room, whole - freq
            for k in range((len(part) - 1) // lanes * lanes, -1, -lanes):
                here = slice(k, k + lanes)
                x = state[:len(freq[here])]
                full = np.flatnonzero(x >= most[here])
                high = x[full]
                words.append(high.astype("<u4"))  # its lower half
                x[full] = high >> shift
                x += x // freq[here] * rest[here] + first[here]
            points.append(state.copy())
        words.reverse()
        points.reverse()
        before = np.concatenate([[0], np.cumsum([len(w) for w in words])])[:-1:every] if steps else np.zeros(0)
        body = b"".join([
            HEAD.pack(MAGIC, self.scale, lanes, len(points), n, sum(map(len, words))),
            *(p.astype("<u8").tobytes() for p in points), before.astype("<u8").tobytes(), *(w.tobytes() for w in words),
        ])
        return body + struct.pack("<I", zlib.crc32(body))

    def decode(self, frame: bytes, every: int = CHECKPOINT_STEPS, first: int = 0, last: int | None = None) -> np.ndarray:
        """The ids between two checkpoints, all by default. Raises ValueError on a damaged frame."""
        if len(frame) < HEAD.size + 4 or zlib.crc32(memoryview(frame)[:-4]) != struct.unpack("<I", frame[-4:])[0]:
            raise ValueError("damaged frame: checksum")
        magic, scale, lanes, points, n, total = HEAD.unpack_from(frame)
        if magic != MAGIC or scale != self.scale:
            raise ValueError("not a frame of this table")
        states = np.frombuffer(frame, "<u8", points * lanes, HEAD.size).reshape(points, lanes)
        before = np.frombuffer(frame, "<u8", points, HEAD.size + 8 * points * lanes)
        stream = np.frombuffer(frame, "<u4", total, HEAD.size + 8 * points * (lanes + 1)).astype(np.uint64)
        last = points if last is None else min(last, points)
        if first >= last:
            return np.zeros(0, np.uint32)
        out = np.empty(min(n, last * every * lanes) - first * every * lanes, np.uint32)
        state, at = states[first].astype(np.uint64), int(before[first])
        mask, bits, shift, low = np.uint64((1 << scale) - 1), np.uint64(scale), np.uint64(32), np.uint64(LOW)
        for k in range(0, len(out), lanes):
            x = state[:min(lanes, len(out) - k)]
            slot = x & mask
            found = self.symbol[slot.view(np.int64)]
            out[k:k + len(x)] = found
            x = self.freq[found] * (x >> bits) + slot - self.begin[found]
            empty = np.flatnonzero(x < low)
            x[empty] = (x[empty] << shift) | stream[at:at + len(empty)]
            at += len(empty)
            state[:len(x)] = x
        return out


BLOCK = "shard int, block int, shard_start long, doc_ids array<long>, doc_tokens array<long>, frame binary"


def write_tokens(docs: DataFrame, folder: str, path: str, end_id: int = END_ID) -> None:
    """Encode every text and write the file set.

    docs: doc_id and text, other columns are ignored. Null text counts as empty
    and has the end id alone; a null doc_id comes first, and equal doc_ids lie in
    the order of their ids. An empty table gives an empty file set.
    """
    spark = docs.sparkSession

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], "<u4")
        with encoder(path, keep=True) as enc:
            for batch in batches:
                for part in slices(batch):
                    texts = part.column("text").cast(pa.large_binary()).to_pylist()
                    found = [np.concatenate([ids, end]).astype(narrow).tobytes() for ids in map(enc.ids, texts)]
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, pa.binary())], ["doc_id", "ids"])

    size = Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)
    narrow = "<u2" if size <= 1 << 16 else "<u4"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows.mapInArrow(tokens, "doc_id long, ids binary").write.parquet(f"{folder}/tokens")
    stored = spark.read.parquet(f"{folder}/tokens")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.int64)
        for batch in batches:
            column = batch.column("ids").cast(pa.large_binary())
            _, offsets, data = column.buffers()
            at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
            ids = np.frombuffer(data, np.uint8)[at[0]:at[-1]].view(narrow)
            for k in range(0, len(ids), BLOCK_TOKENS):
                counts += np.bincount(ids[k:k + BLOCK_TOKENS], minlength=size)
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(counts[seen], pa.int64())], ["token", "n"])

    counted = stored.select("ids").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    counts = np.zeros(size, np.int64)
    for token, n in counted.toPandas().itertuples(index=False):  # one row per token of the vocabulary
        counts[token] = n
    freq = frequencies(counts)
    table = pa.table({"token": pa.array(np.arange(size), pa.int64()), "freq": pa.array(freq, pa.int64())})
    spark.createDataFrame(table).coalesce(1).write.parquet(f"{folder}/table")
    shared = spark.sparkContext.broadcast(freq)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(shared.value)
        shard = TaskContext.get().partitionId()
        names, lengths, parts, filled, block, done = [], [], [], 0, 0, 0

        def frame() -> pa.RecordBatch:
            columns = [[shard], [block], [done], [names], [lengths], [coder.encode(np.concatenate(parts).astype(np.int64))]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["shard", "block", "shard_start", "doc_ids", "doc_tokens", "frame"])

        for batch in batches:
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                ids = np.frombuffer(ids.as_buffer(), narrow)
                names.append(doc_id)
                lengths.append(len(ids))
                parts.append(ids)
                filled += len(ids)
                if filled >= BLOCK_TOKENS:
                    yield frame()
                    names, lengths, parts, filled, block, done = [], [], [], 0, block + 1, done + filled
        if names:
            yield frame()

    # Rows of one doc_id, however many, are spread by how their ids begin.
    ordered = stored.repartitionByRange("doc_id", F.substring("ids", 1, 16)).sortWithinPartitions("doc_id", "ids")
    ordered.mapInArrow(blocks, BLOCK).write.parquet(f"{folder}/blocks")


def read_documents(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """Decode a file set: doc_id, start, n_tokens, ids_crc32 (and the ids)."""
    freq = np.zeros(0, np.int64)
    stored = spark.read.parquet(f"{folder}/table").toPandas().sort_values("token")
    freq = stored["freq"].to_numpy()
    shared = spark.sparkContext.broadcast(freq)
    frames = spark.read.schema(BLOCK).parquet(f"{folder}/blocks")

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(shared.value)
        for batch in batches:
            for k in range(batch.num_rows):
                shard, start = batch.column("shard")[k].as_py(), batch.column("shard_start")[k].as_py()
                doc_ids, lengths = batch.column("doc_ids")[k].as_py(), batch.column("doc_tokens")[k].as_py()
                ids = coder.decode(batch.column("frame")[k].as_py()).astype("<u4")
                ends = np.cumsum(lengths)
                if ends[-1] != len(ids):
                    raise ValueError("damaged block: document lengths")
                data = [ids[e - n:e].tobytes() for e, n in zip(ends, lengths, strict=True)]
                columns = {
                    "shard": pa.array([shard] * len(ends), pa.int32()),
                    "doc_id": pa.array(doc_ids, pa.int64()),
                    "in_shard": pa.array(start + ends - np.array(lengths), pa.int64()),
                    "n_tokens": pa.array(lengths, pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(d) for d in data], pa.int64()),
                }
                if with_ids:
                    columns["ids"] = pa.array(data, pa.binary())
                yield pa.RecordBatch.from_pydict(columns)

    schema = "shard int, doc_id long, in_shard long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    decoded = frames.mapInArrow(documents, schema)
    # One row per shard: the tokens before it.
    last = frames.groupBy("shard").agg(F.max(F.col("shard_start") + F.aggregate("doc_tokens", F.lit(0).cast("long"), lambda a, x: a + x)).alias("tokens"))
    before = last.select("shard", F.coalesce(F.sum("tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return decoded.join(before, "shard").select(
        "doc_id", (F.col("before") + F.col("in_shard")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] * with_ids)
    )


def token_file(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """Write the documents' ids to a new file set in the shared folder and read them back."""
    folder = fresh_folder(docs.sparkSession, "tokens")
    write_tokens(docs, folder, path, end_id)
    return read_documents(docs.sparkSession, folder)
