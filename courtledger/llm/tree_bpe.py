"""BPE encoding and decoding with joins of independently encoded halves.

White space always ends a token of this tokenizer, so a text is a list of words
that are encoded apart; equal words of a task are encoded once. What has no
white space for long, or a document too long for one step, is cut into leaves
that different tasks encode. Neighbours are then joined pairwise up a tree: a
window around the join is encoded anew and grows until it shares a token, at the
same place, with the left encoding and with the right one. Any token sequence
in which every adjacent pair is what the encoder makes of that pair is the
encoding of the whole, so a shared token on each side proves the join.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from courtledger.llm.texts import slices
from courtledger.llm.workers import give_back

LEAF_CHARS = 65_536
WORD_BYTES = 4_096  # longer runs without white space are joined from leaves
WORD_CACHE_BYTES = 128 << 20  # of a Python worker
ENTRY_BYTES = 160  # of an entry besides its contents
FIRST_WINDOW = 64

PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
BEYOND_LATIN_1 = re.compile(b"[\xc4-\xff]")
PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")


def _byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if printable, else one from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    letters = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [letters[b] for b in range(256)]


class Node:
    """A stretch of text with its tokens and where they begin and end."""

    def __init__(self, text: str, ids: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        self.text, self.ids, self.starts, self.ends = text, ids, starts, ends


class Recent(dict):
    """Encodings of words, made on first use, in two generations bounded by their bytes.

    When the new generation is full it becomes the old one, and what was in that
    and has not been used since goes.
    """

    def __init__(self, make: Callable[[bytes], bytes], most_bytes: int):
        super().__init__()
        self.make, self.most, self.held = make, most_bytes // 2, 0
        self.old: dict[bytes, bytes] = {}

    def __missing__(self, key: bytes) -> bytes:
        found = self.old.pop(key, None)
        if found is None:
            found = self.make(key)
        size = len(key) + len(found) + ENTRY_BYTES
        if size > self.most:
            return found
        if self.held + size > self.most:
            self.old, self.held = dict(self), 0
            self.clear()
        self[key] = found
        self.held += size
        return found


class WordBpe:
    """Ids of words as bytes, kept for the words met last."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.dtype = np.dtype("<u4")
        # Every special string of this tokenizer begins so; a text with it is encoded by the library.
        if not all(t.content.startswith("<|") for t in self.tokenizer.get_added_tokens_decoder().values()):
            raise ValueError("a special token that does not begin with <|")
        self.letters = _byte_letters()
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.tokens = [self.tokenizer.id_to_token(i) or "" for i in range(size)]
        self.as_bytes = [np.array([i], self.dtype).tobytes() for i in range(size)]
        self.words = Recent(self.word, WORD_CACHE_BYTES)

    def word(self, word: bytes) -> bytes:
        if len(word) > WORD_BYTES:
            return self.by_tree(word.decode("utf-8", "replace")).ids.astype(self.dtype).tobytes()
        text = word.decode("utf-8", "replace")
        if text.isascii() and text.isalpha():
            return self.piece(text.lower())  # letters alone are one piece
        if not PLAIN.fullmatch(text) or "<|" in text:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()
        return b"".join(map(self.piece, PIECES.findall(text.lower())))

    def piece(self, piece: str) -> bytes:
        if not piece.isascii():
            piece = "".join(map(self.letters.__getitem__, piece.encode()))
        return b"".join([self.as_bytes[t.id] for t in self.model.tokenize(piece)])

    def forget(self) -> None:
        self.words.clear()
        self.words.old, self.words.held = {}, 0

    def ids(self, raw: bytes) -> np.ndarray:
        """Ids of a whole text given as UTF-8."""
        # Beyond Latin-1 what follows a letter may combine with one of its cases alone.
        if b"<|" not in raw and (raw.isascii() or not BEYOND_LATIN_1.search(raw)):
            raw = raw.lower()
        return np.frombuffer(b"".join(map(self.words.__getitem__, raw.split())), self.dtype)

    def decode(self, ids: np.ndarray) -> str:
        """As the library without a decoder: the tokens with blanks between."""
        return " ".join(map(self.tokens.__getitem__, ids.tolist()))

    def node(self, text: str) -> Node:
        """The library's encoding with places."""
        e = self.tokenizer.encode(text, add_special_tokens=False)
        spans = np.array(e.offsets, np.int64).reshape(-1, 2)
        return Node(text, np.array(e.ids, np.int64), spans[:, 0], spans[:, 1])

    def by_tree(self, text: str, leaf: int = WORD_BYTES) -> Node:
        """Halves down to leaves, encoded apart and joined again."""
        leaves = [self.node(text[i:i + leaf]) for i in range(0, len(text), leaf)] or [self.node("")]
        return self.join_all(leaves)

    def join_all(self, nodes: list[Node]) -> Node:
        while len(nodes) > 1:
            nodes = [self.join(*nodes[i:i + 2]) if i + 1 < len(nodes) else nodes[i] for i in range(0, len(nodes), 2)]
        return nodes[0]

    def join(self, left: Node, right: Node) -> Node:
        cut, text = len(left.text), left.text + right.text
        reach = FIRST_WINDOW
        while True:
            begin = _window_start(text, left, cut - reach)
            end = min(cut + reach, len(text))
            window = self.node(text[begin:end])
            starts, ends = window.starts + begin, window.ends + begin
            i = 0 if begin == 0 else _shared(text, window.ids, starts, ends, left, 0, cut)
            j = len(starts) if end == len(text) else _shared(text, window.ids, starts, ends, right, cut, end - 8)
            if i is not None and j is not None and i <= j:
                keep_left = np.searchsorted(left.starts, starts[i]) if begin and i < len(starts) else 0
                keep_right = len(right.starts) if j == len(starts) else np.searchsorted(right.starts, starts[j] - cut)
                return Node(
                    text,
                    np.concatenate([left.ids[:keep_left], window.ids[i:j], right.ids[keep_right:]]),
                    np.concatenate([left.starts[:keep_left], starts[i:j], right.starts[keep_right:] + cut]),
                    np.concatenate([left.ends[:keep_left], ends[i:j], right.ends[keep_right:] + cut]),
                )
            reach *= 2


def _letter(c: str) -> bool:
    """A letter that never combines with what stands before it."""
    return unicodedata.category(c)[0] == "L" and not unicodedata.combining(c) and not "ᅠ" <= c <= "ᇿ"


def _apart(text: str, at: int) -> bool:
    """Whether the encoding right of ``at`` depends on the left only by the word it is in."""
    if at == 0 or text[at - 1] in " \t\n\r\v\f":
        return True
    return at < len(text) and _letter(text[at - 1]) and _letter(text[at]) and "'" not in text[max(0, at - 3):at]


def _window_start(text: str, left: Node, before: int) -> int:
    k = int(np.searchsorted(left.starts, before, side="right")) - 1
    while k > 0 and not _apart(text, int(left.starts[k])):
        k -= 1
    return int(left.starts[k]) if k > 0 else 0


def _shared(text: str, ids, starts, ends, side: Node, low: int, high: int) -> int | None:
    """The first window token in ``low..high`` that ``side`` has too."""
    base = low if low else 0
    at = np.searchsorted(side.starts, starts - base)
    for k in np.flatnonzero((starts >= low) & (ends <= high) & (at < len(side.starts))):
        a = at[k]
        same = side.starts[a] == starts[k] - base and side.ends[a] == ends[k] - base and side.ids[a] == ids[k]
        if same and ends[k] > starts[k] and _apart(text, int(starts[k])) and (a + 1 == len(side.starts) or side.starts[a + 1] >= side.ends[a]) and (a == 0 or side.ends[a - 1] <= side.starts[a]):
            return int(k)
    return None


_kept: dict[str, WordBpe] = {}


@contextmanager
def encoder(path: str, keep: bool = False) -> Iterator[WordBpe]:
    """An encoder for one task; its memory is given back when the task ends.

    With ``keep`` the next task of this Python worker finds it with its words.
    """
    made = _kept.pop(path, None) or WordBpe(path)
    if keep:
        _kept[path] = made
    try:
        yield made
    finally:
        if not keep:
            made.forget()
            give_back()


def _digests(enc: WordBpe, ids: np.ndarray) -> tuple[int, str, str]:
    decoded = enc.decode(ids).encode("utf-8", "surrogatepass")
    return len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(decoded).hexdigest()


RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
ENCODED = "doc_id long, n_tokens long, ids binary, decoded string"


def encode_and_decode(
    docs: DataFrame, path: str, leaf_chars: int = LEAF_CHARS, outputs: bool = False, keep_words: bool = False
) -> DataFrame:
    """Encode every text and decode the ids again.

    docs: doc_id and text, other columns are ignored. One row per input row:
    doc_id, n_tokens, and digests of the ids (little-endian unsigned 32 bit) and
    of the decoded text, or with ``outputs`` the ids and the text themselves.
    Null text counts as empty and has no tokens; repeated rows give repeated
    rows. Texts over ``leaf_chars`` are cut into leaves that are encoded by
    different tasks and joined per document. With ``keep_words`` a Python worker
    keeps the words of its last tasks, which costs it some memory afterwards.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    schema = ENCODED if outputs else RESULT
    size = F.length("text")

    def result(enc: WordBpe, ids: np.ndarray) -> tuple:
        if outputs:
            return len(ids), ids.astype("<u4").tobytes(), enc.decode(ids)
        return _digests(enc, ids)

    names = ("n_tokens", "ids", "decoded") if outputs else ("n_tokens", "ids_sha256", "decoded_sha256")
    kinds = (pa.int64(), pa.binary() if outputs else pa.string(), pa.string())

    def table(doc_ids, found: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds)]
        return pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), *columns], ["doc_id", *names])

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with encoder(path, keep_words) as enc:
            for batch in batches:
                for part in slices(batch):
                    texts = part.column("text").cast(pa.large_binary()).to_pylist()
                    yield table(part.column("doc_id"), [result(enc, enc.ids(t)) for t in texts])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, key, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text_key", "text")), strict=True):
                for i in range(0, len(text), leaf_chars):
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array([d], pa.int64()), "text_key": [key], "leaf": pa.array([i // leaf_chars], pa.int32()), "text": [text[i:i + leaf_chars]]})

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with encoder(path) as enc:
            for batch in batches:
                for part in slices(batch):
                    nodes = [enc.by_tree(t) if " " not in t else enc.node(t) for t in part.column("text").to_pylist()]
                    extra = [pa.array([getattr(n, f).astype("<i8").tobytes() for n in nodes], pa.binary()) for f in ("ids", "starts", "ends")]
                    yield pa.RecordBatch.from_arrays([*part.columns, *extra], [*part.schema.names, "ids", "starts", "ends"])

    def joined(group: pa.Table) -> pa.Table:
        rows = {}
        copies = 0
        for row in group.to_pylist():
            copies += row["leaf"] == 0
            rows[row["leaf"]] = row
        nodes = [Node(rows[k]["text"], *(np.frombuffer(rows[k][f], "<i8") for f in ("ids", "starts", "ends"))) for k in sorted(rows)]
        with encoder(path) as enc:
            found = result(enc, enc.join_all(nodes).ids)
        return pa.Table.from_batches([table([rows[0]["doc_id"]] * copies, [found] * copies)])

    whole = rows.where(size <= leaf_chars).mapInArrow(short, schema)
    pieces = rows.where(size > leaf_chars).withColumn("text_key", F.xxhash64("text")).mapInArrow(cut, "doc_id long, text_key long, leaf int, text string")
    # A number of partitions of its own: adaptive execution must not put all leaves of a text into one task.
    tasks = max(2, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    encoded = pieces.repartition(tasks, "doc_id", "text_key", "leaf").mapInArrow(leaves, "doc_id long, text_key long, leaf int, text string, ids binary, starts binary, ends binary")
    return whole.unionByName(encoded.groupBy("doc_id", "text_key").applyInArrow(joined, schema))
