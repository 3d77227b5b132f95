"""Token files, counts and BPE against the libraries themselves."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from courtledger.llm import rans_tokens
from courtledger.llm.rans_tokens import Coder, frequencies, read_documents, write_tokens
from courtledger.llm.resync_counts import PieceCounts, spliced, token_counts
from courtledger.llm.tree_bpe import WordBpe, encode_and_decode
from courtledger.session import fresh_folder

WORD_FILE = public_tokenizers.path("word_bpe_49k.json")
PIECE_FILE = public_tokenizers.path("piece_bpe_32k.model")
BITS = ["a", "b", "the", "ing", "'s", "'re", "'", "é", "é", "W̊", "<|endoftext|>", "<|END", "1", "23", " ", "  ", "\n", " ", " ", "日本", "語", "한", "각", "!", "'t", "ſ", "İ", "ß", "Σς", "😀", "‍", "\x00", "\x1c", "\x85", "<|", "|>", "▁", "<0x0A>", "<s>"]


@pytest.fixture(scope="module")
def words():
    return WordBpe(WORD_FILE), Tokenizer.from_file(WORD_FILE)


@pytest.fixture(scope="module")
def pieces():
    return PieceCounts(PIECE_FILE)


def test_bpe_agrees_with_the_library(words):
    mine, library = words
    r = random.Random(1)
    for _ in range(600):
        text = "".join(r.choices(BITS, k=r.randint(0, 40)))
        expected = library.encode(text, add_special_tokens=False).ids
        assert mine.ids(text.encode()).tolist() == expected
        assert mine.by_tree(text, r.choice([3, 7, 20])).ids.tolist() == expected
        assert mine.decode(np.array(expected)) == library.decode(expected, skip_special_tokens=False)


def test_words_in_either_case_are_kept_once(words):
    mine, library = WordBpe(WORD_FILE), words[1]
    for text, kept in (("École ÉCOLE Über uber UBER été", 4), ("T\u0308 t\u0308 é T t", 5), ("<|endoftext|> É <|ENDOFTEXT|>", 3)):
        mine.forget()
        assert mine.ids(text.encode()).tolist() == library.encode(text, add_special_tokens=False).ids
        assert len(mine.words) == kept


@pytest.mark.parametrize("letters", [["a", "b", "the", "in", "g"], ["日", "本", "語"], ["é", "t", "io"], ["!", "?", "'"], ["1", "2"]])
def test_joins_in_text_without_blanks(words, letters):
    mine, library = words
    text = "".join(random.Random(2).choices(letters, k=3000))
    expected = library.encode(text, add_special_tokens=False).ids
    for leaf in (97, 400):
        assert mine.by_tree(text, leaf).ids.tolist() == expected


def _spliced(counts, text, size, overlap):
    step, chunks = size - overlap, []
    for begin in range(0, max(1, len(text) - overlap), step):
        chunks.append((begin, min(len(text), begin + size), *counts.chunk(text, begin, min(len(text), begin + size))))
    return spliced(counts, text, chunks, overlap)


def test_counts_agree_with_the_library(pieces):
    r = random.Random(3)
    for _ in range(600):
        text = "".join(r.choices(BITS, k=r.randint(0, 40)))
        expected = len(pieces.model.encode(text))
        assert pieces.count(text) == expected
        if len(text) > 12:
            assert _spliced(pieces, text, r.choice([6, 10]), r.choice([2, 4])) == expected


@pytest.mark.parametrize("letters", [["a", "b", "the", "in"], ["日", "本"], ["😀", "é"], ["a"], [" "]])
def test_splices_in_text_without_blanks(pieces, letters):
    text = "".join(random.Random(4).choices(letters, k=4000))
    assert _spliced(pieces, text, 300, 32) == len(pieces.model.encode(text))


def test_queries_on_odd_rows(spark, odd, words):
    library = words[1]
    piece = SentencePieceProcessor(model_file=PIECE_FILE)
    texts = [(r.doc_id, r.text or "") for r in odd.collect()]
    expected = sorted(((d, len(i), hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest()) for d, i in ((d, library.encode(t, add_special_tokens=False).ids) for d, t in texts)), key=str)
    got = encode_and_decode(odd, WORD_FILE, leaf_chars=500)
    assert sorted((tuple(r)[:3] for r in got.collect()), key=str) == expected
    counts = token_counts(odd, PIECE_FILE, chunk_chars=700, overlap=32)
    expected = sorted(((d, len(t.encode()), len(piece.encode(t)), len(piece.encode(t)) > 4096) for d, t in texts), key=str)
    assert sorted(map(tuple, counts.collect()), key=str) == expected
    for empty in (encode_and_decode(odd.limit(0), WORD_FILE), token_counts(odd.limit(0), PIECE_FILE)):
        assert empty.count() == 0


def test_encoded_outputs_round_trip(docs, words):
    row = encode_and_decode(docs([(1, "Hello, World!")]), WORD_FILE, outputs=True).first()
    ids = np.frombuffer(row.ids, "<u4").tolist()
    assert row.decoded == words[1].decode(ids, skip_special_tokens=False) and row.n_tokens == len(ids)


@pytest.mark.parametrize("n", [0, 1, 1023, 1024, 1025, 400_000])
def test_frames_round_trip(n):
    ids = np.random.default_rng(n).zipf(1.3, n) % 5000
    coder = Coder(frequencies(np.bincount(ids, minlength=5000) if n else np.ones(5000, int)))
    frame = coder.encode(ids)
    assert (coder.decode(frame) == ids).all()
    step = rans_tokens.CHECKPOINT_STEPS * rans_tokens.LANES
    assert (coder.decode(frame, first=1, last=2) == ids[step:2 * step]).all()
    damaged = bytearray(frame)
    damaged[len(frame) // 2] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        coder.decode(bytes(damaged))


def test_frequencies_fill_the_table():
    for counts in ([1], [0, 5, 0], [1] * 3000, [10**12, 1, 1, 0]):
        freq = frequencies(np.array(counts))
        assert freq.sum() == 1 << rans_tokens.SCALE and ((freq > 0) == (np.array(counts) > 0)).all()


def test_token_file(spark, odd, words, monkeypatch):
    monkeypatch.setattr(rans_tokens, "BLOCK_TOKENS", 40)
    folder = fresh_folder(spark, "test-tokens")
    write_tokens(odd, folder, WORD_FILE)
    rows = read_documents(spark, folder, with_ids=True).orderBy("start").collect()
    expected = sorted(
        ((r.doc_id is not None, r.doc_id or 0, words[1].encode(r.text or "", add_special_tokens=False).ids + [1]) for r in odd.collect()),
        key=lambda e: (e[0], e[1], np.array(e[2], "<u2").tobytes()),
    )
    start = 0
    for row, (_, _, ids) in zip(rows, expected, strict=True):
        data = np.array(ids, "<u4").tobytes()
        assert (row.start, row.n_tokens, row.ids_crc32, row.ids) == (start, len(ids), zlib.crc32(data), data)
        start += len(ids)
    empty = fresh_folder(spark, "test-tokens")
    write_tokens(odd.limit(0), empty, WORD_FILE)
    assert read_documents(spark, empty).count() == 0
