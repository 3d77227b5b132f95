"""A ledger of quality rules: every rule is evaluated once per document.

The ledger holds the measurements and one bit per failed rule. Policies are
versions of a mask of rules; applying one, or finding out what each of its rules
does alone, needs bitwise operations on the ledger only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtledger.llm.texts import SPACES, mix, seeded, slices, text_bytes, word_hashes, words

REPEAT_WINDOW = 5

#: Rules by bit, each a condition over the measurements that a document fails by.
RULES = {
    "few_words": "n_words < 10",
    "repeated_words": "100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "repeated_lines": "n_dup_lines > 2 and 100 * n_dup_lines > 30 * n_lines",
    "capitals": "2 * n_capitals > n_letters and n_letters > 0",
    "stutter": "5 * n_same_next > n_words",
    "word_length": "word_chars < 2 * n_words or word_chars > 15 * n_words",
}
BASE = ("few_words", "repeated_words")

#: Versions of the policy: the rules that a document must not fail.
POLICIES = {1: BASE, 2: (*BASE, "symbols", "repeated_lines"), 3: tuple(RULES)}
CURRENT = 3

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_same_next", "n_letters", "n_capitals")

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_CAPITAL = np.zeros(256, bool)
_CAPITAL[ord("A"):ord("Z") + 1] = True
_LETTER = _CAPITAL.copy()
_LETTER[ord("a"):ord("z") + 1] = True
_NEWLINE = np.arange(256) == 10


def mask(rules: tuple[str, ...]) -> int:
    names = list(RULES)
    return sum(1 << names.index(r) for r in set(rules))


def _in_row(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The number of flags in each row."""
    sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return sums[at[1:]] - sums[at[:-1]]


def _again(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys occur more than once in their row, and which of them come after the first."""
    order = np.lexsort((keys, rows))
    same = (keys[order][1:] == keys[order][:-1]) & (rows[order][1:] == rows[order][:-1])
    later, several = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order[1:]] = same
    several[order[1:]] = same
    several[order[:-1]] |= same
    return several, later


def measure(part: pa.RecordBatch) -> dict[str, np.ndarray]:
    """The measurements of whole texts."""
    raw, at = text_bytes(part.column("text"))
    rows = part.num_rows
    starts, ends, row = words(raw, at, SPACES)
    hashes = word_hashes(raw, starts, ends)
    out = {"n_words": np.bincount(row, minlength=rows)}
    points = np.concatenate([[0], np.cumsum(((raw & 0xC0) != 0x80) & ~SPACES[raw])])
    out["word_chars"] = points[at[1:]] - points[at[:-1]]
    out |= {name: _in_row(table[raw], at) for name, table in (("n_symbols", _SYMBOL), ("n_letters", _LETTER), ("n_capitals", _CAPITAL))}
    # Lines with a word: equal bytes, blanks included, within one text.
    lstarts, lends, lrow = words(raw, at, _NEWLINE)
    first, after = np.searchsorted(starts, lstarts), np.searchsorted(starts, lends)
    full = after > first
    lines = word_hashes(raw, lstarts, lends)[full]
    out["n_lines"] = np.bincount(lrow[full], minlength=rows)
    out["n_dup_lines"] = np.bincount(lrow[full][_again(lines, lrow[full])[1]], minlength=rows)
    # Words inside windows that occur twice.
    inside = np.zeros(len(hashes) + 1, np.int64)
    if len(hashes) >= REPEAT_WINDOW:
        n = len(hashes) - REPEAT_WINDOW + 1
        factors = seeded(5, REPEAT_WINDOW) | np.uint64(1)
        window = mix(sum(hashes[k:n + k] * factors[k] for k in range(REPEAT_WINDOW)))
        own = np.flatnonzero(row[:n] == row[REPEAT_WINDOW - 1:])
        twice = own[_again(window[own], row[own])[0]]
        np.add.at(inside, twice, 1)
        np.add.at(inside, twice + REPEAT_WINDOW, -1)
    out["n_repeat_words"] = np.bincount(row[np.cumsum(inside[:-1]) > 0], minlength=rows)
    same = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
    out["n_same_next"] = np.bincount(row[1:][same], minlength=rows)
    return out


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements, and failed: one bit per rule.

    docs: doc_id and text, other columns are ignored. One row per input row, also
    for repeated ones. Null, empty and blank texts have no words: all
    measurements are 0 and only ``few_words`` fails.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = measure(part)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(found[m], pa.int64()) for m in MEASURES)], ["doc_id", *MEASURES])

    measures = rows.mapInArrow(measured, "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES))
    failed = F.lit(0).cast("long")
    for bit, condition in enumerate(RULES.values()):
        failed = failed.bitwiseOR(F.when(F.expr(condition), F.lit(1 << bit)).otherwise(0).cast("long"))
    return measures.withColumn("failed", failed)


def verdicts(book: DataFrame, version: int = CURRENT) -> DataFrame:
    """The ledger with base_failed and kept under a policy version."""
    return book.withColumns({
        "base_failed": F.col("failed").bitwiseAND(F.lit(mask(BASE))) != 0,
        "kept": F.col("failed").bitwiseAND(F.lit(mask(POLICIES[version]) | mask(BASE))) == 0,
    })


def ablations(book: DataFrame, versions: dict[int, tuple[str, ...]] | None = None) -> DataFrame:
    """What each rule does within each policy version.

    version, rule, n_docs, n_kept, n_failing (documents that fail the rule) and
    n_only (documents that would be kept without this rule). The ledger is first
    counted by its bits, of which there are at most 2**rules.
    """
    by_bits = book.groupBy("failed").agg(F.count("*").alias("n"))
    names = list(RULES)
    rules = [
        F.struct(F.lit(v).alias("version"), F.lit(r).alias("rule"), F.lit(mask(policy)).cast("long").alias("mask"), F.lit(1 << names.index(r)).cast("long").alias("bit"))
        for v, policy in (versions or POLICIES).items() for r in policy
    ]
    met = F.col("failed").bitwiseAND(F.col("mask"))
    count = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))
    return by_bits.select("*", F.inline(F.array(*rules))).groupBy("version", "rule").agg(
        F.sum("n").alias("n_docs"), count(met == 0).alias("n_kept"),
        count(F.col("failed").bitwiseAND(F.col("bit")) != 0).alias("n_failing"), count(met == F.col("bit")).alias("n_only"),
    )
