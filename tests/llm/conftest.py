import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from courtledger.llm.workers import importable  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Documents from (doc_id, text[, lang]) tuples."""
    importable(spark)

    def build(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(full, DOCS)

    return build


@pytest.fixture
def odd(docs):
    """Nulls, blanks, ties, a repeated row, a long text, and columns with clashing names."""
    from pyspark.sql import functions as F

    rows = docs([
        (1, "The quick brown fox jumps over the lazy dog again and again today.", "en"),
        (1, "The quick brown fox jumps over the lazy dog again and again today.", "en"),
        (2, None, None), (3, "", "en"), (4, " \n\t ", "fr"), (None, "no id at all here", "en"),
        (None, None, None), (5, "x" * 70_000, "de"), (6, "Ünïcode ﬁ ½ 日本語 \U0001f600 é é", None),
        (7, "short", "en"), (8, "word " * 3_000, "en"),
    ])
    clashes = ["cls", "sig", "key", "spans", "doc_key", "text_key", "leaf", "n_tokens", "start", "row", "h", "match_id", "source_bucket", "kept"]
    return rows.withColumns({c: F.lit(c) for c in clashes})
