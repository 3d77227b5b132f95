"""An audit of how filters interact, from a potential over their coalitions.

Every document has one bit for each filter it fails. A coalition of filters is
worth the documents it removes; with five filters there are 32. The Hart and
Mas-Colell potential of that game is computed recursively, from the empty
coalition upward: |S| P(S) = v(S) + the potentials of S without one member.
A filter's Shapley value is the potential of all filters less the potential
without it, and what it removes at a step of an order is the difference of two
coalitions. Documents are counted by their bits before any of that.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtledger.llm.texts import slices
from courtledger.session import fresh_folder

#: The filters by letter, each what a document fails by.
FILTERS = {
    "A": "n_words < 100",
    "B": "100 * n_distinct < 80 * n_words",
    "C": "100 * n_capitals > 10 * n_points",
    "D": "has_symbol",
    "E": "is_copy",
}
COUNTS = ("n", "good", "toxic")


CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
FOLLOWING = bytes(range(0x80, 0xC0))  # bytes that begin no code point
SYMBOLS = re.compile(rb"[#$%&*|]")


def measure(text: bytes) -> tuple:
    """What the filters look at, of a text in UTF-8; bytes.split() knows just the six blanks of the words."""
    words = text.split()
    return (
        hashlib.sha256(text).digest(), len(words), len(set(words)), len(text) - len(text.translate(None, CAPITALS)),
        len(text.translate(None, FOLLOWING)), SYMBOLS.search(text) is not None,
    )


MEASURES = {"digest": pa.binary(), "n_words": pa.int64(), "n_distinct": pa.int64(), "n_capitals": pa.int64(), "n_points": pa.int64(), "has_symbol": pa.bool_()}


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, part, a digest of the text and the bits of all filters but the last."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))

    def measures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = zip(*map(measure, part.column("text").cast(pa.large_binary()).to_pylist()), strict=True)
                columns = [pa.array(values, kind) for values, kind in zip(found, MEASURES.values(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("part"), *columns], ["doc_id", "part", *MEASURES])

    found = rows.mapInArrow(measures, "doc_id long, part string, digest binary, n_words long, n_distinct long, n_capitals long, n_points long, has_symbol boolean")
    bits = F.lit(0)
    for k, name in enumerate("ABCD"):
        bits = bits.bitwiseOR(F.when(F.expr(FILTERS[name]), F.lit(1 << k)).otherwise(0))
    return found.select("doc_id", "part", "digest", bits.alias("bits"))


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, bits, and counts of documents: n, good and toxic.

    Texts are measured once, into a narrow table of the shared folder. A copy is a
    document with the text of a smaller doc_id. The least of a text is found by
    an aggregate and joined by text and doc_id, so that a text of very many
    documents is not one key. A null doc_id is no copy and makes none.
    """
    spark = docs.sparkSession
    path = fresh_folder(spark, "audit")
    table = measured(docs)
    table.write.parquet(path)
    rows = spark.read.schema(table.schema).parquet(path)
    known = rows.where(F.col("doc_id").isNotNull())
    first = known.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic")
    )
    copy = F.lit(1 << 4)
    told = known.join(first, ["doc_id", "digest"], "left").join(marks, "doc_id", "left").select(
        "part", F.when(F.col("first").isNull(), F.col("bits").bitwiseOR(copy)).otherwise(F.col("bits")).alias("bits"), "good", "toxic"
    )
    nameless = rows.where(F.col("doc_id").isNull()).select("part", "bits", F.lit(None).cast("int").alias("good"), F.lit(None).cast("int").alias("toxic"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0).cast("long")).alias(c)
    return told.union(nameless).groupBy("part", "bits").agg(F.count(F.lit(1)).alias("n"), total("good"), total("toxic"))


def coalitions(counted: DataFrame, n_filters: int) -> DataFrame:
    """part, and for each count an array of what every coalition removes, by its bits; size: all documents.

    counted: part, bits and the counts, at most one row for each set of bits.
    """
    every = F.explode(F.sequence(F.lit(0), F.lit((1 << n_filters) - 1)))
    met = F.col("bits").bitwiseAND(F.col("coalition")) != 0
    worth = counted.withColumn("coalition", every).groupBy("part", "coalition").agg(
        *(F.sum(F.when(met, F.col(c)).otherwise(0)).alias(c) for c in COUNTS), F.sum("n").alias("size")
    )
    ordered = F.array_sort(F.collect_list(F.struct("coalition", *COUNTS)))
    return worth.groupBy("part").agg(ordered.alias("v"), F.first("size").alias("size")).select(
        "part", "size", *(F.col(f"v.{c}").alias(c) for c in COUNTS)
    )


def potentials(worth: Column, n_filters: int) -> Column:
    """The potentials of all coalitions, times the factorial of the number of filters, by their bits.

    Every potential is a sum of dividends over sizes up to that number, so the
    multiples are whole.
    """
    scale = math.factorial(n_filters)
    members = F.lit([1 << k for k in range(n_filters)])

    def next_one(found: Column, s: Column) -> Column:
        inside = F.filter(members, lambda i: s.bitwiseAND(i) != 0)
        less = F.aggregate(inside, F.lit(0).cast("long"), lambda total, i: total + F.get(found, s - i))
        value = F.get(worth, s) * scale + less
        # Whole by construction; the division of longs is exact.
        return F.array_append(found, F.call_function("div", value, F.bit_count(s).cast("long")))

    return F.aggregate(F.sequence(F.lit(1), F.lit((1 << n_filters) - 1)), F.array(F.lit(0).cast("long")), next_one)


def audit(counted: DataFrame, filters: tuple[str, ...] = tuple(FILTERS)) -> DataFrame:
    """One row per part, order of the filters and step, zeros included.

    part, filter_order, step (from 1), kept, removed, redundant, unique_fails,
    good_lost, toxic_lost and shapley (over all orders together). ``filters``
    are one-letter names, the k-th for bit k. No documents: no rows.
    """
    n = len(filters)
    letters = "".join(filters)
    orders = F.split(F.lit(",".join(map("".join, permutations(letters)))), ",")
    bit = lambda name: F.expr(f"shiftleft(1, instr('{letters}', {name}) - 1)")
    games = coalitions(counted, n).withColumn("p", potentials(F.col("n"), n))
    steps = games.withColumn("filter_order", F.explode(orders)).select(
        "*", F.posexplode(F.split("filter_order", "")).alias("at", "name")
    ).withColumn("before", F.expr(
        f"aggregate(slice(split(filter_order, ''), 1, at), 0, (m, x) -> m | shiftleft(1, instr('{letters}', x) - 1))"
    )).withColumn("own", bit("name")).withColumn("after", F.col("before").bitwiseOR(F.col("own")))
    grand = (1 << n) - 1
    gain = lambda c: F.get(c, "after") - F.get(c, "before")
    return steps.select(
        "part", "filter_order", (F.col("at") + 1).alias("step"),
        (F.col("size") - F.get("n", "after")).alias("kept"), gain("n").alias("removed"),
        (F.get("n", "own") - gain("n")).alias("redundant"),
        (F.get("n", F.lit(grand)) - F.get("n", F.lit(grand) - F.col("own"))).alias("unique_fails"),
        gain("good").alias("good_lost"), gain("toxic").alias("toxic_lost"),
        (F.get("p", F.lit(grand)) - F.get("p", F.lit(grand) - F.col("own"))).alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five filters over documents, for each language.

    docs: doc_id, text and lang; labels: doc_id, quality and toxic. Other columns
    are ignored. Null text counts as empty, null lang as the empty string; a
    document without label is neither good nor toxic, one with several labels is
    what any of them says. Repeated rows count each; with equal doc_ids none
    makes the other a copy. A null doc_id has no label.
    """
    return audit(failures(docs, labels))
