"""Sets of numbers per key as half-open intervals (key, lo, hi).

A journal's consumed numbers are mostly one run per team, so intervals stay few
where a set of numbers would grow with the journal, and unlike a highest number
they remember what is missing below. No operation puts a key's numbers into one
task: numbers become runs bucket by bucket, and only the runs of a key meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from courtledger.session import broadcast_if_small, value_bytes

#: Numbers that are looked at together: those that agree but for this many bits.
BUCKET_BITS = 12
BUCKET = 1 << BUCKET_BITS


def _bucket(number: Column) -> Column:
    return F.shiftright(number, BUCKET_BITS)


def runs(rows: DataFrame, key: str, number: str) -> DataFrame:
    """The numbers of each key as the fewest intervals; rows without a key or number have none."""
    return merged(_runs_in_buckets(rows, key, number).drop("_bucket"), key)


def _runs_in_buckets(rows: DataFrame, key: str, number: str) -> DataFrame:
    """(key, _bucket, lo, hi): the same, bucket by bucket."""
    known = rows.where(F.col(key).isNotNull() & F.col(number).isNotNull()).select(key, F.col(number).cast("bigint").alias("_n"))
    sorted_numbers = F.array_sort(F.collect_set("_n"))
    buckets = known.groupBy(key, _bucket(F.col("_n")).alias("_bucket")).agg(sorted_numbers.alias("_all"))
    begins = F.filter("_all", lambda n, i: (i == 0) | (F.get("_all", i - 1) < n - 1))
    ends = F.filter("_all", lambda n, i: (i == F.size("_all") - 1) | (F.get("_all", i + 1) > n + 1))
    pieces = buckets.select(key, "_bucket", F.explode(F.arrays_zip(begins.alias("lo"), ends.alias("hi"))).alias("_run"))
    return pieces.select(key, "_bucket", F.col("_run.lo").alias("lo"), (F.col("_run.hi") + 1).alias("hi"))


def merged(intervals: DataFrame, key: str) -> DataFrame:
    """The same numbers as the fewest intervals; overlapping and touching ones become one."""
    in_order = Window.partitionBy(key).orderBy("lo", "hi")
    reached = F.max("hi").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.when(reached.isNull() | (F.col("lo") > reached), 1).otherwise(0)
    marked = intervals.where("lo < hi").select(key, "lo", "hi", apart.alias("_apart"))
    island = F.sum("_apart").over(in_order.rowsBetween(Window.unboundedPreceding, 0))
    return marked.select(key, "lo", "hi", island.alias("_island")).groupBy(key, "_island").agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi")
    ).drop("_island")


def without(rows: DataFrame, intervals: DataFrame, key: str, number: str) -> DataFrame:
    """Rows whose number is in no interval of their key.

    First the numbers alone meet the intervals; if none is in one, and a first
    reading has none, the rows are left as they are. Otherwise they meet what was
    found, as runs in buckets. Rows without key or number stay.
    """
    numbers = rows.select(F.col(key).alias("_key"), F.col(number).alias("_n"), _bucket(F.col(number)).alias("_at"))
    pieces = _pieces(intervals, numbers.select("_key", "_at").distinct(), key)
    inside = (
        (F.col("_key") == F.col("_of")) & (F.col("_at") == F.col("_cell"))
        & (F.col("_n") >= F.col("lo")) & (F.col("_n") < F.col("hi"))
    )
    found = _runs_in_buckets(numbers.join(pieces, inside, "left_semi"), "_key", "_n")
    size = value_bytes(found)
    if not size:
        return rows
    taken = (
        (F.col(key) == F.col("_key")) & (F.col("_row_bucket") == F.col("_bucket"))
        & (F.col(number) >= F.col("lo")) & (F.col(number) < F.col("hi"))
    )
    return rows.withColumn("_row_bucket", _bucket(F.col(number))).join(
        broadcast_if_small(found, size=size), taken, "left_anti"
    ).drop("_row_bucket")


#: An interval is looked up by cells of 2^(BUCKET_BITS + level * LEVEL_BITS) numbers, on the least level on which it touches few.
LEVEL_BITS, LEVELS = 6, 9


def _pieces(intervals: DataFrame, asked: DataFrame, key: str) -> DataFrame:
    """(_of, _cell, lo, hi): each interval with the buckets it touches, of a long one only those in ``asked`` (_key, _at).

    Buckets and intervals meet in an equi-join: an interval is in at most
    1 + 2^LEVEL_BITS cells, and on levels above the first few disjoint intervals
    share a cell, as each is longer than the cells are wide.
    """
    level = F.lit(LEVELS - 1)
    for n in reversed(range(LEVELS - 1)):
        level = F.when(F.col("hi") - F.col("lo") <= 1 << (BUCKET_BITS + (n + 1) * LEVEL_BITS), n).otherwise(level)
    spans = intervals.where("lo < hi").select(F.col(key).alias("_of"), "lo", "hi", level.alias("_level"))

    def cells(bits: Column) -> Column:
        ends = (F.call_function("shiftright", F.col(c), bits) for c in ("lo", "_last"))
        return F.explode(F.sequence(*ends)).alias("_cell")

    spans = spans.withColumn("_last", F.col("hi") - 1)
    short = spans.where("_level = 0").select("_of", cells(F.lit(BUCKET_BITS)), "lo", "hi")
    long = spans.where("_level > 0").select(
        "_of", "_level", cells(F.col("_level") * LEVEL_BITS + BUCKET_BITS), "lo", "hi"
    )
    levels = asked.select("_key", "_at", F.explode(F.sequence(F.lit(1), F.lit(LEVELS - 1))).alias("_on"))
    above = F.call_function("shiftright", F.col("_at"), F.col("_on") * LEVEL_BITS)
    begin = F.col("_at") * BUCKET
    touched = levels.join(
        long,
        (F.col("_key") == F.col("_of")) & (F.col("_on") == F.col("_level")) & (above == F.col("_cell"))
        & (begin < F.col("hi")) & (F.col("lo") - BUCKET < begin),
    )
    return short.unionByName(touched.select("_of", F.col("_at").alias("_cell"), "lo", "hi"))


def complete_up_to(intervals: DataFrame, key: str, first: int = 0) -> DataFrame:
    """(key, position): every number from ``first`` to below position is in the key's intervals."""
    return intervals.where((F.col("lo") <= first) & (F.col("hi") > first)).groupBy(key).agg(F.max("hi").alias("position"))
