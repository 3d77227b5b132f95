import random

from helpers import final_plan, tuples

from courtledger.operators import numbers
from courtledger.operators.numbers import BUCKET, complete_up_to, merged, runs, without

ROWS = "team string, n bigint, other string"
SETS = "team string, lo bigint, hi bigint"


def _runs_by_hand(numbers):
    found = []
    for n in sorted(set(numbers)):
        if found and found[-1][1] == n:
            found[-1][1] = n + 1
        else:
            found.append([n, n + 1])
    return [tuple(r) for r in found]


def _rows(seed):
    r = random.Random(seed)
    rows = []
    for team in ("okc", "cle", "mia"):
        for _ in range(12):
            start = r.choice([0, 3, BUCKET - 2, BUCKET, 5 * BUCKET - 1, 1 << 40, (1 << 60) + 1])
            rows += [(team, start + k, "x") for k in range(r.randint(1, 9))]
    return rows


def test_runs_are_the_fewest_intervals(spark):
    rows = _rows(1) + [("long", n, "x") for n in range(3, 3 * BUCKET + 7)]
    odd = [(None, 1, "x"), ("okc", None, "x"), *rows[:20]]      # no key, no number, repeated
    got = sorted(tuples(runs(spark.createDataFrame(rows + odd, ROWS), "team", "n").select("team", "lo", "hi")))
    expected = sorted((t, *run) for t in ("okc", "cle", "mia", "long") for run in _runs_by_hand([n for k, n, _ in rows if k == t]))
    assert got == expected
    assert ("long", 3, 3 * BUCKET + 7) in got
    assert runs(spark.createDataFrame([], ROWS), "team", "n").count() == 0


def test_merged(spark):
    sets = [("a", 0, 5), ("a", 5, 9), ("a", 2, 3), ("a", 20, 30), ("a", 25, 26), ("a", 7, 7), ("b", 1, 2), ("b", 1, 2), ("a", 10, 12)]
    got = sorted(tuples(merged(spark.createDataFrame(sets, SETS), "team")))
    assert got == [("a", 0, 9), ("a", 10, 12), ("a", 20, 30), ("b", 1, 2)]


def test_without_is_a_difference_of_sets(spark):
    rows, past = _rows(2), _rows(2)[::3] + _rows(3)
    known = runs(spark.createDataFrame(past, ROWS), "team", "n")
    taken = {(t, n) for t, n, _ in past}
    odd = [(None, 3, "x"), ("okc", None, "x"), ("new", 3, "x")]
    got = without(spark.createDataFrame(rows + odd, ROWS), known, "team", "n")
    assert got.columns == ["team", "n", "other"]
    assert sorted(tuples(got), key=str) == sorted([r for r in rows if r[:2] not in taken] + odd, key=str)


def test_a_long_finished_past_costs_nothing(spark):
    past = spark.createDataFrame([("okc", 0, 1 << 50), ("okc", (1 << 50) + 5, 1 << 60)], SETS)
    rows = spark.createDataFrame([("okc", (1 << 50) + k, "x") for k in range(-3, 8)], ROWS)
    got = without(rows, past, "team", "n").select("n")
    assert sorted(n - (1 << 50) for (n,) in tuples(got)) == [0, 1, 2, 3, 4]


def test_complete_up_to(spark):
    sets = spark.createDataFrame([("a", 0, 7), ("a", 9, 11), ("b", 1, 5), ("c", 0, 1)], SETS)
    assert sorted(tuples(complete_up_to(sets, "team"))) == [("a", 7), ("c", 1)]


def test_buckets_do_not_meet_every_interval(spark):
    """A key with many buckets and many intervals: they are compared where they touch, not each with each."""
    past = spark.range(0, 400).selectExpr("'okc' AS team", f"id * {BUCKET} AS lo", f"id * {BUCKET} + 2 AS hi")
    asked = spark.range(0, 400).selectExpr("'okc' AS _key", "id AS _at")
    long = spark.createDataFrame([("okc", 5, 100 * BUCKET), ("okc", 1 << 40, 1 << 50)], SETS)
    got = sorted(tuples(numbers._pieces(past.unionByName(long), asked, "team")))
    short = [("okc", n, n * BUCKET, n * BUCKET + 2) for n in range(400)]
    assert got == sorted(short + [("okc", n, 5, 100 * BUCKET) for n in range(100)])
    rows = spark.createDataFrame([("okc", n * BUCKET + k, "x") for n in range(0, 400, 50) for k in (1, 2)], ROWS)
    seen = []
    plan = numbers.value_bytes

    def noted(df):
        seen.append(final_plan(df))
        return plan(df)

    numbers.value_bytes = noted
    try:
        left = without(rows, past, "team", "n")
    finally:
        numbers.value_bytes = plan
    assert sorted(n for _, n, _ in tuples(left)) == [n * BUCKET + 2 for n in range(0, 400, 50)]
    assert "_cell" in seen[0] and "NestedLoop" not in seen[0] and "Cartesian" not in seen[0]


def test_rows_are_left_as_they_are_if_none_is_known(spark):
    rows = spark.createDataFrame([("okc", 7, "x")], ROWS)
    past = spark.createDataFrame([("okc", 0, 7), ("okc", 8, 9), ("cle", 7, 8)], SETS)
    assert without(rows, past, "team", "n") is rows
