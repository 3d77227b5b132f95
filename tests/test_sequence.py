from pathlib import Path

from helpers import tuples, utc
from pyspark.sql import functions as F

from courtledger.operators import sequence
from courtledger.operators.sequence import resume_positions, running_sequence
from courtledger.session import broadcast_if_small, shared_folder
from courtledger.sources.dimensions import teams_frame


def _rows(spark, n=3000):
    """Two thirds of the rows belong to one team, half of those to one instant."""
    return spark.range(n).select(
        F.when(F.col("id") % 3 < 2, "hot").otherwise(F.concat(F.lit("t"), F.col("id") % 7))
        .alias("team"),
        F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 101).alias("at"),
        "id",
    )


def test_numbers_follow_the_order_for_any_partitioning(spark):
    expected = {}
    for team, at, row in sorted(tuples(_rows(spark))):
        expected.setdefault(team, []).append(row)
    for parts in (1, 13):
        got = running_sequence(_rows(spark).repartition(parts), "team", ["at", "id"])
        assert got.columns == ["team", "at", "id", "seq_number"]
        numbered = sorted(tuples(got), key=lambda row: (row[0], row[3]))
        found = {}
        for team, _, row, seq in numbered:
            found.setdefault(team, []).append(row)
            assert seq == len(found[team])
        assert found == expected


def test_a_hot_key_spans_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = _rows(spark).repartitionByRange("team", "at", "id")
        spread = placed.where("team = 'hot'").select(F.spark_partition_id()).distinct().count()
        numbered = running_sequence(_rows(spark), "team", ["at", "id"]).where("team = 'hot'")
        assert spread > 1
        assert sorted(r.seq_number for r in numbered.collect()) == list(range(1, 2001))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_numbers_continue_from_positions(spark):
    positions = spark.createDataFrame([("hot", 100), ("gone", 7)], "team string, position bigint")
    for costly in (False, True):
        got = running_sequence(
            _rows(spark, 30), "team", ["at", "id"], positions, costly_input=costly
        )
        firsts = {r.team: r.first for r in got.groupBy("team").agg(F.min("seq_number").alias("first")).collect()}
        assert firsts.pop("hot") == 101 and set(firsts.values()) == {1}


def test_offsets_too_many_to_broadcast(spark, monkeypatch):
    few = tuples(running_sequence(_rows(spark), "team", ["at", "id"]))
    monkeypatch.setattr(
        "courtledger.operators.sequence.broadcast_if_small", lambda df: broadcast_if_small(df, 0)
    )
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = running_sequence(_rows(spark), "team", ["at", "id"], partitions=9)
        assert "SortMergeJoin" in joined._jdf.queryExecution().executedPlan().toString()
        assert sorted(tuples(joined)) == sorted(few)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_rows_without_a_key_are_numbered(spark):
    rows = spark.createDataFrame([(None, 2), ("a", 1), (None, 1)], "team string, id bigint")
    got = running_sequence(rows, "team", ["id"])
    assert sorted(tuples(got), key=str) == [("a", 1, 1), (None, 1, 1), (None, 2, 2)]


def test_other_names_and_starts(spark):
    got = running_sequence(_rows(spark, 30), "team", ["at", "id"], name="sequence_nr", first=0)
    assert got.agg(F.min("sequence_nr")).first()[0] == 0


def test_costly_input_keeps_a_cache_of_the_caller(spark):
    rows = _rows(spark, 30).cache()
    running_sequence(rows, "team", ["at", "id"], costly_input=True).count()
    assert rows.is_cached
    rows.unpersist()


def test_resume_takes_the_newest_game_of_a_period_then_the_largest(spark):
    results = spark.createDataFrame([
        ("season-12-13", "okc", utc("2012-11-01"), 9),
        ("season-12-13", "okc", utc("2012-11-02"), 4),      # newest, though not the largest
        ("playoff-12-13", "okc", utc("2013-04-25"), 3),
        ("unknown", "okc", utc("2012-01-01"), 99),          # no calendar period
        ("season-12-13", "cle", utc("2012-11-02"), 1),
    ], "period string, team string, date timestamp, seq_number bigint")
    periods = spark.createDataFrame([("season-12-13",), ("playoff-12-13",)], "period string")
    teams = teams_frame(spark).where(F.col("team").isin("okc", "cle", "mia"))
    got = dict(tuples(resume_positions(results, teams, periods)))
    assert got == {"okc": 4, "cle": 1, "mia": 0}


def test_costly_input_is_in_no_executors_memory(spark, monkeypatch):
    """It is computed once, and what is kept in between is in the shared folder and gone afterwards."""
    runs, held, whole = spark.sparkContext.accumulator(0), [], sequence.checkpointed
    before = len(spark.sparkContext._jsc.getPersistentRDDs())

    @F.udf("bigint")
    def counted(at):
        runs.add(1)
        return at

    def noted(df):
        held.append(len(spark.sparkContext._jsc.getPersistentRDDs()))
        return whole(df)

    monkeypatch.setattr(sequence, "checkpointed", noted)
    rows = spark.createDataFrame([("a", n) for n in range(20)], "team string, id bigint").withColumn("x", counted("id"))
    got = running_sequence(rows, "team", ["id"], costly_input=True)
    assert sorted(tuples(got)) == [("a", n, n, n + 1) for n in range(20)]
    assert held == [before] and runs.value == 20
    assert not list(Path(shared_folder(spark)).glob("input-*"))
