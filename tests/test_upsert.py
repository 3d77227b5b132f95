from pathlib import Path

import pyarrow.parquet as pq
import pytest
from helpers import final_plan, scans, tuples, utc
from pyspark.sql import functions as F
from pyspark.sql import types as T

from courtledger.operators import upsert
from courtledger.operators.upsert import (
    _live, append_batch, commit_version, compact, insert_if_absent, install_dimensions, install_tables, latest,
    read_latest, read_table, stored_teams, table_path,
)
from courtledger.schemas import CAMPAIGN, DAILY, LEADERS, PLAYERS, RESULTS, TABLES, TEAMS


def _results(spark, rows):
    """(period, team, day, score, seq) rows of the results table."""
    full = [
        (period, team, "l", score, "por", "l", 1, utc(day), seq, seq)
        for period, team, day, score, seq in rows
    ]
    schema = T.StructType([*RESULTS.schema.fields, T.StructField("event_seq", T.LongType())])
    return spark.createDataFrame(full, schema)


def _scores(spark, root):
    rows = read_latest(spark, RESULTS, root).select("period", "team", "score")
    return sorted(tuples(rows))


def test_install_is_repeatable_and_empty(spark, tmp_path):
    for _ in range(2):
        install_tables(spark, str(tmp_path))
    for table in TABLES:
        rows = read_latest(spark, table, str(tmp_path))
        assert rows.columns == table.columns and rows.count() == 0
    append_batch(_results(spark, [("s", "okc", "2016-01-01", 1, 1)]), RESULTS, str(tmp_path), 0)
    install_tables(spark, str(tmp_path))
    assert len(_scores(spark, str(tmp_path))) == 1


def test_newest_row_of_a_key_wins(spark, tmp_path):
    root = str(tmp_path)
    install_tables(spark, root)
    first = _results(spark, [
        ("s", "okc", "2016-01-01", 1, 1), ("s", "okc", "2016-01-01", 2, 2),
        ("s", "cle", "2016-01-01", 3, 1), ("p", "cle", "2016-01-01", 4, 2),
    ])
    second = _results(spark, [("s", "okc", "2016-01-01", 5, 3)])
    append_batch(first, RESULTS, root, 0)
    append_batch(second, RESULTS, root, 1)
    expected = [("p", "cle", 4), ("s", "cle", 3), ("s", "okc", 5)]
    assert _scores(spark, root) == expected

    append_batch(first, RESULTS, root, 0)             # replayed, and late
    append_batch(second, RESULTS, root, 1)
    assert _scores(spark, root) == expected
    assert read_table(spark, RESULTS, root).count() == 10

    compact(spark, RESULTS, root, ["s"])              # the other period stays as it is
    assert _scores(spark, root) == expected
    live = [(p.period, p.is_base) for p in _live(spark, table_path(root, RESULTS))]
    assert sorted(live) == [("p", False), ("s", True)]
    for _ in range(2):
        compact(spark, RESULTS, root)                 # deletes what was retired
    assert sorted(tuples(read_table(spark, RESULTS, root).groupBy("period").count())) == [
        ("p", 1), ("s", 2)
    ]
    append_batch(second, RESULTS, root, 1)
    assert _scores(spark, root) == expected


def test_compaction_that_fails_loses_nothing(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    install_tables(spark, root)
    for n in (1, 2, 3):
        append_batch(_results(spark, [("s", "okc", "2016-01-01", n, n)]), RESULTS, root, n)
    append_batch(_results(spark, [("p", "okc", "2016-01-01", 9, 1)]), RESULTS, root, 3)
    expected = [("p", "okc", 9), ("s", "okc", 3)]

    def fail(*_):
        raise OSError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(upsert, "_mark", fail)           # written, not yet switched
        with pytest.raises(OSError):
            compact(spark, RESULTS, root)
    assert _scores(spark, root) == expected
    compact(spark, RESULTS, root)
    compact(spark, RESULTS, root)
    assert _scores(spark, root) == expected
    parts = _live(spark, table_path(root, RESULTS))
    assert sorted(p.period for p in parts) == ["p", "s"] and all(p.is_base for p in parts)
    before = {p.folder for p in parts}
    append_batch(_results(spark, [("s", "okc", "2016-01-01", 4, 4)]), RESULTS, root, 4)
    compact(spark, RESULTS, root)                     # the untouched period is not rewritten
    after = {p.folder for p in _live(spark, table_path(root, RESULTS)) if p.period == "p"}
    assert after and after < before


def _many_results(spark, rows, first=0):
    """One game for each (seq, team number, day number, score)."""
    return rows.select(
        F.lit("s").alias("period"), F.format_string("t%05d", "team").alias("team"), F.lit("l").alias("score_line"), F.col("score").cast("int").alias("score"),
        F.lit("por").alias("opponent"), F.lit("l").alias("opponent_score_line"), F.lit(1).alias("opponent_score"),
        (F.timestamp_seconds(F.lit(1_400_000_000) + F.col("day") * 86400)).alias("date"), F.col("seq").alias("seq_number"), F.col("seq").alias("event_seq"),
    )


def test_the_base_is_neither_shuffled_nor_sorted(spark, tmp_path):
    root = str(tmp_path)
    install_tables(spark, root)
    base = spark.range(4000).selectExpr("id as seq", "id % 400 as team", "id div 400 as day", "1 as score")
    append_batch(_many_results(spark, base), RESULTS, root, 0)
    compact(spark, RESULTS, root)
    plan = final_plan(read_latest(spark, RESULTS, root))
    assert "Window" not in plan and "Exchange" not in plan and "Join" not in plan      # unique as it is
    # Newer and older versions of stored keys, and new keys.
    delta = spark.range(60).selectExpr("if(id < 20, 5000 + id, if(id < 40, id - 100, 6000 + id)) as seq", "id % 20 as team", "if(id < 40, 0, 99) as day", "2 as score")
    append_batch(_many_results(spark, delta), RESULTS, root, 1)
    got = read_latest(spark, RESULTS, root)
    scores = dict(tuples(got.groupBy("score").count()))
    assert scores == {1: 4000 - 20, 2: 20 + 20}                                        # the late versions lose
    joins = []
    for scan in scans(got):
        if "part=base-" in scan["paths"]:
            joins.append(scan["above"].index("BroadcastHashJoinExec"))
            below = scan["above"][:joins[-1]]
            assert not any("Exchange" in kind or "Sort" in kind for kind in below)
    assert len(joins) == 2                             # what no delta has touched, and what one has
    untouched = [s["above"] for s in scans(got) if "part=base-" in s["paths"]][0]
    assert "ShuffleExchangeExec" not in untouched and "WindowExec" not in untouched
    before = sorted(map(str, tuples(got)))
    compact(spark, RESULTS, root)
    assert sorted(map(str, tuples(read_latest(spark, RESULTS, root)))) == before


def test_periods_named_are_the_only_ones_listed(spark, tmp_path):
    root = str(tmp_path)
    install_tables(spark, root)
    append_batch(_results(spark, [("a b/c", "okc", "2016-01-01", 1, 1), ("s", "cle", "2016-01-01", 2, 1)]), RESULTS, root, 0)
    for _ in range(2):
        assert tuples(read_latest(spark, RESULTS, root, ["a b/c"]).select("period", "team")) == [("a b/c", "okc")]
        assert read_latest(spark, RESULTS, root, ["none"]).count() == 0
        compact(spark, RESULTS, root, ["a b/c"])


def test_a_player_is_looked_up_in_few_row_groups(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(upsert, "ROW_GROUP_BYTES", 64 << 10)
    root = str(tmp_path)
    install_tables(spark, root)
    nulls = [F.lit(None).cast(f.dataType).alias(f.name) for f in PLAYERS.stored_schema if f.name not in ("name", "team", "time", "period", "event_seq", "opponent")]
    lines = spark.range(40_000).select(
        F.format_string("Player %05d", F.col("id") % 2_000).alias("name"), F.lit("s").alias("period"), F.format_string("t%02d", F.col("id") % 30).alias("team"),
        F.timestamp_seconds(F.col("id") * 3600).alias("time"), F.lit("x").alias("opponent"), F.col("id").alias("event_seq"), *nulls,
    )
    append_batch(lines, PLAYERS, root, 0)
    compact(spark, PLAYERS, root)
    latest_lines = read_latest(spark, PLAYERS, root, ["s"])
    wanted = latest_lines.where("name = 'Player 01234' and team = 't04' and period = 's'")
    scan = scans(wanted)
    assert wanted.count() == lines.where("name = 'Player 01234' and team = 't04'").count() > 0
    assert len(scan) == 1 and "EqualTo(name,Player 01234)" in scan[0]["text"] and "EqualTo(team,t04)" in scan[0]["text"]
    assert scan[0]["rows"] < 40_000 / 8
    absent = scans(latest_lines.where("name = 'Player 01234x'"))          # between two names that are there
    assert absent[0]["rows"] == 0                                          # told by the filter, not by least and greatest
    files = [f for p in _live(spark, table_path(root, PLAYERS)) for f in Path(p.folder.removeprefix("file:")).glob("*.parquet")]
    groups = sum(pq.ParquetFile(f).num_row_groups for f in files)
    assert groups > 8


def test_two_writers_commit_one_row(spark, tmp_path):
    """The second commits between the first one's read and its commit."""
    path = str(tmp_path / "teams")
    row = lambda text: spark.createDataFrame([("okc", text)], TEAMS)
    tries = []

    def mine(stored):
        tries.append(stored.count())
        new = insert_if_absent(stored, row("mine"), "processor_id")
        if len(tries) == 1:
            assert commit_version(spark, path, TEAMS, lambda s: insert_if_absent(s, row("theirs"), "processor_id")) == 1
        return new

    assert commit_version(spark, path, TEAMS, mine) is None
    assert tries == [0, 1]
    assert tuples(spark.read.schema(TEAMS).parquet(path).select(*TEAMS.fieldNames())) == [("okc", "theirs")]
    assert [p.name for p in Path(path).iterdir() if p.name[0] not in "._"] == ["version=1"]
    assert commit_version(spark, path, TEAMS, lambda s: spark.createDataFrame([("cle", "c")], TEAMS)) == 2


def test_a_key_written_very_often(spark):
    rows = spark.range(20000).select(
        F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id"
    )
    got = latest(rows, ["k"], ["id"])
    assert got.where("k = 'hot'").select("id").collect() == [(19999,)]
    assert got.count() == 6667 + 1
    assert "WindowGroupLimit" in got._jdf.queryExecution().toString()


def test_latest_reads_only_columns_in_use(spark, tmp_path):
    install_tables(spark, str(tmp_path))
    nulls = [F.lit(None).cast(f.dataType).alias(f.name) for f in LEADERS.stored_schema]
    line = spark.range(1).select(*nulls).withColumn("period", F.lit("s"))
    append_batch(line, LEADERS, str(tmp_path), 0)
    plan = read_latest(spark, LEADERS, str(tmp_path)).where("period = 's'").select("pts")
    text = plan._jdf.queryExecution().toString()
    scan = text[text.rindex("ReadSchema"):].split("\n")[0]
    assert "minusslashplus" not in scan and "pts" in scan
    assert "PartitionFilters: [isnotnull(period" in text


def test_box_lines_of_namesakes_stay_apart():
    assert "team" in LEADERS.keys and LEADERS.version[-1] == "line_nr"
    assert set(DAILY.clustering) < set(DAILY.keys)


def test_insert_if_absent(spark):
    existing = spark.createDataFrame([("okc", "west")], TEAMS)
    new = spark.createDataFrame([("okc", "new"), ("cle", "b"), ("cle", "a")], TEAMS)
    assert tuples(insert_if_absent(existing, new, "processor_id")) == [("cle", "a")]


def test_dimensions(spark, tmp_path):
    root = str(tmp_path)
    teams = [
        spark.createDataFrame([("okc", "west")], TEAMS),
        spark.createDataFrame([("okc", "changed"), ("cle", "east")], TEAMS),
    ]
    campaigns = [
        spark.createDataFrame([("nba", "desc"), ("other", "x")], CAMPAIGN),
        spark.createDataFrame([("nba", "changed")], CAMPAIGN),
    ]
    for team_rows, campaign_rows in zip(teams, campaigns):
        install_dimensions(spark, root, team_rows, campaign_rows)
    stored = stored_teams(spark, root)
    assert sorted(tuples(stored)) == [("cle", "east"), ("okc", "west")]
    stored = spark.read.schema(CAMPAIGN).parquet(f"{root}/campaign")
    assert sorted(tuples(stored.select("campaign_id", "description"))) == [
        ("nba", "changed"), ("other", "x")
    ]


def test_paths():
    assert table_path("/x/", RESULTS) == table_path("/x", RESULTS) == "/x/results_by_period"
