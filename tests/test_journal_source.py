import json

import pytest
from helpers import scans, tuples
from pyspark.sql import functions as F

from courtledger import schemas
from courtledger.sources import journal_source
from courtledger.sources.journal import after_position, read_journal, unfinished, write_journal
from courtledger.sources.journal_source import NAME, StreamReader
from courtledger.streaming.ingest import read_journal_source

SIZE = 10


def _append(spark, path, rows):
    full = [(team, 0, n, f"event {team} {n}") for team, n in rows]
    write_journal(spark.createDataFrame(full, schemas.JOURNAL), path, SIZE)


@pytest.fixture
def path(tmp_path):
    return str(tmp_path / "journal")


def _options(path, **more):
    return {"path": path, "partitionsize": str(SIZE), **more}


def _batch(spark, path, **options):
    journal_source.register(spark)
    reader = spark.read.format(NAME).option("partitionSize", SIZE)
    for name, value in options.items():
        reader = reader.option(name, value)
    return reader.load(path)


def _drain(spark, stream, folder):
    """Everything there is, in as many batches as it takes; (batch, team, number) as delivered."""
    def keep(batch, batch_id):
        batch.withColumn("batch", F.lit(batch_id)).write.mode("append").parquet(f"{folder}/rows")

    query = stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").trigger(processingTime="0 seconds").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    rows = spark.read.parquet(f"{folder}/rows")
    return sorted(tuples(rows.select("batch", "persistence_id", "sequence_nr")))


def test_layout_and_batch(spark, path):
    teams = ["okc", "a/b c=%é"]
    _append(spark, path, [(t, n) for t in teams for n in range(25)])
    stored = read_journal(spark, path)
    got = _batch(spark, path)
    assert got.columns == stored.columns == schemas.JOURNAL.fieldNames()
    assert sorted(tuples(got)) == sorted(tuples(stored))
    assert {r.partition_nr for r in got.collect()} == {0, 1, 2}
    after = _batch(spark, path, after=json.dumps({"okc": 23}))
    assert sorted(r.sequence_nr for r in after.where("persistence_id = 'okc'").collect()) == [23, 24]
    assert after.where("persistence_id <> 'okc'").count() == 25
    assert _batch(spark, path + "-none").count() == 0


def test_a_restart_plans_no_finished_range(spark, path):
    _append(spark, path, [(t, n) for t in ("okc", "cle") for n in range(40)])
    reader = StreamReader(_options(path))
    plan = reader.partitions({"okc": 35, "cle": 40}, {"okc": 40, "cle": 40})
    assert {(s.team, s.partition_nr, s.lo, s.hi) for s in plan} == {("okc", 3, 35, 40)}
    # Nothing of the finished partitions was even opened.
    assert {f.partition_nr for f in reader.journal.known.values()} == {3}
    assert reader.partitions({"okc": 40}, {"okc": 40}) == []
    rows = [b for s in plan for b in reader.read(s)]
    assert sum(b.num_rows for b in rows) == 5


def test_stream_agrees_with_batch_over_a_restart(spark, path, tmp_path):
    _append(spark, path, [("okc", n) for n in range(23)] + [("cle", n) for n in range(4)])
    stream = read_journal_source(spark, path, SIZE, max_rows=8, progress=str(tmp_path / "progress"))
    first = _drain(spark, stream, str(tmp_path / "out"))
    assert sorted(r[1:] for r in first) == sorted([("okc", n) for n in range(23)] + [("cle", n) for n in range(4)])
    sizes = [sum(r[0] == b for r in first) for b in sorted({r[0] for r in first})]
    assert max(sizes) <= 8 and len(sizes) >= 4                                   # admission
    assert [n for _, t, n in first if t == "okc"] == list(range(23))             # journal order over the batches
    _append(spark, path, [("okc", n) for n in range(23, 31)] + [("mia", 0)])
    stream = read_journal_source(spark, path, SIZE, max_rows=8, progress=str(tmp_path / "progress"))
    again = _drain(spark, stream, str(tmp_path / "out"))
    assert sorted(r[1:] for r in again) == sorted((r.persistence_id, r.sequence_nr) for r in _batch(spark, path).collect())


def test_late_rows_are_waited_for_or_passed(spark, path):
    _append(spark, path, [("okc", n) for n in (0, 1, 5, 6)] + [("cle", n) for n in (3, 4)])
    reader = StreamReader(_options(path))
    assert reader.latestOffset() == {"cle": 0, "okc": 2}
    _append(spark, path, [("okc", n) for n in (2, 3, 4)] + [("cle", n) for n in (0, 2)])
    assert reader.latestOffset() == {"cle": 1, "okc": 7}
    assert StreamReader(_options(path, gaps="pass")).latestOffset() == {"cle": 5, "okc": 7}


def test_shares_of_a_bounded_batch(spark, path, tmp_path):
    _append(spark, path, [("a", n) for n in range(2)] + [("b", n) for n in range(30)] + [("c", n) for n in range(30)])
    options = _options(path, maxrowspertrigger="12", progress=str(tmp_path / "p"))
    reader = StreamReader(options)
    assert reader.latestOffset() == {"a": 2, "b": 5, "c": 5}
    reader.partitions({}, {"a": 2, "b": 5, "c": 5})
    assert StreamReader(options).latestOffset() == {"a": 2, "b": 11, "c": 11}   # goes on from what was planned
    for wrong in ({"maxrowspertrigger": "5"}, {"gaps": "skip"}):
        with pytest.raises(ValueError):
            StreamReader(_options(path, **wrong))


def test_files_read_fall_with_the_position(spark, path):
    _append(spark, path, [(t, n) for t in ("okc", "cle", "mia") for n in range(100)])
    journal = read_journal(spark, path)
    files, rows = [], []
    for done in (0, 50, 95):
        positions = spark.createDataFrame([("okc", done), ("cle", done), ("mia", done)], "team string, position bigint")
        got = after_position(journal, positions, SIZE)
        payload = [s for s in scans(got) if "event" in s["text"].split("ReadSchema")[1]]
        assert len(payload) == 1 and "dynamicpruning" in payload[0]["text"]
        assert f"GreaterThanOrEqual(sequence_nr,{done})" in payload[0]["text"]
        files.append(payload[0]["files"])
        rows.append(sorted(tuples(got.select("persistence_id", "sequence_nr"))))
        assert rows[-1] == [(t, n) for t in ("cle", "mia", "okc") for n in range(done, 100)]
    assert files[0] == 30 and files[1] == 15 and files[2] == 3


def test_teams_without_position_and_finished_ones(spark, path):
    _append(spark, path, [(t, n) for t in ("okc", "cle") for n in range(30)])
    journal = read_journal(spark, path)
    positions = spark.createDataFrame([("okc", 30), ("gone", 3)], "team string, position bigint")
    for size in (None, SIZE):
        got = after_position(journal, positions, size)
        assert got.columns == journal.columns
        assert sorted(tuples(got.select("persistence_id", "sequence_nr"))) == [("cle", n) for n in range(30)]
    everything = spark.createDataFrame([("okc", 30), ("cle", 30)], "team string, position bigint")
    assert after_position(journal, everything, SIZE).count() == 0
    kept = unfinished(journal, positions, SIZE)
    assert scans(kept)[0]["files"] == 3 and kept.count() == 30
    assert unfinished(journal, positions.limit(0), SIZE).count() == 60
