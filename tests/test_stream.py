import pytest
from helpers import scans, tuples
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from sample_game import MILLIS, payload

from courtledger import schemas
from courtledger.league import STAGE_MARKERS
from courtledger.operators.numbers import complete_up_to
from courtledger.operators.upsert import compact, read_latest, read_table
from courtledger.sources.journal import read_journal, unfinished, write_journal
from courtledger.streaming import ingest
from courtledger.streaming.ingest import Ingestion, read_journal_stream

HOUR = 3_600_000


def _write(spark, folder, rows):
    """Append one file of (team, sequence_nr, payload) rows to the journal folder."""
    full = [(team, 0, n, text) for team, n, text in rows]
    spark.createDataFrame(full, schemas.JOURNAL).coalesce(1).write.mode("append").parquet(folder)


@pytest.fixture
def place(tmp_path):
    return str(tmp_path / "journal"), Ingestion(str(tmp_path / "tables"), STAGE_MARKERS)


def _run(spark, folder, job, **options):
    job.start(read_journal_stream(spark, folder, **options), available_now=True).awaitTermination()


def _numbers(spark, job):
    rows = read_latest(spark, schemas.RESULTS, job.root)
    return sorted(tuples(rows.select("team", "opponent", "seq_number")))


def _state(spark, job):
    """Positions and consumed numbers as another stream would find them."""
    state = job.state_before(spark, 0, "another stream")
    return sorted(tuples(state.positions)), sorted(tuples(state.consumed))


FIRST = [
    ("okc", 0, payload("okc", "por", MILLIS)),
    ("okc", 1, payload("okc", "cle", MILLIS + 24 * HOUR)),
    ("cle", 0, payload("cle", "okc", MILLIS + 48 * HOUR)),
    ("cle", 1, "broken"),
]
SECOND = [
    ("okc", 2, payload("okc", "mia", MILLIS + 72 * HOUR)),
    ("mia", 0, payload("mia", "okc", MILLIS - 4 * HOUR)),
    # A correction: the same game again, with another score.
    ("okc", 3, payload("okc", "por", MILLIS, home_score=107)),
]


def test_stream_restart_and_replay(spark, place):
    folder, job = place
    _write(spark, folder, FIRST)
    _run(spark, folder, job)
    assert _numbers(spark, job) == [("cle", "okc", 1), ("okc", "cle", 2), ("okc", "por", 1)]

    _write(spark, folder, SECOND)
    _run(spark, folder, job)                 # continues from the checkpoint
    expected = [
        ("cle", "okc", 1), ("mia", "okc", 1), ("okc", "cle", 2), ("okc", "mia", 3),
        ("okc", "por", 4),
    ]
    assert _numbers(spark, job) == expected
    corrected = read_latest(spark, schemas.RESULTS, job.root).where("opponent = 'por'")
    assert corrected.first().score == 107
    versions = read_table(spark, schemas.RESULTS, job.root)
    assert sorted(tuples(versions.groupBy("batch_id").count())) == [(0, 3), (1, 3)]

    before = {t.name: sorted(map(str, tuples(read_latest(spark, t, job.root)))) for t in schemas.TABLES}
    full = [(team, 0, n, text) for team, n, text in SECOND]
    again = spark.createDataFrame(full, schemas.JOURNAL)
    query = spark.read.parquet(job.state_path)
    spark.sparkContext.setLocalProperty("sql.streaming.queryId", query.orderBy("step").tail(1)[0]["query"])
    job.process(again, 1)                    # as after a crash before the commit
    spark.sparkContext.setLocalProperty("sql.streaming.queryId", None)
    after = {t.name: sorted(map(str, tuples(read_latest(spark, t, job.root)))) for t in schemas.TABLES}
    assert before == after
    assert _state(spark, job) == ([("cle", 1), ("mia", 1), ("okc", 4)], [("cle", 0, 2), ("mia", 0, 1), ("okc", 0, 4)])


def test_four_tables_from_one_batch(spark, place):
    folder, job = place
    _write(spark, folder, FIRST)
    _run(spark, folder, job)
    lines = read_latest(spark, schemas.LEADERS, job.root)
    players = read_latest(spark, schemas.PLAYERS, job.root)
    daily = read_latest(spark, schemas.DAILY, job.root)
    assert lines.count() == players.count() == 3 * 4
    assert sorted(tuples(lines.select(*players.columns))) == sorted(tuples(players))
    assert sorted(tuples(daily.select("opponents", "year", "month", "day"))) == [
        ("cle - okc", 2012, 11, 4), ("okc - cle", 2012, 11, 3), ("okc - por", 2012, 11, 2)
    ]


def test_many_batches_number_each_team_without_gaps(spark, place):
    folder, job = place
    job = Ingestion(job.root, job.markers, compact_every=2)
    for file in range(3):
        _write(spark, folder, [
            (team, n, payload(team, "por", MILLIS + n * HOUR))
            for team in ("okc", "cle") for n in range(file * 4, file * 4 + 4)
        ])
    _run(spark, folder, job, max_files=1)
    rows = read_latest(spark, schemas.RESULTS, job.root)
    for team in ("okc", "cle"):
        numbers = rows.where(F.col("team") == team).select("seq_number").collect()
        assert sorted(n for (n,) in numbers) == list(range(1, 13))


def test_a_fresh_checkpoint_reads_nothing_twice(spark, place, tmp_path):
    folder, job = place
    _write(spark, folder, FIRST)
    _run(spark, folder, job)
    _write(spark, folder, SECOND)
    fresh = Ingestion(job.root, job.markers, checkpoint=str(tmp_path / "fresh"))
    _run(spark, folder, fresh, max_files=1)  # the whole journal again, in two batches
    assert _numbers(spark, job) == [
        ("cle", "okc", 1), ("mia", "okc", 1), ("okc", "cle", 2), ("okc", "mia", 3), ("okc", "por", 4),
    ]
    assert read_latest(spark, schemas.RESULTS, job.root).where("opponent = 'por'").first().score == 107
    assert read_table(spark, schemas.RESULTS, job.root).count() == 6


def test_positions_come_from_stored_results(spark, place, tmp_path):
    folder, job = place
    _write(spark, folder, FIRST[:3])
    _run(spark, folder, job)
    root = str(tmp_path / "copy")
    bare = Ingestion(root, job.markers)
    bare.install(spark)
    for table in schemas.TABLES:
        read_table(spark, table, job.root).write.mode("append").partitionBy("period", "part").parquet(
            f"{root}/{table.name}"
        )
    assert _state(spark, bare) == ([("cle", 1), ("okc", 2)], [("cle", 0, 1), ("okc", 0, 2)])
    _run(spark, folder, bare)
    assert _numbers(spark, bare) == [("cle", "okc", 1), ("okc", "cle", 2), ("okc", "por", 1)]


def _copy_of_results(spark, job, root):
    """A job that has another's tables but not its state."""
    bare = Ingestion(root, job.markers)
    bare.install(spark)
    for table in schemas.TABLES:
        read_table(spark, table, job.root).write.mode("append").partitionBy("period", "part").parquet(f"{root}/{table.name}")
    return bare


def test_results_alone_tell_places_not_numbers(spark, place, tmp_path):
    """Journal 0 good, 1 undecodable, 2 good: the last number is 2, but three places are read."""
    folder, job = place
    _write(spark, folder, [("okc", 0, FIRST[0][2]), ("okc", 1, "broken"), ("okc", 2, FIRST[1][2])])
    _run(spark, folder, job)
    bare = _copy_of_results(spark, job, str(tmp_path / "copy"))
    assert _state(spark, bare) == ([("okc", 2)], [("okc", 0, 1), ("okc", 2, 3)])
    _run(spark, folder, bare)
    rows = read_table(spark, schemas.RESULTS, bare.root).select("event_seq", "seq_number")
    assert sorted(tuples(rows)) == [(0, 1), (2, 2)]
    assert _state(spark, bare)[1] == [("okc", 0, 3)]


def test_late_rows_are_stored_by_a_fresh_stream(spark, place, tmp_path):
    """Rows 5 and 6 are read; then 0 to 4 arrive and a stream with a fresh checkpoint meets all."""
    folder, job = place
    game = lambda n: ("okc", n, payload("okc", "por", MILLIS + n * HOUR))
    _write(spark, folder, [game(n) for n in (5, 6)])
    _run(spark, folder, job)
    assert _state(spark, job)[1] == [("okc", 5, 7)]
    _write(spark, folder, [game(n) for n in range(5)])
    fresh = Ingestion(job.root, job.markers, checkpoint=str(tmp_path / "fresh"))
    _run(spark, folder, fresh)
    rows = read_table(spark, schemas.RESULTS, job.root).select("event_seq", "seq_number")
    assert sorted(tuples(rows)) == [(0, 3), (1, 4), (2, 5), (3, 6), (4, 7), (5, 1), (6, 2)]
    assert _state(spark, job) == ([("okc", 7)], [("okc", 0, 7)])


def test_rows_delivered_twice_by_one_stream_are_stored_once(spark, place):
    folder, job = place
    _write(spark, folder, FIRST)
    _run(spark, folder, job)
    _write(spark, folder, FIRST[:2])                  # the same rows in another file
    _run(spark, folder, job)
    assert read_table(spark, schemas.RESULTS, job.root).count() == 3


def test_two_streams_with_equal_batch_numbers_keep_their_rows(spark, place, tmp_path):
    folder, job = place
    _write(spark, folder, FIRST)
    _run(spark, folder, job)
    compact(spark, schemas.RESULTS, job.root)         # batch 0 of the first stream is retired
    _write(spark, folder, SECOND)
    fresh = Ingestion(job.root, job.markers, checkpoint=str(tmp_path / "fresh"))
    _run(spark, folder, fresh)                        # its batch is number 0 too
    compact(spark, schemas.RESULTS, job.root)
    compact(spark, schemas.RESULTS, job.root)
    assert _numbers(spark, job) == [
        ("cle", "okc", 1), ("mia", "okc", 1), ("okc", "cle", 2), ("okc", "mia", 3), ("okc", "por", 4),
    ]


def test_a_fresh_stream_lists_no_finished_partition(spark, tmp_path):
    folder, job = str(tmp_path / "journal"), Ingestion(str(tmp_path / "tables"), STAGE_MARKERS)
    rows = [(team, 0, n, payload(team, "por", MILLIS + n * HOUR)) for team in ("okc", "cle") for n in range(12)]
    write_journal(spark.createDataFrame(rows, schemas.JOURNAL), folder, 5)
    _run(spark, folder, job)
    journal = read_journal(spark, folder)
    kept = unfinished(journal, complete_up_to(job.state_before(spark, 0).consumed, "team"), 5)
    assert scans(kept)[0]["files"] == 2 and kept.count() == 4      # partition 2 of both teams
    assert job.unread(journal).count() == 24                       # one partition of the usual size


def test_numbers_follow_the_journal_not_the_clock(spark, place):
    folder, job = place
    _write(spark, folder, [
        ("okc", 0, payload("okc", "por", MILLIS + 48 * HOUR)), ("okc", 1, payload("okc", "cle", MILLIS)),
    ])
    _run(spark, folder, job)
    assert _numbers(spark, job) == [("okc", "cle", 2), ("okc", "por", 1)]


def test_the_timed_trigger(spark, place):
    folder, job = place
    _write(spark, folder, FIRST)
    query = job.start(read_journal_stream(spark, folder))
    try:
        query.processAllAvailable()
        assert query.lastProgress is not None
    finally:
        query.stop()
    assert len(_numbers(spark, job)) == 3


def test_protobuf_stream_needs_sparks_jar(spark, place):
    folder, job = place
    job = Ingestion(job.root, job.markers, payload_format="protobuf")
    rows = spark.createDataFrame([("okc", 0, 0, b"x")], "persistence_id string, partition_nr bigint, sequence_nr bigint, event binary")
    job.install(spark)
    with pytest.raises(AnalysisException, match="spark-protobuf"):
        job.process(rows, 0)


def test_a_batch_stores_the_numbers_it_consumed_itself(spark, place, monkeypatch):
    """Steps are merged two by two; a state is a chain of few of them, and a batch run again changes nothing."""
    monkeypatch.setattr(ingest, "MERGED", 2)
    _, job = place
    job.install(spark)

    def process(batch_id, numbers):
        full = [("okc", 0, n, payload("okc", "por", MILLIS + n * HOUR)) for n in numbers]
        job.process(spark.createDataFrame(full, schemas.JOURNAL), batch_id)
        return {r.slot: r["count"] for r in spark.read.parquet(job.state_path).where("lo IS NOT NULL").groupBy("slot").count().collect()}

    assert process(0, [0, 4]) == {1: 2}
    assert process(1, [2, 6]) == {1: 2, 2: 4}           # step 2 holds step 1 too
    assert process(2, [1, 9]) == {2: 4, 3: 2}           # step 3 only what is new
    assert process(2, [1, 9]) == {2: 4, 3: 2}           # again, as after a crash
    assert process(3, [8]) == {2: 4, 3: 2, 4: 4}        # step 4 all of them: 0 to 2, 4, 6 and 8 to 9
    assert process(4, [3, 4, 5]) == {4: 4, 5: 1}
    assert _state(spark, job) == ([("okc", 9)], [("okc", 0, 7), ("okc", 8, 10)])
    assert read_table(spark, schemas.RESULTS, job.root).count() == 11     # numbers 1 and 9 twice, in equal rows
    assert read_latest(spark, schemas.RESULTS, job.root).count() == 9


def test_a_state_of_one_piece_is_read_on(spark, place):
    """As stored before there were steps: everything in the newest of two slots."""
    folder, job = place
    old = [("okc", 2, None, None), ("okc", None, 0, 2), ("cle", None, 0, 2)]
    rows = [(*r, "q", 8, 9, 1) for r in old]
    kinds = "team string, position bigint, lo bigint, hi bigint, query string, batch_id bigint, step bigint, slot int"
    spark.createDataFrame(rows, kinds).write.partitionBy("slot").parquet(job.state_path)
    _write(spark, folder, FIRST + SECOND)
    _run(spark, folder, job)
    assert _numbers(spark, job) == [("mia", "okc", 1), ("okc", "mia", 3), ("okc", "por", 4)]
    assert _state(spark, job) == ([("mia", 1), ("okc", 4)], [("cle", 0, 2), ("mia", 0, 1), ("okc", 0, 4)])
