import json

import pytest
from helpers import tuples, utc
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from sample_game import LINES, MILLIS, event, payload

from courtledger import schemas
from courtledger.league import STAGE_MARKERS
from courtledger.operators import events as maps
from courtledger.sources import journal, protobuf

JOURNAL = "persistence_id string, partition_nr bigint, sequence_nr bigint, event string"


def _journal(spark, payloads):
    rows = [("okc", 0, n, text) for n, text in enumerate(payloads)]
    return spark.createDataFrame(rows, JOURNAL)


BAD = [
    None,
    "",
    "not json",
    "{",
    '{"k": 69}',
    payload()[:-9],
    payload(homeTeam=None),
    payload(homeTeam=""),
    payload(awayScore=None),
    payload(time="soon"),
    payload(homeScore="many"),
    payload(homeTotal=None),
    payload(awayTotal={"pts": 1}),
    payload(homeScoreBox=[{"name": "A"}]),
    payload(awayScoreBox=[{"pos": "G"}]),
    payload(homeScoreBox=[{"name": "A", "pos": "G", "pts": "x"}]),
]


def test_bad_payloads_become_the_empty_event_and_are_dropped(spark):
    rows = journal.decode(_journal(spark, [*BAD, payload()]))
    assert rows.columns == ["persistence_id", "partition_nr", "sequence_nr", "event"]
    assert rows.count() == len(BAD) + 1
    for row in rows.where(F.col("sequence_nr") < len(BAD)).collect():
        if row.event.result is not None:                     # the empty home team
            assert row.event.result.homeTeam == ""
    assert tuples(journal.valid_events(rows).select("sequence_nr")) == [(len(BAD),)]


def test_missing_boxes_and_optional_fields_are_fine(spark):
    texts = [payload(homeScoreBox=None, awayScoreBox=None), payload(homeScoreBox=[])]
    rows = journal.valid_events(journal.decode(_journal(spark, texts)))
    lines = maps.to_box_lines(maps.event_frame(rows, STAGE_MARKERS), "sequence_nr")
    assert tuples(lines.select("sequence_nr", "name", "team")) == [(1, "K. Durant", "por")]


def test_protobuf_descriptor_follows_the_schemas():
    from google.protobuf import descriptor_pb2, descriptor_pool, message_factory
    from google.protobuf.json_format import ParseDict

    file = descriptor_pb2.FileDescriptorSet.FromString(protobuf.descriptor()).file[0]
    pool = descriptor_pool.DescriptorPool()
    pool.Add(file)
    message = message_factory.GetMessageClass(pool.FindMessageTypeByName("Event"))
    good = ParseDict(event(), message())
    assert good.IsInitialized() and good.result.time == MILLIS
    assert [f.name for f in message.DESCRIPTOR.fields] == schemas.EVENT.fieldNames()
    assert not ParseDict(event(homeTeam=None), message()).IsInitialized()


def test_protobuf_payloads_need_sparks_jar(spark):
    rows = spark.createDataFrame([("okc", 0, 0, b"x")], JOURNAL.replace("event string", "event binary"))
    with pytest.raises(AnalysisException, match="spark-protobuf"):
        journal.decode(rows, payload_format="protobuf")


def test_unknown_payload_format(spark):
    with pytest.raises(ValueError, match="avro"):
        journal.decode(_journal(spark, [payload()]), payload_format="avro")


def test_scan_by_team_reads_every_partition(spark):
    rows = spark.createDataFrame(
        [(team, part, 0, "") for team in ("okc", "cle", "mia") for part in (0, 10, 11, 400)], JOURNAL
    )
    got = journal.scan_journal(rows, ["okc", "cle"]).select("persistence_id", "partition_nr")
    assert sorted(tuples(got)) == [(t, n) for t in ("cle", "okc") for n in (0, 10, 11, 400)]
    named = journal.scan_journal(rows, ["okc"], first_partition=1, last_partition=11)
    assert sorted(r.partition_nr for r in named.collect()) == [10, 11]
    assert journal.scan_journal(rows).columns == ["persistence_id", "event"]
    assert journal.scan_journal(rows).count() == 12


def test_set_filter_takes_many_integers(spark):
    rows = spark.range(3000)
    assert journal.filter_in_set(rows, "id", range(0, 2002, 2)).count() == 1001


def test_set_filter_agrees_for_lists_and_frames(spark):
    rows = spark.range(5000).select(F.concat(F.lit("t"), "id").alias("team"))
    few = [f"t{n}" for n in range(0, 100, 7)]
    many = [f"t{n}" for n in range(0, 5000, 2)]
    for wanted in (few, many, few + few):
        frame = spark.createDataFrame([(w,) for w in wanted], "x string")
        expected = sorted(set(wanted))
        for given in (wanted, frame):
            got = journal.filter_in_set(rows, "team", given)
            assert sorted(row.team for row in got.collect()) == expected
    assert journal.filter_in_set(rows, "team", []).count() == 0


def test_after_position(spark):
    rows = spark.createDataFrame(
        [(team, 0, n, "") for team in ("okc", "cle") for n in range(3)], JOURNAL
    )
    positions = spark.createDataFrame([("okc", 2)], "team string, position bigint")
    got = journal.after_position(rows, positions).select("persistence_id", "sequence_nr")
    assert sorted(tuples(got)) == [("cle", 0), ("cle", 1), ("cle", 2), ("okc", 2)]


@pytest.fixture
def events(spark):
    rows = journal.valid_events(journal.decode(_journal(spark, [payload()])))
    return maps.event_frame(rows, STAGE_MARKERS).withColumn("seq_number", F.lit(5).cast("bigint"))


def test_result_row(events):
    rows = maps.to_results(events)
    assert rows.columns == schemas.RESULTS.columns
    assert dict(rows.dtypes) == {f.name: f.dataType.simpleString() for f in schemas.RESULTS.schema}
    shown = rows.withColumn("date", F.unix_millis("date"))
    assert tuples(shown) == [
        ("season-12-13", "okc", "26-23-25-32", 106, "por", "21-21-24-26", 92, MILLIS, 5)
    ]


def test_daily_row_uses_the_local_day(events):
    rows = maps.to_daily(events)
    assert rows.columns == schemas.DAILY.columns
    assert tuples(rows) == [
        ("season-12-13", "okc - por", 2012, 11, 2, 106, 92, "26-23-25-32", "21-21-24-26")
    ]


def test_box_lines(events):
    rows = maps.to_box_lines(events, numbered=True)
    assert rows.columns == [*schemas.LEADERS.columns, "line_nr"]
    got = tuples(rows.select("name", "team", "opponent", "pts", "fgma", "to0", "line_nr"))
    assert got == [
        ("K. Durant", "okc", "por", 23, "7-14", 6, 0),
        ("N. Collison", "okc", "por", 12, "5-6", 1, 1),
        ("R. Jackson", "okc", "por", 0, "", 0, 2),
        ("K. Durant", "por", "okc", 23, "7-14", 6, -1),
    ]
    players = maps.to_player_lines(events)
    assert players.columns == schemas.PLAYERS.columns
    assert players.count() == len(LINES) + 1
    assert sorted(tuples(players.select(*schemas.LEADERS.columns))) == sorted(
        tuples(rows.drop("line_nr"))
    )


def test_events_of_an_interval(spark):
    texts = [payload(millis=ms) for ms in (999, 1000, 1999, 2000)]
    rows = journal.keyed_by_time(journal.decode(_journal(spark, texts)))
    start, end = F.timestamp_millis(F.lit(1000)), F.timestamp_millis(F.lit(2000))
    assert sorted(tuples(journal.within(rows, start, end).select("sequence_nr"))) == [(1,), (2,)]
    assert rows.where("sequence_nr = 1").first().event_ts.timestamp() == 1.0
    assert json.loads(texts[0])["result"]["time"] == 999 and utc("1970-01-01").timestamp() == 0
