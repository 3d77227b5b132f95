import pytest
from helpers import tuples, utc
from pyspark.sql import functions as F

from courtledger.functions import calendar
from courtledger.league import STAGE_MARKERS

# New York is at UTC-4 in October and June, at UTC-5 in January.
CASES = [
    ("2012-10-29 03:59:58", "unknown"),        # before the first marker
    ("2012-10-29 03:59:59", "unknown"),        # exactly on it
    ("2012-10-29 04:00:00", "season-12-13"),   # one second later
    ("2013-04-20 03:59:58", "season-12-13"),
    ("2013-04-20 03:59:59", "unknown"),        # on an inner boundary
    ("2013-04-20 04:00:00", "playoff-12-13"),
    ("2013-07-01 12:00:00", "summer-12-13"),
    ("2013-03-10 06:59:59", "season-12-13"),   # around the change to summer time
    ("2013-03-10 07:00:00", "season-12-13"),
    ("2017-06-21 03:59:58", "playoff-16-17"),
    ("2017-06-21 04:00:00", "unknown"),        # the last marker opens nothing
]


def _instants(spark):
    rows = [(n, utc(ts)) for n, (ts, _) in enumerate(CASES)] + [(len(CASES), None)]
    return spark.createDataFrame(rows, "n int, ts timestamp")


EXPECTED = [(n, period) for n, (_, period) in enumerate(CASES)] + [(len(CASES), "unknown")]


def test_inline_period(spark):
    period = calendar.period_column(F.col("ts"), STAGE_MARKERS)
    assert tuples(_instants(spark).select("n", period.alias("period")).orderBy("n")) == EXPECTED


def test_joined_period(spark):
    frame = calendar.calendar_frame(spark, STAGE_MARKERS)
    joined = calendar.assign_period(_instants(spark), frame, "ts")
    assert joined.columns == ["n", "ts", "period"]
    assert tuples(joined.select("n", "period").orderBy("n")) == EXPECTED


def test_in_period_agrees(spark):
    inside = calendar.in_period(F.col("ts"), "season-12-13", STAGE_MARKERS)
    got = tuples(_instants(spark).where(inside).select("n").orderBy("n"))
    assert got == [(n,) for n, period in EXPECTED if period == "season-12-13"]


def test_calendar_has_one_interval_less_than_markers(spark):
    rows = calendar.calendar_frame(spark, STAGE_MARKERS).orderBy("ord").collect()
    assert len(STAGE_MARKERS) == 15 and len(rows) == 14
    assert [row.period for row in rows] == [label for label, _ in STAGE_MARKERS[:-1]]
    assert all(a.end_ts == b.start_ts for a, b in zip(rows, rows[1:]))


def test_unknown_period_and_long_calendars(spark):
    with pytest.raises(ValueError, match="winter"):
        calendar.in_period(F.col("ts"), "winter", STAGE_MARKERS)
    days = [f"{1900 + n // 4}-{n % 4 * 3 + 1:02d}-01" for n in range(401)]
    many = [(str(n), day) for n, day in enumerate(days)]
    rows = spark.createDataFrame([(d,) for d in days], "day string").select(
        F.to_timestamp(F.concat("day", F.lit(" 12:00:00"))).alias("ts")
    )
    got = rows.select(calendar.period_column(F.col("ts"), many).alias("p")).collect()
    # At noon of a marker's day the period before it is still open.
    assert [r.p for r in got] == ["unknown", *(str(n) for n in range(400))]


def test_overlapping_intervals_give_the_first(spark):
    rows = [
        (0, "long", utc("2016-01-01"), utc("2016-03-01")), (1, "inner", utc("2016-01-10"), utc("2016-01-20")),
        (2, "late", utc("2016-02-01"), utc("2016-04-01")), (2, "twin", utc("2016-03-15"), utc("2016-04-01")), (3, "empty", utc("2016-05-01"), utc("2016-05-01")),
        (4, "early", utc("2015-12-01"), utc("2016-01-05")),
    ]
    table = spark.createDataFrame(rows, "ord int, period string, start_ts timestamp, end_ts timestamp")
    pieces = calendar.segments(table).orderBy("start_us").collect()
    assert all(a.end_us <= b.start_us for a, b in zip(pieces, pieces[1:]))
    moments = [utc(f"2016-{m:02d}-{d:02d}") for m in range(1, 6) for d in range(1, 29)] + [utc("2015-12-01"), utc("2015-12-15"), utc("1969-12-31 23:59:59")]
    events = spark.createDataFrame([(n, ts) for n, ts in enumerate(moments)] + [(-1, None)], "n int, ts timestamp")
    got = dict(tuples(calendar.assign_period(events, table, "ts").select("n", "period")))
    assert len(got) == events.count()
    for n, ts in enumerate(moments):
        first = [p for _, p, a, b in sorted(rows, key=lambda r: (r[0], r[2])) if a < ts < b]
        assert got[n] == (first[0] if first else "unknown"), ts
    assert got[-1] == "unknown"
