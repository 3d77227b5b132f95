import pytest
from helpers import tuples, utc
from pyspark.sql import functions as F

from courtledger.functions.calendar import calendar_frame
from courtledger.league import STAGE_MARKERS
from courtledger.operators.results import (
    daily_results, day_of, parse_day, player_game_log, team_results,
)
from courtledger.schemas import PLAYERS
from courtledger.sources.dimensions import arenas_frame

PERIOD = "season-15-16"
ROWS = [
    ("cle", 99, "okc", 98, "2016-01-16 01:00"),
    ("okc", 106, "por", 92, "2016-01-15 01:00"),
    ("xyz", 80, "okc", 81, "2016-01-14 01:00"),
    ("bos", 80, "mia", 81, "2016-01-14 01:00"),
]


def test_team_results(spark, games):
    got = team_results(games(ROWS), arenas_frame(spark), ["okc"], PERIOD)
    # A home team without an arena is left out; the date is in report time.
    assert tuples(got) == [
        ("por @ okc", "92 : 106", "2016-01-14", "Chesapeake Energy Arena | Oklahoma City, OK"),
        ("okc @ cle", "98 : 99", "2016-01-15", "Quicken Loans Arena | Cleveland, OH"),
    ]
    assert got.columns == ["lineup", "score", "time", "arena"]


def test_both_sides_and_duplicates_are_listed_twice(spark, games):
    arenas = arenas_frame(spark)
    both = tuples(team_results(games(ROWS), arenas, ["okc", "cle"], PERIOD))
    assert [row[0] for row in both] == ["por @ okc", "okc @ cle", "okc @ cle"]
    twice = tuples(team_results(games(ROWS), arenas, ["por", "por"], PERIOD))
    assert [row[0] for row in twice] == ["por @ okc"] * 2
    assert tuples(team_results(games(ROWS), arenas, [], PERIOD)) == []


def test_a_team_playing_itself_is_listed_once(spark, games):
    own = games([("okc", 1, "okc", 2, "2016-01-14 01:00")])
    assert len(tuples(team_results(own, arenas_frame(spark), ["okc"], PERIOD))) == 1


def test_long_dates(spark, games):
    got = team_results(games(ROWS[:1]), arenas_frame(spark), ["cle"], PERIOD, long_dates=True)
    assert got.first().time == "15 Jan 2016 08:00 PM EST"


DAILY = (
    "period string, opponents string, year int, month int, day int, score int, "
    "guest_score int, score_line string, guest_score_line string"
)


@pytest.fixture
def daily(spark):
    return spark.createDataFrame([
        (PERIOD, "okc - por", 2016, 1, 14, 106, 92, "26-23-25-32", "21-21-24-26"),
        (PERIOD, "xyz - cle", 2016, 1, 14, 1, 2, "1", "2"),
        (PERIOD, "okc - cle", 2016, 1, 15, 1, 2, "1", "2"),
        ("unknown", "okc - mia", 2016, 1, 14, 1, 2, "1", "2"),
    ], DAILY)


def test_daily_results(spark, daily):
    calendar = calendar_frame(spark, STAGE_MARKERS)
    got = daily_results(daily, arenas_frame(spark), calendar, "2016-1-14")
    assert tuples(got) == [
        ("  por @ okc ", "21-21-24-26:92 - 26-23-25-32:106", "2016-01-14",
         "Chesapeake Energy Arena | Oklahoma City, OK"),
        ("  cle @ xyz ", "2:2 - 1:1", "2016-01-14", "xyz "),
    ]
    trimmed = daily_results(daily, arenas_frame(spark), calendar, "2016-01-14", trim=True)
    assert [row.lineup for row in trimmed.collect()] == [" por @ okc", " cle @ xyz"]
    assert trimmed.collect()[1].arena == "xyz"


def test_days_outside_the_calendar(spark, daily):
    calendar = calendar_frame(spark, STAGE_MARKERS)
    assert tuples(daily_results(daily, arenas_frame(spark), calendar, "1999-01-14")) == []


def test_many_days(spark, daily):
    days = spark.createDataFrame([("2016-01-14",), ("2016-01-15",), ("no day",)], "text string")
    days = days.select(parse_day(F.col("text")).alias("day"))
    got = daily_results(daily, arenas_frame(spark), calendar_frame(spark, STAGE_MARKERS), days)
    assert [row.time for row in got.collect()] == ["2016-01-14"] * 2 + ["2016-01-15"]


@pytest.mark.parametrize("text", ["2016-13-01", "2016-01", "x-y-z", ""])
def test_bad_day(text):
    with pytest.raises(ValueError, match="not a day"):
        day_of(text)


def test_game_log(spark):
    def line(name, team, time, pts):
        values = {
            "name": name, "period": PERIOD, "team": team, "time": utc(time), "pts": pts,
            "opponent": "por", "min": "42:41", "fgma": "7-14", "threepma": "1-3",
            "ftma": "8-12", "minusslashplus": "+13", "pos": "F",
        }
        return tuple(values.get(c, 0) for c in PLAYERS.columns)

    lines = spark.createDataFrame([
        line("K. Durant", "okc", "2016-01-16 01:00", 30),
        line("K. Durant", "okc", "2016-01-15 01:00", 23),
        line("K. Durant", "gsw", "2016-01-15 01:00", 1),
        line("S. Curry", "gsw", "2016-01-15 01:00", 2),
    ], PLAYERS.schema)
    got = player_game_log(lines, "K. Durant", PERIOD, "okc")
    assert got.columns == [
        "VS", "DT", "MIN", "REB_DEF", "REB_OFF", "REB_TOTAL", "FGM_A", "PM3_A", "FTM_A",
        "ASSISTS", "BL", "STEEL", "PLUS_MINUS", "PTS",
    ]
    assert [row.PTS for row in got.collect()] == [23, 30]
    assert player_game_log(lines).count() == 4
