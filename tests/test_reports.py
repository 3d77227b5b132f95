import json

import pytest
from helpers import tuples
from sample_game import MILLIS, payload

from courtledger import league, schemas
from courtledger.functions.calendar import calendar_frame
from courtledger.league import STAGE_MARKERS
from courtledger.plans.reports import League, to_json_rows, write_json
from courtledger.sources.dimensions import (
    dimension_from_config, teams_frame, unknown_periods, unknown_teams,
)
from courtledger.streaming.ingest import Ingestion

DAY = 24 * 3_600_000
PLAYOFF = 1366588800000          # 22 April 2013, 00:00 UTC


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Tables of four games: three in the season, one in the playoff."""
    root = str(tmp_path_factory.mktemp("tables"))
    job = Ingestion(root, STAGE_MARKERS)
    job.install(spark)
    rows = [
        ("okc", 0, 0, payload("okc", "por", MILLIS)),
        ("okc", 0, 1, payload("okc", "cle", MILLIS + DAY, 90, 90)),
        ("cle", 0, 0, payload("cle", "okc", MILLIS + 2 * DAY)),
        ("okc", 0, 2, payload("okc", "por", PLAYOFF)),
    ]
    job.process(spark.createDataFrame(rows, schemas.JOURNAL), 0)
    return League(spark, root)


def test_standing(stored):
    season = stored.standing("season-12-13")
    assert tuples(season) == [
        ("east", "cle", 1, 0, 1, 0, 2, 0), ("west", "okc", 1, 1, 0, 1, 1, 2),
        ("west", "por", 0, 0, 0, 1, 0, 1),
    ]
    assert tuples(stored.standing("playoff-12-13")) == [
        (1, "1. First round", "1. First round okc-por  [106:92 okc won]")
    ]


def test_results_and_daily(stored):
    got = stored.results("season-12-13", "cle,por")
    assert [row.lineup for row in got.collect()] == ["por @ okc", "cle @ okc", "okc @ cle"]
    (row,) = stored.daily("2012-11-02").collect()
    assert row.lineup == "  por @ okc "
    assert row.score == "21-21-24-26:92 - 26-23-25-32:106"
    assert stored.daily("2012-12-24").count() == 0


def test_player_and_leaders(stored):
    log = stored.player_stats("K. Durant", "season-12-13", "okc")
    assert [(row.VS, row.PTS) for row in log.collect()] == [("por", 23), ("cle", 23), ("cle", 23)]
    points = tuples(stored.points_leaders("season-12-13"))
    assert points[:3] == [
        (1, "cle", "K. Durant", 23.0, 2), (2, "okc", "K. Durant", 23.0, 3),
        (3, "por", "K. Durant", 23.0, 1),
    ]
    assert points[-1][2:] == ("R. Jackson", 0.0, 2)
    (best,) = tuples(stored.rebound_leaders("season-12-13", 1))
    assert best == (1, "cle", "K. Durant", 2.0, 15.0, 17.0, 2)


def test_wrong_parameters_are_all_named(stored):
    with pytest.raises(ValueError, match="team foo; .*team bar; .*period winter"):
        stored.results("winter", "foo,okc,bar")
    for call in (
        lambda: stored.standing("summer-16-17"),        # the last marker is no period
        lambda: stored.points_leaders("nope"),
        lambda: stored.rebound_leaders("nope"),
        lambda: stored.player_stats("K. Durant", "season-12-13", "nope"),
        lambda: stored.daily("1999-01-01"),
        lambda: stored.daily("soon"),
    ):
        with pytest.raises(ValueError, match="Invalid parameters"):
            call()
    with pytest.raises(ValueError, match="summer-12-13"):
        stored.standing("summer-12-13")


def test_json_rows(stored, tmp_path, spark):
    def rows(report, view):
        return [row.json for row in to_json_rows(report, view).collect()]

    (first, *_) = rows(stored.standing("season-12-13"), "standing")
    assert first == '{"team":"cle","hw":1,"hl":0,"aw":1,"al":0,"w":2,"l":0}'
    (series,) = rows(stored.standing("playoff-12-13"), "playoff")
    assert json.loads(series) == "1. First round okc-por  [106:92 okc won]"
    log = rows(stored.player_stats("K. Durant", "season-12-13", "okc"), "player")
    assert json.loads(log[0])["DT"] == "02 Nov 2012 08:00 PM EST"
    assert list(json.loads(log[0]))[:3] == ["VS", "DT", "MIN"]
    (best,) = rows(stored.points_leaders("season-12-13", 1), "points")
    assert best == '{"team":"cle","player":"K. Durant","pts":23.0,"games":2}'
    assert write_json(stored.daily("2012-11-02"), "daily", str(tmp_path / "out")) == stored.daily("2012-11-02").count()
    (line,) = spark.read.text(str(tmp_path / "out")).collect()
    assert list(json.loads(line.value)) == ["lineup", "score", "time", "arena"]


def test_league_values():
    assert len(league.TEAMS) == len(league.ARENAS) == 30
    assert {team for team, _ in league.TEAMS} == {team for team, _ in league.ARENAS}
    assert [c for _, c in league.TEAMS].count("west") == 15
    assert len(league.SERIES_LABELS) == 15 and league.SERIES_LABELS[-1] == "Final. "


def test_dimension_from_config(spark):
    text = json.dumps([{team: conference} for team, conference in league.TEAMS])
    config = spark.createDataFrame([(text,), ('[{"x": "\\"quoted\\""}]',)], "text string")
    got = dimension_from_config(config, "text", "team", "conference")
    assert sorted(tuples(got)) == sorted([*league.TEAMS, ("x", "quoted")])


def test_unknown_teams_and_periods(spark):
    requests = spark.createDataFrame([(1, "okc,foo,bar"), (2, "cle"), (3, "")], "id int, listed string")
    got = unknown_teams(requests, teams_frame(spark), "id", "listed")
    assert sorted(tuples(got)) == [(1, "bar"), (1, "foo"), (3, "")]
    periods = spark.createDataFrame([("season-12-13",), ("winter",)], "period string")
    got = unknown_periods(periods, calendar_frame(spark, STAGE_MARKERS), "period")
    assert tuples(got) == [("winter",)]
