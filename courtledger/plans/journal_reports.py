"""The reports computed straight from the event journal, without stored tables."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtledger.operators.events import to_box_lines
from courtledger.operators.leaders import DEFAULT_DEPTH, points_leaders
from courtledger.operators.results import team_results
from courtledger.operators.standings import playoff_series, season_standings
from courtledger.sources.journal import decode, keyed_by_time, scan_journal, valid_events, within


def events_between(
    journal: DataFrame,
    teams: Iterable[str] | DataFrame,
    start: Column,
    end: Column,
    payload_format: str = "json",
) -> DataFrame:
    """Decoded events of ``teams`` in a half-open interval, under period ``'interval'``."""
    decoded = valid_events(decode(scan_journal(journal, teams), payload_format=payload_format))
    return within(keyed_by_time(decoded), start, end).withColumn("period", F.lit("interval"))


def games_of(events: DataFrame, game_id: str = "sequence_nr") -> DataFrame:
    """Decoded events as games."""
    r = F.col("event.result")
    return events.select(
        "period",
        F.col(game_id).alias("game_id"),
        r["homeTeam"].alias("home_team"),
        r["homeScore"].alias("home_score"),
        r["awayTeam"].alias("away_team"),
        r["awayScore"].alias("away_score"),
        F.col("event_ts").alias("game_time"),
    )


def journal_season_standings(events: DataFrame, teams: DataFrame, **options) -> DataFrame:
    return season_standings(games_of(events, **options), teams, "interval")


def journal_playoff_series(events: DataFrame, **options) -> DataFrame:
    return playoff_series(games_of(events, **options), "interval")


def journal_points_leaders(events: DataFrame, depth: int = DEFAULT_DEPTH) -> DataFrame:
    return points_leaders(to_box_lines(events), "interval", depth)


def journal_team_results(
    events: DataFrame, arenas: DataFrame, wanted: Sequence[str] | DataFrame, **options
) -> DataFrame:
    return team_results(games_of(events, **options), arenas, wanted, "interval", long_dates=True)
