"""Scans of the stored tables, narrowed to the columns and rows a report needs."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtledger.functions.scalars import report_day
from courtledger.sources.journal import filter_in_set

# The columns of a player's game log, and what they are in the
# stored table.
GAME_LOG = {
    "VS": "opponent", "DT": "time", "MIN": "min",
    "REB_DEF": "defreb", "REB_OFF": "offreb", "REB_TOTAL": "totalreb",
    "FGM_A": "fgma", "PM3_A": "threepma", "FTM_A": "ftma",
    "ASSISTS": "ast", "BL": "blockshoot", "STEEL": "steel",
    "PLUS_MINUS": "minusslashplus", "PTS": "pts",
}


def scan_games(
    results: DataFrame, teams: Iterable[str] | DataFrame | None = None, period: str | None = None
) -> DataFrame:
    """Games of a period whose home team is one of ``teams``.

    ``game_id`` is the sequence number of the row: it orders the games of one
    home team.
    """
    rows = results if period is None else results.where(F.col("period") == period)
    if teams is not None:
        rows = filter_in_set(rows, "team", teams)
    return rows.select(
        "period",
        F.col("team").alias("home_team"),
        F.col("score").alias("home_score"),
        F.col("opponent").alias("away_team"),
        F.col("opponent_score").alias("away_score"),
        F.col("date").alias("game_time"),
        F.col("seq_number").alias("game_id"),
    )


def scan_games_by_day(
    results: DataFrame, teams: Iterable[str] | DataFrame | None = None, period: str | None = None
) -> DataFrame:
    """The same games, dated by day in report time."""
    return scan_games(results, teams, period).withColumn(
        "game_day", F.to_date(report_day(F.col("game_time")))
    ).drop("game_time")


def scan_lines(leaders: DataFrame, period: str | None = None) -> DataFrame:
    """The measures the leader boards average."""
    rows = leaders if period is None else leaders.where(F.col("period") == period)
    return rows.select("period", "name", "team", "pts", "offreb", "defreb", "totalreb")


def scan_game_log(
    players: DataFrame, name: str | None = None, period: str | None = None, team: str | None = None
) -> DataFrame:
    """Player lines by the equality filters given."""
    wanted = {"name": name, "period": period, "team": team}
    for column, value in wanted.items():
        if value is not None:
            players = players.where(F.col(column) == value)
    return players
