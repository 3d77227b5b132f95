"""The public reports over stored tables, with checked parameters, and their JSON."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from courtledger import league, schemas
from courtledger.functions.calendar import Markers, period_of_day
from courtledger.functions.scalars import report_time
from courtledger.operators import leaders, results, standings
from courtledger.operators.upsert import read_latest
from courtledger.sources.dimensions import arenas_frame, check_request, teams_frame
from courtledger.sources.tables import GAME_LOG, scan_games, scan_lines

# The fields of a JSON row, per report.
JSON_FIELDS = {
    "results": ["lineup", "score", "time", "arena"],
    "daily": ["lineup", "score", "time", "arena"],
    "standing": ["team", "hw", "hl", "aw", "al", "w", "l"],
    "points": ["team", "player", "pts", "games"],
    "rebounds": ["team", "player", "offensive", "defensive", "total", "games"],
    "player": list(GAME_LOG),
}


@dataclass
class League:
    """A league's stored tables and its configuration.

    Every report takes the parameters of a request, raises one ``ValueError``
    naming all that are wrong, and returns a DataFrame.
    """

    spark: SparkSession
    root: str
    teams: Sequence[tuple[str, str]] = field(default_factory=lambda: league.TEAMS)
    arenas: Sequence[tuple[str, str]] = field(default_factory=lambda: league.ARENAS)
    markers: Markers = field(default_factory=lambda: league.STAGE_MARKERS)
    zone: str = league.TIME_ZONE

    def _teams(self) -> DataFrame:
        return teams_frame(self.spark, self.teams)

    def _arenas(self) -> DataFrame:
        return arenas_frame(self.spark, self.arenas)

    def _check(self, period: str, teams: str | None = None) -> None:
        check_request(self.spark, self._teams(), self.markers, period, teams)

    def _latest(self, table: schemas.Table, period: str) -> DataFrame:
        return read_latest(self.spark, table, self.root, [period])

    def _games(self, period: str) -> DataFrame:
        known = [team for team, _ in self.teams]
        return scan_games(self._latest(schemas.RESULTS, period), known, period)

    def standing(self, stage: str) -> DataFrame:
        """Season standings or playoff series, by the kind of stage."""
        self._check(stage)
        return standings.standings(self._games(stage), self._teams(), stage)

    def results(self, stage: str, teams: str) -> DataFrame:
        """Results of a comma list of teams."""
        self._check(stage, teams)
        return results.team_results(self._games(stage), self._arenas(), teams.split(","), stage)

    def daily(self, day: str) -> DataFrame:
        """Results of a day, ``yyyy-mm-dd``."""
        period = period_of_day(results.day_of(day), self.markers)
        if period is None:
            raise ValueError(f"Invalid parameters: Could not find season for day {day}")
        return results.daily_results(
            self._latest(schemas.DAILY, period), self._arenas(), None, day, zone=self.zone, period=period
        )

    def player_stats(self, name: str, stage: str, team: str) -> DataFrame:
        """A player's games in a stage."""
        self._check(stage, team)
        return results.player_game_log(self._latest(schemas.PLAYERS, stage), name, stage, team)

    def points_leaders(self, stage: str, depth: int = leaders.DEFAULT_DEPTH) -> DataFrame:
        self._check(stage)
        return leaders.points_leaders(scan_lines(self._latest(schemas.LEADERS, stage)), stage, depth)

    def rebound_leaders(self, stage: str, depth: int = leaders.DEFAULT_DEPTH) -> DataFrame:
        self._check(stage)
        return leaders.rebound_leaders(scan_lines(self._latest(schemas.LEADERS, stage)), stage, depth)


def to_json_rows(report: DataFrame, view: str) -> DataFrame:
    """A report's rows as JSON text in column ``json``, other columns dropped.

    Playoff series are JSON strings, all other rows objects.
    """
    if view == "playoff":
        listed = report.select(F.to_json(F.array("text")).alias("listed"))
        return listed.select(F.expr("substring(listed, 2, length(listed) - 2)").alias("json"))
    fields = [_shown(report, name) for name in JSON_FIELDS[view]]
    return report.select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("json"))


def _shown(report: DataFrame, name: str) -> Column:
    """Instants are printed in report time, all else as it is."""
    is_time = report.schema[name].dataType.typeName().startswith("timestamp")
    return (report_time(F.col(name)) if is_time else F.col(name)).alias(name)


def sized(report: DataFrame) -> tuple[DataFrame, Observation]:
    """A report that counts its rows while it runs.

    After the first action on it, ``observation.get["size"]`` is the number of
    rows that action made: no second run of the report.
    """
    size = Observation()
    return report.observe(size, F.count(F.lit(1)).alias("size")), size


def write_json(report: DataFrame, view: str, path: str) -> int:
    """Write a report as JSON lines; the result is their number, counted while writing."""
    counted, size = sized(to_json_rows(report, view))
    counted.withColumnRenamed("json", "value").write.mode("overwrite").text(path)
    return size.get["size"]
