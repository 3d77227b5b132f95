"""Game results by team and by day, and a player's game log."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtledger.functions.calendar import assign_period, start_of_day
from courtledger.functions.scalars import report_day, report_time
from courtledger.league import TIME_ZONE
from courtledger.sources.tables import GAME_LOG, scan_game_log


DAILY_COLUMNS = ["lineup", "score", "time", "arena"]


def team_results(
    games: DataFrame,
    arenas: DataFrame,
    wanted: Sequence[str] | DataFrame,
    period: str | None = None,
    long_dates: bool = False,
) -> DataFrame:
    """Games of the requested teams: lineup, score, time, arena.

    A list of teams comes by date; what a DataFrame asks for is not sorted.

    A game between two requested teams comes out twice, as does a team requested
    twice; home teams without an arena are left out. ``wanted`` is a list or a
    DataFrame with column ``team``.

    ``home = team OR away = team`` would be a nested-loop join; each game is
    spread over its two sides instead and joined on equality.
    """
    listed = not isinstance(wanted, DataFrame)
    if listed:
        wanted = games.sparkSession.createDataFrame(
            pa.table({"team": pa.array(list(wanted), pa.string())})
        )
    by = ["period"] if period is None else []
    if period is not None:
        games = games.where(F.col("period") == period)
    places = arenas.select(F.col("team").alias("home_team"), "arena")

    sides = games.select(
        *by, "home_team", "home_score", "away_team", "away_score", "game_time", "game_id",
        F.explode(F.array_distinct(F.array("home_team", "away_team"))).alias("team"),
    )
    shown_time = report_time if long_dates else report_day
    found = sides.join(wanted.select("team"), "team").join(places, "home_team")
    if listed:
        # The last columns let a sort spread many games of one pair at one time.
        found = found.orderBy("game_time", "home_team", "away_team", "team", "game_id")
    return found.select(
        *by,
        lineup(F.col("away_team"), F.col("home_team")).alias("lineup"),
        F.concat(
            F.col("away_score").cast("string"), F.lit(" : "), F.col("home_score").cast("string")
        ).alias("score"),
        shown_time(F.col("game_time")).alias("time"),
        "arena",
    )


def lineup(away: Column, home: Column) -> Column:
    return F.concat(away, F.lit(" @ "), home)


def daily_results(
    daily: DataFrame,
    arenas: DataFrame,
    calendar: DataFrame | None,
    days: str | DataFrame,
    trim: bool = False,
    zone: str = TIME_ZONE,
    period: str | None = None,
) -> DataFrame:
    """Games of one day, sorted, or of a DataFrame of days (column ``day``, a date), not sorted.

    ``period`` is that of the one day where the caller knows it
    (``calendar.period_of_day``): the scan then reads that period only, and no
    calendar is needed.

    The day's period is that of its local midnight; rows stored under another
    period (a game right at a stage marker) are not part of it. Team names come
    from splitting ``home - away`` on the dash and keep their blanks unless
    ``trim``. A home team without an arena shows its own name instead.
    """
    one_day = isinstance(days, str)
    if one_day:
        wanted = day_of(days)
        daily = daily.where(
            (F.col("year") == wanted.year)
            & (F.col("month") == wanted.month)
            & (F.col("day") == wanted.day)
        )
        if period is not None:
            rows = daily.where(F.col("period") == period).withColumn("_shown", F.lit(wanted.isoformat()))
            return _shown_daily(rows, arenas, trim).orderBy("time", "opponents", "score", "guest_score").select(*DAILY_COLUMNS)
        days = daily.sparkSession.createDataFrame(pa.table({"day": [wanted]}))
    asked = assign_period(
        days.select(F.col("day").alias("_asked"), start_of_day(F.col("day"), zone).alias("_midnight")),
        calendar, "_midnight",
    ).where(F.col("period") != "unknown").select(
        "period",
        F.year("_asked").alias("year"),
        F.month("_asked").alias("month"),
        F.dayofmonth("_asked").alias("day"),
        F.date_format("_asked", "yyyy-MM-dd").alias("_shown"),
    )

    found = _shown_daily(daily.join(asked, ["period", "year", "month", "day"]), arenas, trim)
    if one_day:
        found = found.orderBy("time", "opponents", "score", "guest_score")
    return found.select(*DAILY_COLUMNS)


def _shown_daily(rows: DataFrame, arenas: DataFrame, trim: bool) -> DataFrame:
    """The report's columns of daily rows with their shown day, and what they are sorted by."""
    parts = F.split("opponents", "-")
    clean = F.trim if trim else (lambda column: column)
    home, away = clean(parts[0]), clean(parts[1])
    places = arenas.select(F.col("team").alias("_home_key"), "arena")
    score = F.concat(
        "guest_score_line", F.lit(":"), F.col("guest_score").cast("string"), F.lit(" - "),
        "score_line", F.lit(":"), F.col("score").cast("string"),
    )
    return (
        rows.withColumn("_home_key", F.trim(parts[0]))
        .join(places, "_home_key", "left")
        .select(
            F.concat(F.lit(" "), lineup(away, home)).alias("lineup"),
            score.alias("score"),
            F.col("_shown").alias("time"),
            F.coalesce("arena", home).alias("arena"),
            "opponents",
            "guest_score",
        )
    )


def day_of(text: str) -> date:
    """``yyyy-m-d`` as a date."""
    try:
        year, month, day = (int(field) for field in text.split("-")[:3])
        return date(year, month, day)
    except ValueError as error:
        raise ValueError(f"Invalid parameters: not a day: {text!r}") from error


def parse_day(text: Column) -> Column:
    """The same for a column, null where it is no day."""
    return F.to_date(F.try_to_timestamp(text, F.lit("yyyy-M-d")))


def player_game_log(
    lines: DataFrame, name: str | None = None, period: str | None = None, team: str | None = None
) -> DataFrame:
    """A player's lines in a period, by time; parameters left out are shown.

    Without any parameter nothing is sorted: the lines of all players.
    """
    rows = scan_game_log(lines, name, period, team)
    by = [c for c, v in (("name", name), ("period", period), ("team", team)) if v is None]
    if len(by) < 3:
        rows = rows.orderBy(*by, "time", "opponent", "pts")
    return rows.select(*by, *(F.col(column).alias(shown) for shown, column in GAME_LOG.items()))
