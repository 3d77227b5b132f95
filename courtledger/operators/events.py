"""Events to table rows: one event gives one game, one daily row and a box line
per player of either side.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from courtledger import schemas
from courtledger.functions.calendar import Markers, period_column
from courtledger.functions.scalars import event_time, local_time
from courtledger.league import TIME_ZONE

# Column of a stored line and the field of the event's line.
LINE_COLUMNS = {
    "name": "name", "pos": "pos", "min": "min", "fgma": "fgmA", "threepma": "threePmA",
    "ftma": "ftmA", "minusslashplus": "minusSlashPlus", "offreb": "offReb",
    "defreb": "defReb", "totalreb": "totalReb", "ast": "ast", "pf": "pf",
    "steel": "steels", "to0": "to", "blockshoot": "bs", "ba": "ba", "pts": "pts",
}


def event_frame(events: DataFrame, markers: Markers, zone: str = TIME_ZONE) -> DataFrame:
    """Decoded events with instant and period, the input of the maps below."""
    ts = event_time(F.col("event.result.time"))
    return events.withColumn("event_ts", ts).withColumn(
        "period", period_column(ts, markers, zone)
    )


def to_results(events: DataFrame, *carried: str) -> DataFrame:
    """One row per game, stored under its home team; needs ``seq_number``."""
    r = F.col("event.result")
    return events.select(
        "period",
        r["homeTeam"].alias("team"),
        r["homeScoreLine"].alias("score_line"),
        r["homeScore"].alias("score"),
        r["awayTeam"].alias("opponent"),
        r["awayScoreLine"].alias("opponent_score_line"),
        r["awayScore"].alias("opponent_score"),
        F.col("event_ts").alias("date"),
        "seq_number",
        *carried,
    )


def to_daily(events: DataFrame, *carried: str, zone: str = TIME_ZONE) -> DataFrame:
    """One row per game, addressed by local calendar day and ``home - away``."""
    r = F.col("event.result")
    local = local_time(F.col("event_ts"), zone)
    return events.select(
        "period",
        F.concat(r["homeTeam"], F.lit(" - "), r["awayTeam"]).alias("opponents"),
        F.year(local).alias("year"),
        F.month(local).alias("month"),
        F.dayofmonth(local).alias("day"),
        r["homeScore"].alias("score"),
        r["awayScore"].alias("guest_score"),
        r["homeScoreLine"].alias("score_line"),
        r["awayScoreLine"].alias("guest_score_line"),
        *carried,
    )


def to_box_lines(events: DataFrame, *carried: str, numbered: bool = False) -> DataFrame:
    """One row per player of either side, in the leader table's column order.

    ``numbered`` adds ``line_nr``: 0, 1, ... for the home box, -1, -2, ... for
    the away box.
    """
    r = F.col("event.result")
    sides = F.concat(
        _side(r["homeScoreBox"], r["homeTeam"], r["awayTeam"], lambda i: i),
        _side(r["awayScoreBox"], r["awayTeam"], r["homeTeam"], lambda i: -1 - i),
    )
    lines = events.select(
        "period", F.col("event_ts").alias("time"), *carried, F.explode(sides).alias("_line")
    )
    line = F.col("_line")
    return lines.select(
        "period",
        *(_or_default(line["box"], field).alias(column) for column, field in LINE_COLUMNS.items()),
        line["team"].alias("team"),
        line["opponent"].alias("opponent"),
        "time",
        *carried,
        *([line["line_nr"].alias("line_nr")] if numbered else []),
    )


def to_player_lines(events: DataFrame, *carried: str, numbered: bool = False) -> DataFrame:
    """The same rows in the player table's column order."""
    lines = to_box_lines(events, *carried, numbered=numbered)
    extra = ["line_nr"] if numbered else []
    return lines.select(*schemas.PLAYERS.columns, *carried, *extra)


def _side(
    box: Column, team: Column, opponent: Column, number: Callable[[Column], Column]
) -> Column:
    """A side's lines with team, opponent and number; a missing list is an empty one."""
    empty = F.array().cast(T.ArrayType(schemas.LINE))
    return F.transform(
        F.coalesce(box, empty),
        lambda line, i: F.struct(
            line.alias("box"), team.alias("team"), opponent.alias("opponent"),
            number(i).alias("line_nr"),
        ),
    )


def _or_default(box: Column, field: str) -> Column:
    """An optional field, or the default of its type."""
    kind = schemas.LINE[field].dataType
    default = F.lit("") if isinstance(kind, T.StringType) else F.lit(0)
    return F.coalesce(box[field], default)
