"""Schemas of the event payload and of the stored tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


def struct(ddl: str) -> T.StructType:
    """``"name type, ..."`` as a struct of nullable columns; needs no session."""
    kinds = {
        "string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(),
        "timestamp": T.TimestampType(), "binary": T.BinaryType(),
    }
    fields = (field.split() for field in ddl.split(","))
    return T.StructType([T.StructField(name, kinds[kind]) for name, kind in fields])


# Field names and types of the event messages.
TOTAL = struct(
    "minutes int, fgmA string, threePmA string, ftmA string, minusSlashPlus string, "
    "offReb int, defReb int, totalReb int, "
    "ast int, pf int, steels int, to int, bs int, ba int, pts int"
)
LINE = struct(
    "name string, pos string, min string, fgmA string, threePmA string, ftmA string, "
    "minusSlashPlus string, offReb int, defReb int, totalReb int, "
    "ast int, pf int, steels int, to int, bs int, ba int, pts int"
)
RESULT = (
    struct(
        "homeTeam string, homeScore int, awayTeam string, awayScore int, time bigint, "
        "homeScoreLine string, awayScoreLine string"
    )
    .add("homeTotal", TOTAL)
    .add("awayTotal", TOTAL)
    .add("homeScoreBox", T.ArrayType(LINE))
    .add("awayScoreBox", T.ArrayType(LINE))
)
EVENT = T.StructType().add("teamName", T.StringType()).add("result", RESULT)

# Fields an event must carry, per message.
REQUIRED_RESULT = [
    "homeTeam", "homeScore", "awayTeam", "awayScore", "time",
    "homeScoreLine", "awayScoreLine", "homeTotal", "awayTotal",
]
REQUIRED_TOTAL = ["minutes"]
REQUIRED_LINE = ["name", "pos"]

# One row per event; ``event`` is JSON text or protobuf bytes.
JOURNAL = struct("persistence_id string, partition_nr bigint, sequence_nr bigint, event string")


@dataclass(frozen=True)
class Table:
    """A stored table: Parquet partitioned by period, upserted by key.

    ``version`` orders the rows of a key; no two differing rows share it.
    """

    name: str
    schema: T.StructType
    keys: tuple[str, ...]
    clustering: tuple[str, ...]
    version: tuple[str, ...] = ("event_seq",)
    #: Columns that reports look single values up in.
    lookup: tuple[str, ...] = ()

    @property
    def columns(self) -> list[str]:
        return self.schema.fieldNames()

    @property
    def stored_schema(self) -> T.StructType:
        """The rows as appended, with the version columns."""
        return T.StructType(self.schema.fields + VERSION.fields)


# Appended with every row: the micro-batch, the event's number in its team's
# journal, the line's place in the event's boxes, and the part of the period's
# folder. The journal number outlives every stream: the latest event of a key wins.
VERSION = struct("batch_id bigint, event_seq bigint, line_nr int, part string")
_LINE_VERSION = ("event_seq", "opponent", "line_nr")

_MEASURES = (
    "pos string, min string, fgma string, threepma string, ftma string, "
    "minusslashplus string, offreb int, defreb int, totalreb int, "
    "ast int, pf int, steel int, to0 int, blockshoot int, ba int, pts int"
)

RESULTS = Table(
    "results_by_period",
    struct(
        "period string, team string, score_line string, score int, opponent string, opponent_score_line string, "
        "opponent_score int, date timestamp, seq_number bigint"
    ),
    keys=("period", "team", "date"),
    clustering=("team", "date"),
    lookup=("team",),
)
# The key carries the team, so that namesakes playing at the same instant stay
# apart.
LEADERS = Table(
    "leaders_by_period",
    struct(f"period string, name string, {_MEASURES}, team string, opponent string, time timestamp"),
    keys=("period", "time", "name", "team"),
    clustering=("time", "name"),
    version=_LINE_VERSION,
)
PLAYERS = Table(
    "player_by_period_team",
    struct(f"name string, period string, team string, time timestamp, {_MEASURES}, opponent string"),
    keys=("name", "period", "team", "time"),
    clustering=("name", "team", "time"),
    version=_LINE_VERSION,
    lookup=("name", "team"),
)
DAILY = Table(
    "daily_results",
    struct(
        "period string, opponents string, year int, month int, day int, score int, guest_score int, "
        "score_line string, guest_score_line string"
    ),
    keys=("period", "year", "month", "day", "opponents"),
    clustering=("year", "month", "day", "opponents"),
)
TABLES = (RESULTS, LEADERS, PLAYERS, DAILY)

TEAMS = struct("processor_id string, description string")
CAMPAIGN = struct("campaign_id string, description string")
