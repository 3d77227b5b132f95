"""The event journal: scans and payload decoding.

A journal row is (persistence_id, partition_nr, sequence_nr, event): one log per
home team, numbered from 0, the payload as JSON text or protobuf bytes.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from courtledger import schemas
from courtledger.functions.calendar import in_interval
from courtledger.functions.scalars import event_time, journal_partition
from courtledger.schemas import JOURNAL
from courtledger.session import broadcast_if_small
from courtledger.sources import protobuf

def filter_in_set(df: DataFrame, column: str, wanted: Iterable | DataFrame) -> DataFrame:
    """Rows whose ``column`` is in a set.

    A list of any values becomes an IN list, which the scan can use; of a
    DataFrame (its first column) Spark chooses the join by its size.
    """
    if not isinstance(wanted, DataFrame):
        return df.where(F.col(column).isin(sorted(set(wanted))))
    members = wanted.select(F.col(wanted.columns[0]).alias(column))
    return df.join(members, column, "left_semi")


def scan_journal(
    journal: DataFrame,
    teams: Iterable[str] | DataFrame | None = None,
    first_partition: int | None = None,
    last_partition: int | None = None,
) -> DataFrame:
    """Journal rows of ``teams``, of all partitions or of those the caller names.

    Without teams: every row, as (persistence_id, event).
    """
    rows = journal
    if first_partition is not None:
        rows = rows.where(F.col("partition_nr") >= first_partition)
    if last_partition is not None:
        rows = rows.where(F.col("partition_nr") <= last_partition)
    if teams is None:
        return rows.select("persistence_id", "event")
    return filter_in_set(rows, "persistence_id", teams)


#: Journal rows in one partition of a team's journal, unless told otherwise.
PARTITION_SIZE = 500_000


def write_journal(rows: DataFrame, path: str, partition_size: int = PARTITION_SIZE) -> None:
    """Append journal rows, laid out by team and journal partition and sorted inside.

    A hot team's rows are spread by their numbers. ``partition_nr`` follows from
    ``sequence_nr``.
    """
    placed = rows.withColumn("partition_nr", journal_partition(F.col("sequence_nr"), partition_size))
    (
        placed.select("persistence_id", "partition_nr", "sequence_nr", "event")
        .repartitionByRange("persistence_id", "sequence_nr")
        .sortWithinPartitions("persistence_id", "sequence_nr")
        .write.mode("append").partitionBy("persistence_id", "partition_nr").parquet(path)
    )


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    """A journal folder in batch, laid out or not."""
    return spark.read.schema(JOURNAL).parquet(path).select(*JOURNAL.fieldNames())


def after_position(journal: DataFrame, positions: DataFrame, partition_size: int | None = None) -> DataFrame:
    """Journal rows not yet consumed: ``sequence_nr >= position`` of their team.

    ``positions`` is (team, position), one row per team; a team without one
    starts at 0. With the ``partition_size`` a journal is laid out by, only the
    unfinished partitions are read: their list, made from the partition columns
    alone, is joined first, and Spark prunes the scan by it (dynamic partition
    pruning). The least position reaches the row groups as a constant.
    """
    known = broadcast_if_small(positions.select(F.col("team").alias("persistence_id"), "position"))
    position = F.coalesce("position", F.lit(0).cast("bigint"))
    if partition_size is not None:
        there = unfinished(journal, positions, partition_size).select("persistence_id", "partition_nr").distinct()
        open_parts = there.join(known, "persistence_id", "left").where(
            (F.col("partition_nr") + 1) * partition_size > position
        ).select("persistence_id", "partition_nr", position.alias("_from"))
        least = open_parts.agg(F.min("_from")).first()[0]
        if least is None:
            return journal.where(F.lit(False))
        return (
            journal.where(F.col("sequence_nr") >= least)
            .join(broadcast_if_small(open_parts), ["persistence_id", "partition_nr"])
            .where(F.col("sequence_nr") >= F.col("_from")).select(*journal.columns)
        )
    rows = journal.join(known, "persistence_id", "left").where(F.col("sequence_nr") >= position)
    return rows.select(*journal.columns)


#: Teams whose own lower bound becomes part of a filter; beyond it all share the least.
MOST_BOUNDS = 1_000


def unfinished(journal: DataFrame, positions: DataFrame, partition_size: int = PARTITION_SIZE) -> DataFrame:
    """The journal without the partitions below each team's position, as a filter of constants.

    For streams, whose files no join can prune: the filter holds the partition
    numbers, grouped by their bound, and so reaches the listing of every
    micro-batch. Rows of an unfinished partition all remain.
    """
    floors = positions.select("team", journal_partition(F.col("position"), partition_size).alias("floor")).where("floor > 0")
    bounds = floors.limit(MOST_BOUNDS + 1).collect()
    if not bounds or len(bounds) > MOST_BOUNDS:
        return journal
    by_floor: dict[int, list[str]] = {}
    for team, floor in bounds:
        by_floor.setdefault(floor, []).append(team)
    team, number = F.col("persistence_id"), F.col("partition_nr")
    wanted = ~team.isin([name for name, _ in bounds])
    for floor, names in sorted(by_floor.items()):
        wanted = wanted | (team.isin(sorted(names)) & (number >= floor))
    return journal.where(wanted)


def decode(journal: DataFrame, payload: str = "event", payload_format: str = "json") -> DataFrame:
    """Replace the payload by the nested event struct.

    A payload that does not parse, or lacks a required field, becomes the empty
    event: all fields null, which ``valid_events`` drops.
    """
    corrupt = "_corrupt"
    if payload_format == "json":
        schema = T.StructType([*schemas.EVENT.fields, T.StructField(corrupt, T.StringType())])
        parsed = F.from_json(payload, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt})
    elif payload_format == "protobuf":
        parsed = protobuf.parsed_event(F.col(payload))
    else:
        raise ValueError(f"unknown payload format {payload_format!r}")

    def usable_or_empty(event: Column) -> Column:
        usable = _has_required_fields(event)
        if payload_format == "json":
            usable = event[corrupt].isNull() & usable
        return F.struct(
            F.when(usable, event["teamName"]).alias("teamName"),
            F.when(usable, event["result"]).alias("result"),
        )

    # Later filters on event fields would be pushed below the projection and
    # parse the payload again for every field they mention. The lambda names the
    # parsed event once, and a generator is where filters stop.
    event = F.transform(F.array(parsed), usable_or_empty)[0]
    others = [c for c in journal.columns if c != payload]
    return journal.select(*others, F.explode(F.array(event)).alias(payload))


def _has_required_fields(event: Column) -> Column:
    result = event["result"]
    needed = [event["teamName"]]
    needed += [result[name] for name in schemas.REQUIRED_RESULT]
    needed += [
        result[side][name]
        for side in ("homeTotal", "awayTotal")
        for name in schemas.REQUIRED_TOTAL
    ]
    present = F.lit(True)
    for column in needed:
        present = present & column.isNotNull()
    for side in ("homeScoreBox", "awayScoreBox"):
        complete = F.forall(result[side], _line_is_complete)
        present = present & F.coalesce(complete, F.lit(True))
    return present


def _line_is_complete(line: Column) -> Column:
    present = line.isNotNull()
    for name in schemas.REQUIRED_LINE:
        present = present & line[name].isNotNull()
    return present


def valid_events(events: DataFrame, payload: str = "event") -> DataFrame:
    """Drop events without a home team, which drops undecodable ones too."""
    return events.where(F.length(F.col(payload)["result"]["homeTeam"]) > 0)


def keyed_by_time(events: DataFrame, payload: str = "event") -> DataFrame:
    """Decoded events with their instant as ``event_ts``."""
    return events.withColumn("event_ts", event_time(F.col(payload)["result"]["time"]))


def within(events: DataFrame, start: Column, end: Column) -> DataFrame:
    """Events of a half-open interval of instants."""
    return events.where(in_interval(F.col("event_ts"), start, end))
