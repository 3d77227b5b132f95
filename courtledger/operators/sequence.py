"""A running number per key that no single task has to count alone."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from courtledger.session import broadcast_if_small, checkpointed, delete_folder, fresh_folder, value_bytes

# monotonically_increasing_id() keeps the row's place in its partition in the
# low 33 bits and the partition's number above them.
_ROW_BITS = 33

#: Offsets of up to so many bytes are collected.
FEW_BYTES = 1 << 20


def running_sequence(
    df: DataFrame,
    key: str,
    order: Sequence[str],
    positions: DataFrame | None = None,
    name: str = "seq_number",
    first: int = 1,
    costly_input: bool = False,
    partitions: int | None = None,
) -> DataFrame:
    """Number the rows of each ``key`` consecutively in ``order``.

    ``positions`` (key column, ``position``) continues earlier numbering; keys
    without one start at ``first``. ``order`` must be unique within a key.

    ``row_number`` over the key would sort a hot key in one task. Here the rows
    are range-partitioned by key *and* order, so a hot key spans many
    partitions, and are written to the reliable checkpoint, which fixes their
    places. Per (key, partition) only a count and a first place are aggregated;
    the counts of earlier partitions are the offset of the later ones. These
    offsets number at most partitions plus keys; their bytes are summed before
    they are broadcast.

    Range partitioning looks at its input twice, once to find the ranges.
    ``costly_input`` writes the input to the shared folder in between, for input that
    is expensive to compute (decoding) and not merely to read. ``partitions``
    replaces ``spark.sql.shuffle.partitions``, which AQE lowers for small input
    but cannot raise for large.
    """
    return numbered(df, key, order, positions, name, first, costly_input, partitions).rows


class Numbered(NamedTuple):
    """Rows with their numbers, and the last number of each of their keys: (key, position)."""

    rows: DataFrame
    reached: DataFrame


def numbered(
    df: DataFrame,
    key: str,
    order: Sequence[str],
    positions: DataFrame | None = None,
    name: str = "seq_number",
    first: int = 1,
    costly_input: bool = False,
    partitions: int | None = None,
    folder: str | None = None,
) -> Numbered:
    """``running_sequence`` and where it ends.

    With ``folder``, in the shared one and empty, the rows are kept there instead of
    in the checkpoint, in columns, so that a use of a few columns reads only those;
    whoever names the folder deletes it.
    """
    spark, wanted = df.sparkSession, df.columns
    input_folder = None
    if costly_input and not df.is_cached:
        input_folder = fresh_folder(spark, "input")
        df.write.parquet(input_folder)
        df = spark.read.schema(df.schema).parquet(input_folder)
    try:
        placed = (
            df.repartitionByRange(*([partitions] if partitions else []), key, *order)
            .sortWithinPartitions(key, *order)
            .withColumn("_slot", F.monotonically_increasing_id())
            .withColumn("_part", F.shiftright("_slot", _ROW_BITS))
        )
        if folder is None:
            placed = checkpointed(placed)
        else:
            placed.write.parquet(folder)
            placed = spark.read.schema(placed.schema).parquet(folder)
    finally:
        if input_folder is not None:
            delete_folder(spark, input_folder)
    runs = placed.groupBy(key, "_part").agg(
        F.min("_slot").alias("_start"), F.count(F.lit(1)).alias("_rows")
    )
    # At most one row per partition and key boundary.
    earlier = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = runs.select(
        key, "_part", "_start", "_rows", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before")
    )
    if positions is not None:
        known = positions.select(F.col(positions.columns[0]).alias(key), "position")
        offsets = offsets.join(known, key, "left").withColumn(
            "_before", F.col("_before") + F.coalesce("position", F.lit(0))
        ).drop("position")
    # A null key is a key of its own.
    offsets = offsets.select(F.col(key).alias("_key"), F.col("_part").alias("_of"), "_start", "_rows", "_before")
    if value_bytes(offsets) <= FEW_BYTES:
        # Looked at once, not again in every use of the rows.
        offsets = spark.createDataFrame(offsets.collect(), offsets.schema)
    last = F.max(F.col("_before") + F.col("_rows")) + F.lit(first - 1)
    found = F.col(key).eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_of"))
    rows = (
        placed.join(broadcast_if_small(offsets), found)
        .withColumn(name, F.col("_slot") - F.col("_start") + F.col("_before") + F.lit(first))
        .select(*wanted, name)
    )
    return Numbered(rows, offsets.groupBy(F.col("_key").alias(key)).agg(last.alias("position")))


def resume_positions(results: DataFrame, teams: DataFrame, periods: DataFrame) -> DataFrame:
    """Where to resume each team's journal: (team, position).

    Per calendar period the sequence number of the team's newest game, then the
    largest over periods; 0 for a team without games.
    """
    newest = (
        results.join(periods.select("period"), "period", "left_semi")
        .groupBy("period", "team")
        .agg(F.max_by("seq_number", "date").alias("seq_number"))
        .groupBy("team")
        .agg(F.max("seq_number").alias("position"))
    )
    return teams.select("team").join(newest, "team", "left").select(
        "team", F.coalesce("position", F.lit(0).cast("bigint")).alias("position")
    )
