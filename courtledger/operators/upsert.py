"""Keyed upserts on Parquet, merged on read.

Batches are appended with a version; the latest view keeps the newest version
of each key, so replaying a batch changes nothing. A period's folder is divided
into parts: each batch appends one (a delta), and compaction makes one part that
holds every key once (the base). Reading takes the base as it is, but for the
keys that deltas have written since; only those are compared by version.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Sequence
from typing import NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from courtledger.schemas import CAMPAIGN, TABLES, TEAMS, Table
from courtledger.session import delete_folder, files


def latest(df: DataFrame, keys: Sequence[str], version: Sequence[str]) -> DataFrame:
    """The row with the largest ``version`` per key.

    Rows of a key with equal versions must be equal (a batch appended twice).
    ``row_number = 1`` lets every task cut its keys to one row before the
    shuffle, so a key written very often stays cheap; other columns take no
    part, so those a query does not use are not read.
    """
    newest_first = [F.desc(c) for c in version]
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*newest_first))
    return df.withColumn("_place", place).where(F.col("_place") == 1).drop("_place")


def latest_rows(df: DataFrame, table: Table) -> DataFrame:
    """The latest view of appended rows of a table, without version columns."""
    return latest(df, table.keys, table.version).select(*table.columns)


def table_path(root: str, table: Table) -> str:
    return f"{root.rstrip('/')}/{table.name}"


def install_tables(spark: SparkSession, root: str) -> None:
    """Create the stored tables where they do not exist yet."""
    for table in TABLES:
        empty = spark.createDataFrame([], table.stored_schema)
        empty.write.mode("ignore").partitionBy("period", "part").parquet(
            table_path(root, table)
        )


def append_batch(rows: DataFrame, table: Table, root: str, batch_id: int, writer: str = "") -> None:
    """Append a batch, clustered like the table; needs ``event_seq`` (and ``line_nr``).

    ``writer`` names the stream: batches of two streams are different parts. The
    rebalance hint makes files of even size: a period holding most of the
    rows is split, small ones are not scattered over many files.
    """
    rows = rows.withColumn("batch_id", F.lit(batch_id).cast("bigint"))
    if "line_nr" not in rows.columns:
        rows = rows.withColumn("line_nr", F.lit(0))
    part = "-".join(["batch", *([writer] if writer else []), str(batch_id)])
    _write_part(rows.hint("rebalance", "period"), table, root, part)


def read_table(spark: SparkSession, table: Table, root: str) -> DataFrame:
    """All appended versions; a period filter prunes folders."""
    return spark.read.schema(table.stored_schema).parquet(table_path(root, table))


def read_latest(
    spark: SparkSession, table: Table, root: str, periods: Sequence[str] | None = None
) -> DataFrame:
    """The latest view of a table, or of some of its periods."""
    return _newest(spark, table, root, _live(spark, table_path(root, table), periods)).select(*table.columns)


def _newest(spark: SparkSession, table: Table, root: str, live: list[Part]) -> DataFrame:
    """The newest row of each key in bases and deltas, with its version.

    Base rows are unique, so those of keys without deltas pass by: an anti-join
    with the deltas' keys, which Spark broadcasts while they are small, neither
    shuffles nor sorts the base. A delta may be older than the base (a late
    event), so the base rows of its key take part in the comparison.
    """
    base = [p.folder for p in live if p.is_base]
    deltas = [p.folder for p in live if not p.is_base]
    if not base:
        return latest(_load(spark, table, root, deltas), table.keys, table.version)
    unique = _load(spark, table, root, base)
    if not deltas:
        return unique
    changes = _load(spark, table, root, deltas)
    keys = changes.select(*table.keys)
    contested = unique.join(keys, list(table.keys), "left_semi").select(*unique.columns)
    untouched = unique.join(keys, list(table.keys), "left_anti").select(*unique.columns)
    return untouched.unionByName(latest(contested.unionByName(changes), table.keys, table.version))


def _load(spark: SparkSession, table: Table, root: str, folders: list[str]) -> DataFrame:
    if not folders:
        return spark.createDataFrame([], table.stored_schema)
    return spark.read.schema(table.stored_schema).option("basePath", table_path(root, table)).parquet(*folders)


def compact(
    spark: SparkSession, table: Table, root: str, periods: Sequence[str] | None = None
) -> None:
    """Make a new base of each period that has deltas.

    The new base is written beside the old parts and counts from the moment its
    marker is there; then the old parts are marked as retired, and they are deleted
    by the next call: a failure at any point loses nothing, as deltas that the base
    already has change nothing, and readers that began before keep their files.
    Only periods written since their last compaction are read. One compaction of a
    table runs at a time.
    """
    path = table_path(root, table)
    for part in _parts(spark, path):
        if part.retired:
            delete_folder(spark, part.folder)
    live = _live(spark, path, periods)
    stale = {p.period for p in live if not p.is_base}
    old = [p for p in live if p.period in stale]
    if not old:
        return
    name = f"{_BASE}{1 + max([0, *(p.number for p in _parts(spark, path))]):09d}-{uuid.uuid4().hex}"
    rows = _newest(spark, table, root, old)
    keyed = rows.repartitionByRange("period", *table.clustering)
    _write_part(keyed, table, root, name, **_lookup_options(table))
    for part in _parts(spark, path):
        if part.name == name:
            _mark(spark, part.folder, _COMPLETE)
    for part in old:
        _mark(spark, part.folder, _RETIRED)


_BASE, _COMPLETE, _RETIRED = "base-", "_COMPLETE", "_RETIRED"

#: Bytes in a row group of a base, and distinct values that a filter on a looked-up column is sized for.
ROW_GROUP_BYTES = 16 << 20
LOOKUP_VALUES = 20_000


class Part(NamedTuple):
    """A part of a period's folder and the markers in it."""

    period: str
    folder: str
    name: str
    retired: bool
    complete: bool

    @property
    def is_base(self) -> bool:
        return self.name.startswith(_BASE)

    @property
    def number(self) -> int:
        """A base's place in the order of bases; 0 of a delta."""
        found = re.match(rf"{_BASE}(\d+)-", self.name)
        return int(found[1]) if found else 0


def _lookup_options(table: Table) -> dict[str, str]:
    """How a base is written: small row groups in key order, with Bloom filters on the columns looked up.

    Where all values of a row group are in its dictionary, Parquet keeps that
    instead of a Bloom filter and tests it in the same way.
    """
    options = {"parquet.block.size": str(ROW_GROUP_BYTES)}
    for column in table.lookup:
        options[f"parquet.bloom.filter.enabled#{column}"] = "true"
        options[f"parquet.bloom.filter.expected.ndv#{column}"] = str(LOOKUP_VALUES)
    return options


def _parts(spark: SparkSession, path: str, periods: Sequence[str] | None = None) -> list[Part]:
    """Every part of a table, or of some periods."""
    util = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    names = ["*"] if periods is None else [util.escapePathName(p) for p in periods]
    found = []
    for name in names:
        system, place = files(spark, f"{path}/period={name}/part=*")
        marks = system.globStatus(files(spark, f"{path}/period={name}/part=*/_*")[1]) or []
        marked = {(m.getPath().getParent().toString(), m.getPath().getName()) for m in marks}
        for status in system.globStatus(place) or []:
            folder = status.getPath()
            text = folder.toString()
            found.append(Part(
                util.unescapePathName(folder.getParent().getName().removeprefix("period=")), text,
                util.unescapePathName(folder.getName().removeprefix("part=")),
                (text, _RETIRED) in marked, (text, _COMPLETE) in marked,
            ))
    return found


def _live(spark: SparkSession, path: str, periods: Sequence[str] | None = None) -> list[Part]:
    """The parts that count: of each period the last complete base and the deltas it has not taken in."""
    parts = _parts(spark, path, periods)
    bases: dict[str, Part] = {}
    for part in parts:
        if part.is_base and part.complete and part.number > (bases[part.period].number if part.period in bases else 0):
            bases[part.period] = part
    return [*bases.values(), *(p for p in parts if not p.is_base and not p.retired)]


def _mark(spark: SparkSession, folder: str, marker: str) -> None:
    system, place = files(spark, f"{folder}/{marker}")
    system.create(place, True).close()


def _write_part(rows: DataFrame, table: Table, root: str, part: str, **options: str) -> None:
    (
        rows.withColumn("part", F.lit(part))
        .select(*table.stored_schema.fieldNames())
        .sortWithinPartitions("period", *table.clustering)
        .write.mode("append").options(**options)
        .partitionBy("period", "part")
        .parquet(table_path(root, table))
    )


def insert_if_absent(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` whose key is not in ``existing``: the insert to append.

    Of several new rows with one key the smallest is inserted.
    """
    rest = [c for c in new.columns if c != key]
    one_each = new.groupBy(key).agg(F.min(F.struct(*rest)).alias("_row")).select(key, "_row.*")
    return one_each.join(existing.select(key), key, "left_anti").select(*new.columns)


def commit_version(
    spark: SparkSession, path: str, schema: T.StructType, rows_to_add: Callable[[DataFrame], DataFrame]
) -> int | None:
    """Add the rows that ``rows_to_add`` makes of the stored ones as the next version, or not at all.

    The rows are written aside and moved to ``version=n`` by a rename that fails
    if that name is taken, so of two writers that saw the same rows one is told
    to look again. Readers see whole versions only. Result: the version, None if
    there was nothing to add.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs
    while True:
        system, place = files(spark, f"{path}/version=*")
        taken = [s.getPath() for s in system.globStatus(place) or []]
        number = 1 + max([0, *(int(p.getName().removeprefix("version=")) for p in taken)])
        stored = spark.createDataFrame([], schema)
        if taken:
            stored = spark.read.schema(schema).parquet(*(p.toString() for p in taken))
        aside = f"{path}/_aside-{uuid.uuid4().hex}"
        rows_to_add(stored).write.parquet(aside)
        try:
            if spark.read.schema(schema).parquet(aside).isEmpty():
                return None
            target = hadoop.Path(f"{path}/version={number}")
            context = hadoop.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration())
            strictly = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
            context.rename(hadoop.Path(aside), target, strictly)
            return number
        except Py4JJavaError as failure:
            if "FileAlreadyExists" not in failure.java_exception.getClass().getName():
                raise
        finally:
            delete_folder(spark, aside)


def install_dimensions(
    spark: SparkSession, root: str, teams: DataFrame, campaign: DataFrame
) -> None:
    """Store teams that are absent, and put campaign rows in place of their key.

    Two installs at once add a team once. Campaigns are few, so each is a
    partition and the upsert is a dynamic overwrite of the partitions written.
    """
    teams_path, campaign_path = f"{root.rstrip('/')}/teams", f"{root.rstrip('/')}/campaign"
    commit_version(spark, teams_path, TEAMS, lambda stored: insert_if_absent(stored, teams, "processor_id"))
    (
        campaign.select(*CAMPAIGN.fieldNames())
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("campaign_id")
        .parquet(campaign_path)
    )


def stored_teams(spark: SparkSession, root: str) -> DataFrame:
    """The teams of all committed versions."""
    return spark.read.schema(TEAMS).parquet(f"{root.rstrip('/')}/teams").select(*TEAMS.fieldNames())
