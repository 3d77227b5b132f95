"""The period calendar and the interval join against it.

Consecutive markers make intervals: a marker opens one, the next marker closes
it, the last marker opens nothing. Both ends are the marker day's 23:59:59 in
the league's time zone and both are exclusive, so an instant exactly on a
marker belongs to no period.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime, time
from zoneinfo import ZoneInfo

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from courtledger.league import TIME_ZONE

UNKNOWN = "unknown"
Markers = Sequence[tuple[str, str]]


def end_of_day(day: Column, zone: str = TIME_ZONE) -> Column:
    """The instant 23:59:59 of a calendar day in ``zone``."""
    local = F.make_timestamp_ntz(
        F.year(day), F.month(day), F.dayofmonth(day), F.lit(23), F.lit(59), F.lit(59)
    )
    return _instant(local, zone)


def start_of_day(day: Column, zone: str = TIME_ZONE) -> Column:
    """The instant 00:00:00 of a calendar day in ``zone``."""
    return _instant(day.cast("timestamp_ntz"), zone)


def _instant(local: Column, zone: str) -> Column:
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), local).cast("timestamp")


def intervals(markers: Markers) -> list[tuple[str, date, date]]:
    """(label, opening day, closing day) per interval, in marker order."""
    days = [(label, date.fromisoformat(day)) for label, day in markers]
    return [(label, opens, closes) for (label, opens), (_, closes) in zip(days, days[1:])]


def _bound(day: date, zone: str) -> Column:
    """A marker day's 23:59:59 in ``zone`` as a constant."""
    return F.lit(datetime.combine(day, time(23, 59, 59), ZoneInfo(zone)))


def period_column(ts: Column, markers: Markers, zone: str = TIME_ZONE) -> Column:
    """The period of instant ``ts`` as one expression over a configured calendar.

    Nothing is joined or shuffled: the bounds are constants, compared in order.
    """
    spans = intervals(markers)
    if not spans:
        return F.lit(UNKNOWN)
    bounds = [_bound(day, zone) for day in [spans[0][1], *(closes for _, _, closes in spans)]]
    labels = [UNKNOWN, *(label for label, _, _ in spans), UNKNOWN]

    def between(low: int, high: int) -> Column:
        """The period of an instant in front of bound ``high`` and behind bound ``low - 1``."""
        if low == high:
            return F.lit(labels[low])
        middle = (low + high) // 2
        return F.when(ts < bounds[middle], between(low, middle)).otherwise(between(middle + 1, high))

    # Halving keeps the expression shallow and the comparisons few for any number of markers.
    return F.when(ts.isNull() | ts.isin(bounds), UNKNOWN).otherwise(between(0, len(bounds)))


def period_of_day(day: date, markers: Markers) -> str | None:
    """The period of a day's local midnight, None outside the calendar."""
    found = [label for label, opens, closes in intervals(markers) if opens < day <= closes]
    return found[0] if found else None


def in_period(ts: Column, period: str, markers: Markers, zone: str = TIME_ZONE) -> Column:
    """Whether ``ts`` lies in ``period``, as range bounds a scan can push down."""
    for label, opens, closes in intervals(markers):
        if label == period:
            return (ts > _bound(opens, zone)) & (ts < _bound(closes, zone))
    raise ValueError(f"Could not find period {period}")


def in_interval(ts: Column, start: Column, end: Column) -> Column:
    """Half-open interval test: the start belongs to it, the end does not."""
    return (ts >= start) & (ts < end)


def marker_frame(spark: SparkSession, markers: Markers) -> DataFrame:
    """Configured markers as (ord, label, day)."""
    return spark.createDataFrame(
        pa.table({
            "ord": pa.array(range(len(markers)), pa.int32()),
            "label": pa.array([label for label, _ in markers], pa.string()),
            "day": pa.array([date.fromisoformat(day) for _, day in markers], pa.date32()),
        })
    )


def calendar_from_markers(markers: DataFrame, zone: str = TIME_ZONE) -> DataFrame:
    """Markers (ord, label, day) to a calendar (ord, period, start_ts, end_ts).

    The window has no partition key: markers are configuration, a few per year.
    """
    closes = F.lead("day").over(Window.orderBy("ord"))
    return (
        markers.withColumn("closes", closes)
        .where(F.col("closes").isNotNull())
        .select(
            "ord",
            F.col("label").alias("period"),
            end_of_day(F.col("day"), zone).alias("start_ts"),
            end_of_day(F.col("closes"), zone).alias("end_ts"),
        )
    )


def calendar_frame(spark: SparkSession, markers: Markers, zone: str = TIME_ZONE) -> DataFrame:
    """The calendar of configured markers."""
    return calendar_from_markers(marker_frame(spark, markers), zone)


def segments(calendar: DataFrame) -> DataFrame:
    """The calendar cut into disjoint pieces (period, start_us, end_us), each of the first interval there.

    Instants are microseconds, so an open interval is the half-open range that
    begins one later. The ranges' bounds, in order, make pieces in which no
    interval begins or ends; a piece belongs to the interval with the least
    ``ord`` among those that hold its first instant. What no interval holds is no
    piece. Pieces and intervals meet on equal days, not each with each.
    """
    spans = calendar.select(
        "ord", F.col("period").alias("_label"), (F.unix_micros("start_ts") + 1).alias("lo"), F.unix_micros("end_ts").alias("hi")
    ).where("lo < hi")
    bounds = spans.select(F.explode(F.array("lo", "hi")).alias("start_us")).distinct()
    # No partition key: the bounds of a calendar are a few per year.
    pieces = bounds.withColumn("end_us", F.lead("start_us").over(Window.orderBy("start_us"))).where("end_us is not null")
    whole_days = spans.withColumn("_day", F.explode(F.sequence(_utc_day("lo"), _utc_day("hi"))))
    held = pieces.withColumn("_day", _utc_day("start_us")).join(whole_days, "_day").where("start_us >= lo and start_us < hi")
    first = F.min(F.struct("ord", "lo", "_label")).alias("first")
    return held.groupBy("start_us", "end_us").agg(first).select(F.col("first._label").alias("period"), "start_us", "end_us")


def _utc_day(micros: str) -> Column:
    return F.call_function("div", F.col(micros), F.lit(86_400_000_000))


def assign_period(
    df: DataFrame, calendar: DataFrame, ts: str, name: str = "period"
) -> DataFrame:
    """Interval join of ``df`` with a calendar table, ``'unknown'`` where none matches.

    Where intervals overlap an instant belongs to the first of them, in the order of
    ``ord``: the join is with the disjoint segments. Each of those is spread over
    the days it touches, so the range join becomes an equi-join on the day
    with the bounds as a residual condition: hashable, and splittable by AQE if
    the calendar outgrows a broadcast. One row comes out for each row of ``df``.
    """
    days = segments(calendar).select(
        F.col("period").alias("_period"), "start_us", "end_us",
        F.explode(F.sequence(_utc_day("start_us"), _utc_day("end_us"))).alias("_day"),
    )
    instant = F.col("_event_us")
    return (
        df.withColumn("_event_us", F.unix_micros(ts)).withColumn("_event_day", _utc_day("_event_us"))
        .join(
            days,
            (F.col("_event_day") == F.col("_day"))
            & (instant >= F.col("start_us")) & (instant < F.col("end_us")),
            "left",
        )
        .withColumn(name, F.coalesce("_period", F.lit(UNKNOWN)))
        .drop("_event_us", "_event_day", "_day", "_period", "start_us", "end_us")
    )
