"""Scalar expressions: rounding, event time, journal addressing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from courtledger.league import TIME_ZONE

# Reports print dates in standard time all year round.
REPORT_OFFSET = "-05:00"
JOURNAL_PARTITION_SIZE = 5_000_000


def truncate_decimals(value: Column, places: int) -> Column:
    """Cut (do not round) a double to ``places`` decimals, toward zero.

    NaN gives 0; beyond the range of a long the nearest long is cut instead.
    """
    scale = float(10**places)
    scaled = value * scale
    whole = (
        F.when(F.isnan(scaled), F.lit(0).cast("bigint"))
        .when(scaled >= 2.0**63, F.lit(2**63 - 1))
        .when(scaled <= -(2.0**63), F.lit(-(2**63)))
        .otherwise(scaled.cast("bigint"))
    )
    return whole / F.lit(scale)


def truncated_average(total: Column, count: Column, places: int = 2) -> Column:
    """``total / count`` cut to ``places`` decimals, exact on integer sums.

    No group is empty after a ``groupBy``; a zero count still gives 0.0.
    """
    scale = 10**places
    cut = F.call_function("div", total * F.lit(scale), F.nullif(count, F.lit(0).cast("bigint")))
    return F.coalesce(cut / F.lit(float(scale)), F.lit(0.0))


def event_time(millis: Column) -> Column:
    """Epoch milliseconds to an instant."""
    return F.timestamp_millis(millis)


def local_time(ts: Column, zone: str = TIME_ZONE) -> Column:
    """Wall-clock time of an instant in ``zone``, without zone."""
    return F.from_utc_timestamp(ts, zone).cast("timestamp_ntz")


def report_day(ts: Column) -> Column:
    """``yyyy-MM-dd`` in report time."""
    return F.date_format(F.from_utc_timestamp(ts, REPORT_OFFSET), "yyyy-MM-dd")


def report_time(ts: Column) -> Column:
    """``dd MMM yyyy hh:mm AM EST`` in report time."""
    shown = F.date_format(F.from_utc_timestamp(ts, REPORT_OFFSET), "dd MMM yyyy hh:mm a")
    return F.concat(shown, F.lit(" EST"))


def journal_partition(sequence_nr: Column, size: int = JOURNAL_PARTITION_SIZE) -> Column:
    """The journal partition holding a sequence number."""
    return F.call_function("div", sequence_nr, F.lit(size).cast("bigint"))


def split_list(text: Column) -> Column:
    """A comma list as an array, trailing empty entries dropped."""
    return F.split(F.regexp_replace(text, ",+$", ""), ",")


def decoded_name(text: Column) -> Column:
    """A URL-encoded name as plain text, null where it is not one."""
    return F.try_url_decode(text)


def winner(home: Column, away: Column, home_score: Column, away_score: Column) -> Column:
    """The winning team; equal scores count for the away side."""
    return F.when(home_score > away_score, home).otherwise(away)
