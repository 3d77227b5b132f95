from helpers import tuples, utc
from pyspark.sql import functions as F

from courtledger.functions import scalars


def _one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_decimals_are_cut_not_rounded(spark):
    rows = spark.createDataFrame([(25.679,), (-25.679,), (25.0,)], "x double")
    assert tuples(rows.select(scalars.truncate_decimals(F.col("x"), 2))) == [
        (25.67,), (-25.67,), (25.0,)
    ]


def test_truncated_average(spark):
    rows = spark.createDataFrame([(77, 3), (2, 3), (-77, 3), (5, 0)], "total bigint, n bigint")
    average = scalars.truncated_average(F.col("total"), F.col("n"))
    assert tuples(rows.select(average)) == [(25.66,), (0.66,), (-25.66,), (0.0,)]


def test_report_times_use_standard_time_all_year(spark):
    rows = spark.createDataFrame(
        [(utc("2016-01-15 03:30:00"),), (utc("2016-07-15 16:05:00"),)], "ts timestamp"
    )
    shown = rows.select(scalars.report_day(F.col("ts")), scalars.report_time(F.col("ts")))
    assert tuples(shown) == [
        ("2016-01-14", "14 Jan 2016 10:30 PM EST"), ("2016-07-15", "15 Jul 2016 11:05 AM EST")
    ]


def test_local_time_follows_daylight_saving(spark):
    rows = spark.createDataFrame([(1357000000000,), (1372600000000,)], "millis bigint")
    local = scalars.local_time(scalars.event_time(F.col("millis")))
    shown = rows.select(F.date_format(local, "yyyy-MM-dd HH:mm"))
    assert tuples(shown) == [("2012-12-31 19:26",), ("2013-06-30 09:46",)]


def test_journal_partition(spark):
    sizes = [scalars.journal_partition(F.lit(n).cast("bigint")) for n in (0, 4999999, 5000000)]
    assert tuples(spark.range(1).select(*sizes)) == [(0, 0, 1)]


def test_names_and_lists(spark):
    assert _one(spark, scalars.decoded_name(F.lit("S.%20Curry+%26+Co"))) == "S. Curry & Co"
    assert _one(spark, scalars.split_list(F.lit("cle,okc,,"))) == ["cle", "okc"]
    assert _one(spark, scalars.split_list(F.lit("cle,,okc"))) == ["cle", "", "okc"]


def test_truncation_of_odd_values(spark):
    values = [float("nan"), 1e300, -1e300, float("inf"), None, -1.239]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r.t for r in rows.select(scalars.truncate_decimals(F.col("v"), 2).alias("t")).collect()]
    assert got == [0.0, (2**63 - 1) / 100, -(2**63) / 100, (2**63 - 1) / 100, None, -1.23]


def test_names_that_do_not_decode(spark):
    rows = spark.createDataFrame([("a%20b",), ("50%",)], "v string")
    assert [r.n for r in rows.select(scalars.decoded_name(F.col("v")).alias("n")).collect()] == ["a b", None]
