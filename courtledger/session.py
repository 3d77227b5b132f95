"""Session settings and the shared working folder."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def build_session(app: str = "courtledger", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library relies on.

    ``conf`` keys use ``__`` for dots. Parallelism and memory are left to the
    cluster's own configuration.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Checkpoint files go once nothing refers to them any more.
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors reach: the one ``spark.checkpoint.dir`` names, or the one the
    session's checkpoints are in.

    Only a local session, whose executors are the driver, may do without and
    then uses its warehouse.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/courtledger-work"


def fresh_folder(spark: SparkSession, purpose: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def files(spark: SparkSession, path: str):
    """The file system of a path, and the path, as Hadoop has them."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def delete_folder(spark: SparkSession, folder: str) -> None:
    system, place = files(spark, folder)
    system.delete(place, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and cut its lineage."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def value_bytes(df: DataFrame) -> int:
    """The bytes that the values of a narrow table take, summed over its rows, texts included."""
    width = F.lit(0)
    for field in df.schema:
        texts = isinstance(field.dataType, (T.StringType, T.BinaryType))
        width = width + (F.coalesce(F.octet_length(field.name), F.lit(0)) + 16 if texts else F.lit(16))
    return df.agg(F.sum(width)).first()[0] or 0


def broadcast_if_small(df: DataFrame, most_bytes: int | None = None, size: int | None = None) -> DataFrame:
    """``df``, marked for broadcast if its values take at most ``most_bytes``.

    For narrow tables that Spark cannot estimate (an aggregate of something
    large): without it the large side of the join is shuffled first. The bytes
    are compared with ``spark.sql.autoBroadcastJoinThreshold`` by default. Unless
    their ``size`` is known, ``df`` is computed for it, so it should be cheap.
    """
    if most_bytes is None:
        most_bytes = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    if size is None:
        size = value_bytes(df)
    return F.broadcast(df) if size <= most_bytes else df
