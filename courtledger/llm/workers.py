"""Makes this package importable in Python workers, and gives back their memory."""

from __future__ import annotations

import ctypes
import gc
from pathlib import Path

import pyarrow as pa
from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parents[2])


def importable(spark: SparkSession) -> SparkSession:
    """Put the package's folder on the workers' path, where they share it; else ship it with --py-files."""
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(":") if p]
    if ROOT not in paths:
        environment["PYTHONPATH"] = ":".join([*paths, ROOT])
    return spark


def give_back() -> None:
    """Return what a finished task no longer uses to the system: Spark keeps its Python workers for the next ones."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library
    if trim:
        trim(0)
