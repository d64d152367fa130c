"""What the operators of this subpackage take from the library, and what their Python workers share."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from textmill import storage
from textmill.storage import discard, read, shared_dir, spread

__all__ = ["cut", "discard", "read", "release", "shared_dir", "small_batches", "spread"]

#: Rows of an Arrow batch of whole texts at most: with the default of 10,000 a batch of long texts takes hundreds of MB on
#: either side of the pipe to Python.
BATCH_ROWS = 1024
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's bound on Arrow batches to `BATCH_ROWS`, if it is higher; it holds from then on, as a plan
    takes it when it runs."""
    if not 0 < int(spark.conf.get(_BATCH)) <= BATCH_ROWS:
        spark.conf.set(_BATCH, str(BATCH_ROWS))


def cut(df: DataFrame) -> DataFrame:
    """`df` computed once and written to the shared folder; what its plan shuffled goes as soon as that is done.

    Else shuffle files of finished steps stay until the driver happens to collect its garbage, beside those of later ones.
    """
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        return storage.cut(df.select("*"))  # a plan takes the setting when it is made, and this one is used once
    finally:
        conf.unset(_CLEANUP) if before is None else conf.set(_CLEANUP, before)


def release() -> None:
    """Gives memory that is free back to the system: a worker lives on after its task, beside those of other stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)
