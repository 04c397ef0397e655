"""Lineage cuts that survive the loss of an executor.

The folder comes from ``spark.checkpoint.dir``; only a session that names none (tests, a laptop) gets one of its own.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's shared folder; a fresh temporary one if the session is local and names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if named is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="tessera-checkpoint-")
    sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and return it without lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_balanced(df: DataFrame, rows_per_partition: int = 200_000) -> DataFrame:
    """As :func:`cut`, for results whose row count is small next to the partitions that made them."""
    out = cut(df)
    wanted = max(1, out.count() // rows_per_partition + 1)
    return out.coalesce(wanted) if wanted < out.rdd.getNumPartitions() else out


def parts(spark: SparkSession, rows: int, rows_per_partition: int = 500_000) -> int:
    """Partitions for a shuffle of so many rows: the session's number, more where that would leave a task more than ``rows_per_partition``."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // rows_per_partition + 1)
