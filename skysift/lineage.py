"""Cutting lineage for iterative operators.

Iterations write through reliable checkpoints, so a lost executor never loses
state.  The cluster names the shared folder in ``spark.checkpoint.dir``.  Where it
is unset, only a single-machine session gets a temporary folder; on a cluster the
operators stop with an error instead of writing to a folder that others cannot see.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not re.fullmatch(r"local(\[.*\])?", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="skysift-", dir="/tmp"))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for written tables, next to the checkpoints."""
    ensure_checkpoint_dir(spark)
    root = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return f"{root}/{name}-{uuid.uuid4().hex}"


def fan_out(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition by ``keys`` into the configured number of shuffle partitions.

    Used before work that is heavy per byte (folds, grouped Python, cell
    expansion): sized by bytes alone, such input would be merged into few tasks.
    A grouping by the same keys afterwards needs no further shuffle.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def by_sort(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the input: joined by sorting, never sent whole through the driver.

    Spark sizes a table by its files and the width of its rows, so rows that an explode repeats, or that are packed well in
    their file, seem small enough for a broadcast until they are held in memory.
    """
    return df.hint("merge")


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once in the shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def is_empty(df: DataFrame) -> bool:
    return len(df.take(1)) == 0
