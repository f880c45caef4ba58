"""Session helpers."""

from __future__ import annotations

import math
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ensure_worker_path(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package when it was put on ``sys.path`` by hand.

    On a cluster ship the package with ``--py-files``; this only adds the folder it lies in.
    """
    root = str(Path(__file__).resolve().parent.parent)
    env = spark.sparkContext.environment
    known = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in known:
        env["PYTHONPATH"] = os.pathsep.join([root, *known])
    return spark


def spread(table: DataFrame) -> DataFrame:
    """A table as read, dealt out evenly where its files give fewer partitions than there are cores.

    A file of one row group is one task however many rows it has; work on whole texts is worth a
    shuffle then.  Tables of many files or row groups stay as they are.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table if table.rdd.getNumPartitions() >= cores else table.repartition(cores)


#: Rows that a task reads of what ``dealt`` deals out; a task's sorts and hash tables do not grow with the table then.
TASK_ROWS = 500_000


def tasks_for(spark: SparkSession, rows: int) -> int:
    """Tasks for so many rows: one for each core at least, and one for each ``TASK_ROWS``."""
    return max(spark.sparkContext.defaultParallelism, math.ceil(rows / TASK_ROWS))


def dealt(df: DataFrame, tasks: int | None, *keys: str) -> DataFrame:
    """``df`` dealt out by the keys over a number of tasks that follows the rows.

    What groups or joins by these keys next needs no shuffle of its own, so the number holds there too;
    Spark would merge its partitions up to a size that depends on the cores.  Without a number: as it is.
    """
    return df if tasks is None else df.repartition(tasks, *keys)
