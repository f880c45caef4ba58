"""Intermediate tables in the folder that all machines of the cluster share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Paths that were written and not yet removed; those of the innermost ``settled`` call come last.
_written: list[list[tuple[SparkSession, str]]] = [[]]


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset, a temporary folder in local mode.

    On a cluster a machine-local folder would lose what other machines wrote, so an unset folder is
    an error there.
    """
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    known = spark.sparkContext.getCheckpointDir()
    if known is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="gneiss_ckpt_"))
        known = spark.sparkContext.getCheckpointDir()
    return known.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is None:
        return
    try:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone at exit; the folder is scratch space
        pass


@atexit.register
def _remove_all() -> None:
    for level in _written:
        for spark, path in level:
            _remove(spark, path)


def folder(spark: SparkSession, name: str) -> str:
    """A new folder for tables that are written part by part; it goes with the other intermediate tables."""
    path = f"{shared_dir(spark)}/gneiss-{name}-{uuid.uuid4().hex}"
    _written[-1].append((spark, path))
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage ends at files
    that every executor sees, so a lost executor costs at most the running tasks."""
    spark = df.sparkSession
    path = folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Remove tables that ``materialize`` wrote and that nothing will read again."""
    for df in tables:
        path = df._scratch_path
        for level in _written:
            level[:] = [(s, p) for s, p in level if p != path]
        _remove(df.sparkSession, path)


def settled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """The table that ``make`` gives, written; what was written on the way is removed, also on failure."""
    _written.append([])
    try:
        out = make()
        spark = out.sparkSession
        path = f"{shared_dir(spark)}/gneiss-{name}-{uuid.uuid4().hex}"
        _written[-2].append((spark, path))
        out.write.option("compression", "zstd").parquet(path)
    finally:
        for spark, used in _written.pop():
            _remove(spark, used)
    done = spark.read.schema(out.schema).parquet(path)
    done._scratch_path = path
    return done
