"""Churn and co-change over a commit log (commit_no, added, deleted, path).

A long log is taken in ranges of commits: ``add_ranges`` writes the partial sums of each range as a
partition of its own, and ``totals`` adds them up.  A new range is so added to an old table without
reading old commits, and a range that is written again (after a failure, say) replaces itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import dealt, tasks_for

WIDEST = 50  # lines of a commit that still counts


def narrow_commits(log: DataFrame, widest: int = WIDEST, by: Sequence[str] = (), tasks: int | None = None) -> DataFrame:
    """Rows of commits of at most ``widest`` rows; with ``by``, commits of different values there are different.

    They lie dealt out by commit, over tasks that grow in number with the log.  Rows without a commit are left out.
    """
    keys = [*by, "commit_no"]
    log = dealt(log.dropna(subset=keys), tasks or tasks_for(log.sparkSession, log.count()), *keys)
    return log.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys))).where(F.col("_n") <= widest).drop("_n")


def churn(log: DataFrame, widest: int = WIDEST, by: Sequence[str] = ()) -> DataFrame:
    """path, churn: lines added and deleted; ``-`` counts 0.  With ``by``, for each of its values."""
    lines = sum((F.coalesce(F.expr(f"try_cast({c} AS bigint)"), F.lit(0).cast("long")) for c in ("added", "deleted")), F.lit(0).cast("long"))
    each = log.select(*by, "commit_no", "path", lines.alias("lines"))
    return narrow_commits(each, widest, by).groupBy(*by, "path").agg(F.sum("lines").alias("churn"))


def cochange(log: DataFrame, widest: int = WIDEST, by: Sequence[str] = ()) -> DataFrame:
    """a, b, n: how often two paths stand in one commit.  The width bound bounds the pairs, which are made commit by commit."""
    keys, spark = [*by, "commit_no"], log.sparkSession
    tasks = tasks_for(spark, log.count())
    sizes = dealt(log.select(*keys), tasks, *keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") <= widest)
    most = sizes.agg(F.sum(F.expr("_n * (_n - 1) div 2"))).first()[0] or 0  # a commit of n paths has n * (n - 1) / 2 pairs
    paths = narrow_commits(log.select(*keys, "path"), widest, by, tasks)
    sets = paths.groupBy(*keys).agg(F.array_sort(F.collect_set("path")).alias("_p"))  # of at most ``widest``
    firsts = sets.select(*by, "_p", F.posexplode("_p").alias("_i", "a"))
    pairs = firsts.select(*by, "a", F.explode(F.expr("slice(_p, _i + 2, size(_p))")).alias("b"))
    return dealt(pairs, tasks_for(spark, most), *by, "a", "b").groupBy(*by, "a", "b").agg(F.count(F.lit(1)).alias("n"))


def add_ranges(log: DataFrame, folder: str, widest: int = WIDEST) -> None:
    """Write churn and co-change of each ``part`` of the log under the folder, in place of what it has for that part.

    A commit lies in one part as a whole.  Rows without a part raise, as no later run could replace them.
    """
    named = F.when(F.col("part").isNull(), F.raise_error(F.lit("a commit without a part"))).otherwise(F.col("part").cast("string"))
    log = log.withColumn("part", named)
    for name, made in (("churn", churn), ("cochange", cochange)):
        made(log, widest, ["part"]).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(f"{folder}/{name}")


def totals(spark: SparkSession, folder: str, kind: str = "string") -> tuple[DataFrame, DataFrame]:
    """(path, churn, parts) and (a, b, n, parts) over all parts under the folder; ``kind`` is the type of a path."""
    read = lambda name, columns: spark.read.schema(f"{columns}, part string").parquet(f"{folder}/{name}")
    parts = F.count(F.lit(1)).alias("parts")
    churns, pairs = read("churn", f"path {kind}, churn long"), read("cochange", f"a {kind}, b {kind}, n long")
    pairs = dealt(pairs, tasks_for(spark, pairs.count()), "a", "b")  # most pairs stand in one part only
    return churns.groupBy("path").agg(F.sum("churn").alias("churn"), parts), pairs.groupBy("a", "b").agg(F.sum("n").alias("n"), parts)
