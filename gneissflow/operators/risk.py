"""Risk of a symbol, as five capped parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions.text import security_word
from .graph import bare, in_degree


def most(churn: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: the largest churn of a path and the largest in-degree of a symbol, 0 where there is none."""
    lines = churn.agg(F.coalesce(F.max("churn"), F.lit(0)).alias("max_churn"))
    return lines.crossJoin(in_degree(edges).agg(F.coalesce(F.max("n"), F.lit(0)).alias("max_in_degree")))


def risk(symbols: DataFrame, edges: DataFrame, churn: DataFrame, largest: DataFrame) -> DataFrame:
    """qualified_name, total_risk and factors of symbols(qualified_name, name, path).

    ``largest``: one row (max_churn, max_in_degree).  untested.raw is 1 where tests exist.  Each table
    is reduced to one row for each key first, so every join adds columns and no rows.
    """
    tested = edges.where("kind = 'TESTED_BY'").select(bare("dst").alias("path")).distinct().withColumn("tested", F.lit(True))
    calls = edges.where("kind = 'CALLS'").select(P.top_dir(P.file_of(bare("src"))).alias("_dir"), bare("dst").alias("qualified_name"))
    # two directories tell whether one of the callers' is another than the symbol's own
    ends = calls.groupBy("qualified_name").agg(F.min("_dir").alias("_d0"), F.max("_dir").alias("_d1"), F.count(F.lit(1)).alias("fan_in"))
    x = symbols.select("qualified_name", "name", "path")
    x = x.join(tested.hint("merge"), "path", "left").join(churn.select("path", "churn").hint("merge"), "path", "left").join(ends.hint("merge"), "qualified_name", "left")
    x = x.crossJoin(F.broadcast(largest))  # one row
    own = P.top_dir("path")
    x = x.withColumn("far", F.coalesce((F.col("_d0") != own) | (F.col("_d1") != own), F.lit(False)))
    lines, calls_in = F.coalesce("churn", F.lit(0)), F.coalesce("fan_in", F.lit(0))

    def part(n: Column, top: str, cap: float) -> Column:
        return F.when(F.col(top) > 0, F.least(F.lit(cap), n / F.col(top).cast("double") * cap)).otherwise(0.0)

    secret = security_word("name")
    parts = [
        ("untested", F.when(F.col("tested"), 1).otherwise(0), F.when(F.col("tested"), 0.0).otherwise(0.3)),
        ("security-keyword", F.when(secret, 1).otherwise(0), F.when(secret, 0.2).otherwise(0.0)),
        ("churn", lines, part(lines, "max_churn", 0.15)),
        ("cross-boundary-callers", F.when(F.col("far"), 1).otherwise(0), F.when(F.col("far"), 0.15).otherwise(0.0)),
        ("fan-in", calls_in, part(calls_in, "max_in_degree", 0.1)),
    ]
    total = sum((c for _, _, c in parts[1:]), parts[0][2])
    factors = F.array(*[
        F.struct(F.lit(n).alias("factor"), r.cast("long").alias("raw"), c.cast("double").alias("capped"), c.cast("double").alias("contribution"))
        for n, r, c in parts
    ])
    return x.select("qualified_name", F.round(F.least(F.lit(1.0), total), 4).alias("total_risk"), factors.alias("factors"))
