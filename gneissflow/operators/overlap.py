"""Changed line ranges against symbols, and comparisons of table states."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKET = 256  # an interval is looked at in each bucket of so many lines that it touches


def interval_overlap(hunks: DataFrame, spans: DataFrame, key: str, value: str, bucket: int = BUCKET) -> DataFrame:
    """Distinct (key, value) of spans(key, value, start, end) that a hunk(key, start, end) touches.

    No pairs are made: within a key and bucket both kinds stand in the order of their places, a span
    at its end, and a span is touched if some hunk that begins before it reaches its start.  An
    interval whose end lies before its start touches nothing.
    """
    def placed(df: DataFrame, at: str, value_col, kind: int) -> DataFrame:
        whole = df.where("start <= end").where(F.col(key).isNotNull())
        whole = whole.select(key, value_col, F.col("start").cast("long").alias("_a"), F.col("end").cast("long").alias("_b"))
        each = whole.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("_a") / bucket), F.floor(F.col("_b") / bucket))))
        return each.withColumns({"_at": F.col(at), "_kind": F.lit(kind)})

    none = F.lit(None).cast(spans.schema[value].dataType).alias(value)
    both = placed(hunks, "_a", none, 0).unionByName(placed(spans, "_b", F.col(value), 1))
    so_far = Window.partitionBy(key, "_bucket").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reach = F.max(F.when(F.col("_kind") == 0, F.col("_b"))).over(so_far)
    return both.withColumn("_reach", reach).where("_kind = 1 AND _reach >= _a").select(key, value).distinct()


def changed_symbols(hunks: DataFrame, symbols: DataFrame, changed_paths: DataFrame | None = None) -> DataFrame:
    """path, qualified_name of symbols that a hunk touches, and all of a changed path without hunks."""
    spans = symbols.select("path", "qualified_name", F.col("range.startLine").alias("start"), F.col("range.endLine").alias("end"))
    found = interval_overlap(hunks, spans, "path", "qualified_name")
    if changed_paths is None:
        return found
    whole = changed_paths.select("path").distinct().join(hunks.select("path").distinct(), "path", "left_anti")
    return found.union(symbols.join(whole, "path", "left_semi").select("path", "qualified_name")).distinct()


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """side (``gone`` or ``new``) and the rows that one table holds more often than the other."""
    gone, new = a.exceptAll(b), b.exceptAll(a)
    return gone.select(F.lit("gone").alias("side"), "*").union(new.select(F.lit("new").alias("side"), "*"))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """The two tables hold the same rows, each as often."""
    return differences(a, b).isEmpty()
