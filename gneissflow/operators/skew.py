"""Joins on keys of which a few may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARE = 256  # a key is hot if it holds over a SHARE-th of the rows: fewer than SHARE keys can be
LEAST = 1000  # and so many rows at least
SALTS = 64


def hot_keys(df: DataFrame, key: str) -> list:
    """Keys that hold more than 1/``SHARE`` of the rows, and ``LEAST`` rows: fewer than ``SHARE``."""
    total = df.count()
    counted = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return [r[0] for r in counted.where(F.col("_n") > max(total / SHARE, LEAST - 1)).collect()]


def salted_join(left: DataFrame, right: DataFrame, key: str, by: str, hot: list, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right`` on ``key``; rows of ``left`` with a hot key are dealt out over
    ``SALTS`` parts by a hash of column ``by``, and the rows of ``right`` with such a key go to each.

    ``hot`` comes from ``hot_keys``, which bounds it.  The result is that of the plain join; ``right``
    should have few rows for a key.  Null keys match nothing and are dealt out too.
    """
    is_hot = F.col(key).isin(hot) if hot else F.lit(False)
    salts = F.when(F.coalesce(is_hot, F.lit(True)) | F.col(key).isNull(), SALTS).otherwise(1)
    a = left.withColumn("_salt", F.pmod(F.xxhash64(by), salts).cast("int"))
    each = F.explode(F.sequence(F.lit(0), F.when(is_hot, SALTS - 1).otherwise(0))) if hot else F.lit(0)
    b = right.withColumn("_salt", each)
    return a.join(b, [key, "_salt"], how).drop("_salt")
