"""Whether two tables hold the same rows, by a tree of order-free digests.

A row's digest is four 32-bit words of its SHA-256.  A leaf holds the number of rows whose key falls
into it and the sums of their words, so neither the order of rows nor their partitions matter, and a
repeated row counts as often as it stands.  The inner nodes are sums of leaves.  Making a tree adds up
in each task before the few leaves are shuffled; two trees are compared from the root down, and only rows
of unequal leaves are read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import materialize

FAN, DEPTH = 32, 3  # 32,768 leaves
WORDS = 4
_SUMS = ["n", *[f"w{i}" for i in range(WORDS)]]


def _leaf(keys: list[str]):
    return F.pmod(F.xxhash64(*keys), F.lit(FAN**DEPTH)).cast("int")


def tree(rows: DataFrame, keys: list[str]) -> DataFrame:
    """leaf, n, w0 to w3: the leaves that hold rows; all columns count, ``keys`` choose the leaf."""
    digest = F.sha2(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}), 256)
    words = [F.conv(F.substring("_d", 8 * i + 1, 8), 16, 10).cast("long").alias(f"w{i}") for i in range(WORDS)]
    each = rows.select(_leaf(keys).alias("leaf"), digest.alias("_d")).select("leaf", F.lit(1).cast("long").alias("n"), *words)
    return materialize(each.groupBy("leaf").agg(*[F.sum(c).alias(c) for c in _SUMS]), "tree")


def _level(leaves: DataFrame, depth: int, within: DataFrame | None) -> DataFrame:
    """node and sums of one level; only children of the nodes ``within``."""
    at = leaves.withColumn("node", F.expr(f"leaf div {FAN ** (DEPTH - depth)}"))
    if within is not None:
        at = at.withColumn("up", F.expr(f"node div {FAN}")).join(F.broadcast(within), "up", "left_semi")
    return at.groupBy("node").agg(*[F.sum(c).alias(c) for c in _SUMS])


def unequal(a: DataFrame, b: DataFrame) -> DataFrame | None:
    """node (the numbers of the leaves that differ), or None where the roots are equal."""
    within = None
    for depth in range(DEPTH + 1):
        sums = F.struct(*_SUMS)
        left, right = (_level(t, depth, within).select("node", sums.alias(s)) for t, s in ((a, "x"), (b, "y")))
        differ = left.join(right, "node", "full").where(~F.col("x").eqNullSafe(F.col("y"))).select("node")
        if depth == DEPTH:
            return differ
        differ = materialize(differ, "unequal")
        if depth == 0 and differ.isEmpty():
            return None
        within = differ.withColumnRenamed("node", "up")
    return None


def same(a: DataFrame, b: DataFrame, keys: list[str]) -> bool:
    """The two tables hold the same rows, each as often; no row is shuffled."""
    return unequal(tree(a, keys), tree(b, keys)) is None


def differences(a: DataFrame, b: DataFrame, keys: list[str], trees: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """side (``gone`` or ``new``) and the rows that one table holds more often than the other.

    The tables have the same columns.  Trees that were kept save reading a table that has not changed.
    """
    own = trees or (tree(a, keys), tree(b, keys))
    nodes = unequal(*own)
    if nodes is None:
        return a.limit(0).select(F.lit("gone").alias("side"), "*")
    nodes = materialize(nodes, "unequal")
    some = [t.withColumn("node", _leaf(keys)).join(F.broadcast(nodes), "node", "left_semi").drop("node") for t in (a, b.select(*a.columns))]  # 32,768 numbers at most
    gone, new = some[0].exceptAll(some[1]), some[1].exceptAll(some[0])
    return gone.select(F.lit("gone").alias("side"), "*").union(new.select(F.lit("new").alias("side"), "*"))
