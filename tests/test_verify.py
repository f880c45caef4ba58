"""Digest trees against plain multisets."""

import random
from collections import Counter

from pyspark.sql import functions as F

from gneissflow.operators import verify

SCHEMA = "k long, v string"


def test_changed_repeated_and_missing_rows(spark):
    rng = random.Random(4)
    a = [(rng.randrange(400), rng.choice(["x", "y", None, ""])) for _ in range(900)]
    b = [r for r in a if r[0] != 7] + [(3, "new"), a[0], a[0], (None, "x"), (None, None)]
    rng.shuffle(b)
    one, two = (spark.createDataFrame(r, SCHEMA).repartition(n) for r, n in ((a, 3), (b, 5)))
    got = Counter((r.side, r.k, r.v) for r in verify.differences(one, two, ["k"]).collect())
    x, y = Counter(a), Counter(b)
    assert got == Counter({("gone", *r): n for r, n in (x - y).items()}) + Counter({("new", *r): n for r, n in (y - x).items()})
    assert not verify.same(one, two, ["k"]) and verify.same(one, one.repartition(7), ["k"])


def test_nulls_and_empty_texts_differ_and_empty_tables_are_equal(spark):
    null, empty = (spark.createDataFrame([(1, v)], SCHEMA) for v in (None, ""))
    assert not verify.same(null, empty, ["k"])
    assert verify.same(null.limit(0), empty.limit(0), ["k"]) and verify.differences(null.limit(0), empty.limit(0), ["k"]).collect() == []
    assert [r.side for r in verify.differences(null, null.limit(0), ["k"]).collect()] == ["gone"]


def test_equal_tables_shuffle_leaves_only_and_few_rows_are_read_for_a_change(spark):
    rows = spark.range(60_000).select(F.col("id").alias("k"), F.col("id").cast("string").alias("v"))
    same = verify.differences(rows, rows.repartition(3), ["k"])
    assert "Exchange" not in same._jdf.queryExecution().executedPlan().toString() and same.isEmpty()
    other = rows.withColumn("v", F.when(F.col("k") == 5, "z").otherwise(F.col("v")))
    trees = verify.tree(rows, ["k"]), verify.tree(other, ["k"])
    assert verify.unequal(*trees).count() == 1 and trees[0].count() <= verify.FAN**verify.DEPTH
    assert sorted((r.side, r.k, r.v) for r in verify.differences(rows, other, ["k"], trees).collect()) == [("gone", 5, "5"), ("new", 5, "z")]
