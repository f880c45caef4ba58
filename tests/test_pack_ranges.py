"""Packing under a budget in ranges against one plain fold."""

import random

import pytest

from gneissflow.operators import rank


def plain(rows, budget):
    out, left = [], budget
    for o, size, clip in sorted(rows):
        fits = left > 0 if clip else size <= left
        used = min(size, left) if fits else 0
        left -= used
        out.append((o, size, used, fits, fits and used < size))
    return out


@pytest.mark.parametrize("clips, budget", [(0.0, 4000), (0.2, 4000), (0.0, 0), (0.3, 10**9), (0.0, 777)])
def test_ranges_against_one_fold(spark, clips, budget):
    rng = random.Random(budget)
    rows = [(i, rng.choice([0, 1, 3, 10, 50, 200, 5000]), rng.random() < clips) for i in range(1500)]
    items = spark.createDataFrame([(str(o), s, c, o) for o, s, c in rows], "id string, size long, clipable boolean, o long")
    got = sorted(rank.greedy_pack(items, budget, ["o"], parts=13).collect())
    assert [(int(r.id), r.size, r.used, r.included, r.clipped) for r in got] == plain(rows, budget)
    assert [r.ord for r in got] == list(range(1500))


def test_starts_of_ranges(spark):
    """All fits, then one range is cut, then nothing fits."""
    rows = [(str(i), 10 if i < 600 else 7, False, i) for i in range(1000)]
    items = spark.createDataFrame(rows, "id string, size long, clipable boolean, o long")
    cut = items.repartitionByRange(20, "o").withColumn("_part", rank.F.spark_partition_id())
    starts = rank._starts(rank.materialize(cut, "cut"), 5005, ["o"])
    assert starts[0] == (5005, 0) and sorted(starts)[-1] in starts and starts[max(starts)][0] == 5
    assert [left for left, _ in starts.values() if left == 5]


def test_list_of_what_is_left_out(spark):
    rows = [(i, f"x{i}", 1, 0, i < 3, False) for i in range(60)]
    packed = spark.createDataFrame(rows, "ord long, id string, size long, used long, included boolean, clipped boolean")
    got = [(r.id, r.kept) for r in rank.packed_list(packed, 50).collect()]
    assert got[:3] == [("x0", True), ("x1", True), ("x2", True)] and got[3:53] == [(f"x{i}", False) for i in range(3, 53)] and got[53:] == [("...7 more", False)]
    none = packed.limit(0)
    assert rank.packed_list(none).collect() == []
    assert rank.greedy_pack(none.selectExpr("id", "size", "clipped AS clipable", "ord AS o"), 10, ["o"]).collect() == []
