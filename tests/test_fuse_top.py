"""The head of a rank fusion against the whole fusion."""

import random

import pytest
from pyspark.sql import functions as F

from gneissflow.functions.text import utf16_key
from gneissflow.operators import rank


def plain(lists, k):
    u = lambda x: x.encode("utf-16-be")
    score = {}
    for rows in lists:
        for place, (x, _) in enumerate(sorted(rows.items(), key=lambda r: (-(r[1] or 0), u(r[0]))), 1):
            score[x] = score.get(x, 0.0) + 1.0 / (60 + place)
    return sorted(((x, s) for x, s in score.items() if x in lists[0]), key=lambda r: (-r[1], u(r[0])))[:k]


@pytest.mark.parametrize("k, sizes", [(5, (3000, 400, 60)), (3, (2500, 2500)), (50, (20, 10)), (7, (3000, 0, 2))])
def test_head_equals_the_whole_fusion(spark, k, sizes):
    rng = random.Random(k)
    names = [f"{rng.choice(['a', 'ﬁ', '\U0001f600', 'z'])}{i}" for i in range(3000)]
    lists = [{x: float(rng.randrange(40)) if i != 1 else None for x in rng.sample(names, n)} for i, n in enumerate(sizes)]
    tables = [(spark.createDataFrame(list(rows.items()), "x string, p double"), None if i == 1 else "p") for i, rows in enumerate(lists)]
    got = [(r.x, round(r.score, 12)) for r in rank.fuse_top("x", tables, k).collect()]
    assert got == [(x, round(s, 12)) for x, s in plain(lists, k)]


def test_no_list_is_sorted_as_a_whole(spark):
    rows = spark.range(50_000).select(F.concat(F.lit("n"), "id").alias("x"), (F.col("id") % 977).cast("double").alias("p"))
    head = rank._first_places(rows, "x", [F.desc("p"), utf16_key("x")], 130)
    plan = head._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "rangepartitioning" not in plan
    want = sorted(((i % 977, f"n{i}") for i in range(50_000)), key=lambda r: (-r[0], r[1]))
    some = [want[i][1] for i in (0, 131, 20_000, 49_999)]
    got = rank._places_of(rows, "x", "p", spark.createDataFrame([(x,) for x in some], "x string"))
    assert {r.x: r.place for r in got.collect()} == dict(zip(some, (1, 132, 20_001, 50_000), strict=True))
