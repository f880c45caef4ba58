"""Components by ranges of near numbers, and communities that are whole components."""

import random

import pytest
from pyspark.sql import functions as F

from gneissflow.operators import communities as C
from gneissflow.operators import graph as G
from gneissflow.plans import queries


def written(monkeypatch, module):
    """Names and tables that a module writes from now on."""
    out, write = [], module.materialize
    monkeypatch.setattr(module, "materialize", lambda df, name: out.append((name, write(df, name))) or out[-1][1])
    return out


def plain(pairs):
    low = {x: x for p in pairs for x in p if p[0] != p[1]}
    while True:
        old = dict(low)
        for a, b in pairs:
            if a != b:
                low[a] = low[b] = min(low[a], low[b])
        if old == low:
            return low


@pytest.mark.parametrize("chunk", [1, 3, 1000])
@pytest.mark.parametrize("far", [1, 3, 300])
def test_near_and_far_links(spark, chunk, far):
    rng = random.Random(chunk * far)
    pairs = [(x, x + rng.randrange(-far, far + 1)) for x in (rng.randrange(600) for _ in range(250))]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        got = G.near_components(spark.createDataFrame(pairs, "a long, b long"), chunk=chunk).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r.node: r.comp for r in got} == plain(pairs) and len(got) == len(plain(pairs))


def test_no_links(spark):
    assert G.near_components(spark.createDataFrame([(1, 1)], "a long, b long")).collect() == []


def test_few_chains_need_rounds_and_whole_components_no_fold(spark, monkeypatch, sf):
    """Before, the chains of all customers went through rounds of labels, and every one through the fold in Python."""
    rounds, folds = written(monkeypatch, G), written(monkeypatch, C)
    assert queries.communities_pruned(spark, sf).count() > 0
    links = next(t for n, t in folds if n == "links").count()
    folded = sum(t.where("kind = 'vertex'").count() for n, t in folds if n == "folded")
    longest = dict(folds)["sizes"].agg(F.max("n")).first()[0]
    torn = sum(t.count() for n, t in rounds if n == "torn")  # at most a chain between each two ranges
    assert "stars" in dict(rounds) and torn < 8 < links and longest <= C.LARGE and folded == 0
