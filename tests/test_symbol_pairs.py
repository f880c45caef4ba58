"""Links between symbols against plain loops, and their plan."""

import random

import pytest

from gneissflow.operators import graph as G


def plain(rows):
    holds = [(s, d) for k, s, d in rows if k == "CONTAINS" and d.startswith("sym:")]
    out = {}
    for k, s, d in rows:
        if k == "IMPORTS":
            out |= {(min(x, y), max(x, y)): 0.5 for f, x in holds if f == s for g, y in holds if g == d if x != y}
    return out | {(min(s, d), max(s, d)): 1.0 for k, s, d in rows if k == "CALLS" and s.startswith("sym:") and s != d}


@pytest.mark.parametrize("several", [False, True])
def test_pairs_are_whole_and_not_shuffled(spark, several):
    """Before, every pair of an import was grouped by its two names."""
    rng = random.Random(several)
    rows = {("CONTAINS", f"file:f{i % 40}", f"sym:s{(i * 7) % 150:03}") for i in range(300 if several else 0)}
    rows |= {("CONTAINS", f"file:f{i % 40}", f"sym:s{i:03}") for i in range(150)}
    rows |= {("IMPORTS", f"file:f{rng.randrange(42)}", f"file:f{rng.randrange(42)}") for _ in range(60)}
    rows |= {("IMPORTS", f"file:f{i}", "file:f0") for i in range(40)} | {("IMPORTS", "file:f0", f"file:f{i}") for i in range(20)}
    rows |= {("CALLS", f"sym:s{rng.randrange(160):03}", f"sym:s{rng.randrange(160):03}") for _ in range(300)} | {("CALLS", "file:f1", "sym:s001")}
    rows = sorted(rows) + [("IMPORTS", None, "file:f0"), ("IMPORTS", "file:f0", None)]
    df = G.symbol_pairs(spark.createDataFrame(rows, "kind string, src string, dst string"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    got = df.collect()
    assert {(r.a, r.b): r.weight for r in got} == plain([r for r in rows if r[1] and r[2]]) and len(got) == len({(r.a, r.b) for r in got})
    assert several or "Aggregate" not in plan
    assert "BroadcastHashJoin" not in plan
