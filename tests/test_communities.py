"""Communities against plain removal of the weakest pair, on graphs with cycles, calls, imports and files."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from gneissflow.operators import communities as C


def plain_parts(nodes, links):
    near = {x: set() for x in nodes}
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    out, seen = [], set()
    for x in nodes:
        if x not in seen:
            todo, own = [x], set()
            while todo:
                y = todo.pop()
                if y not in own:
                    own.add(y)
                    todo += near[y]
            seen |= own
            out.append(own)
    return out


def plain_communities(nodes, weights, limit):
    """(members, internal pairs) by removing one weakest pair at a time."""
    key = lambda p: (weights[p], p[0].encode("utf-16-be"), p[1].encode("utf-16-be"))

    def go(own, links):
        n = len(own)
        while n > limit or (n > 20 and len(links) / (n * (n - 1) / 2) < 0.1):
            if not links:
                break
            links = sorted(links, key=key)[1:]
            parts = plain_parts(own, links)
            if len(parts) > 1:
                return [x for p in parts for x in go(p, [e for e in links if e[0] in p])]
        return [(tuple(sorted(own)), len(links))]

    return [x for p in plain_parts(nodes, weights) for x in go(p, [e for e in weights if e[0] in p]) if len(x[0]) > 1]


def random_graph(rng, tag):
    """(edge rows, node rows, expanded pairs with weights); files of some symbols, astral and high names too."""
    files = [f"{tag}/{rng.choice('abc')}/f{i}" for i in range(rng.randrange(1, 9))]
    holds = {f: [f"{f}#{rng.choice(['s', 'T', 'ﬁ', '\U0001f600'])}{i}" for i in range(rng.randrange(0, 7))] for f in files}
    symbols = [s for own in holds.values() for s in own]
    imports = {(rng.choice(files), rng.choice(files)) for _ in range(rng.randrange(0, 2 * len(files)))}
    calls = {(rng.choice(symbols), rng.choice(symbols)) for _ in range(rng.randrange(0, len(symbols) + 1))} if symbols else set()
    order = lambda a, b: (a, b) if a.encode("utf-16-be") < b.encode("utf-16-be") else (b, a)
    weights = {order(a, b): 0.5 for f, g in imports for a in holds[f] for b in holds[g] if a != b}
    weights |= {order(a, b): 1.0 for a, b in calls if a != b}
    rows = [("CONTAINS", "file:" + f, "sym:" + s) for f, own in holds.items() for s in own] + [("IMPORTS", "file:" + a, "file:" + b) for a, b in imports]
    rows += [("CALLS", "sym:" + a, "sym:" + b) for a, b in calls]
    return rows, [("sym:" + s, "symbol") for s in symbols] + [("file:" + f, "file") for f in files], weights


def tables(spark, rows, nodes):
    return spark.createDataFrame(rows, "kind string, src string, dst string"), spark.createDataFrame(nodes, "id string, kind string")


@pytest.mark.parametrize("limit, bound", [(6, C.BOUND), (6, 3), (25, 7)])
def test_clusters_against_plain_removal(spark, limit, bound):
    rng = random.Random(limit * bound)
    rows, nodes, want = [], [], set()
    for i in range(30):
        r, n, weights = random_graph(rng, f"g{i}")
        rows += r
        nodes += n
        want |= set(plain_communities([x[4:] for x, k in n if k == "symbol"], weights, limit))
    numbered, links, _ = C.symbol_links(*tables(spark, rows, nodes))
    got = C.clusters(links, limit, bound).where("n > 1").join(numbered, "s").groupBy("cluster").agg(F.collect_list("id").alias("ids"), F.max("n").alias("n"), F.max("m").alias("m"))
    got = got.collect()
    assert {(tuple(sorted(x[4:] for x in r.ids)), r.m) for r in got} == want
    assert all(r.n == len(r.ids) for r in got)


def test_labels_ids_and_cohesion(spark):
    rows, nodes, weights = random_graph(random.Random(11), "one")
    got = {tuple(r.members): r for r in C.communities(*tables(spark, rows, nodes)).collect()}
    symbols = [x[4:] for x, k in nodes if k == "symbol"]
    want = plain_communities(symbols, weights, max(2, -(-len(symbols) // 4)))
    utf16 = lambda x: x.encode("utf-16-be")
    assert set(got) == {tuple(sorted(m, key=utf16)) for m, _ in want} and want
    for members, m in want:
        r, n = got[tuple(sorted(members, key=utf16))], len(members)
        dirs = [x.split("#")[0].rsplit("/", 1)[0] for x in members]
        assert r.label == min(set(dirs), key=lambda d: (-dirs.count(d), utf16(d))) and r.member_count == n
        assert abs(r.cohesion - m / (n * (n - 1) / 2)) < 6e-5
        assert r.id == "c-" + hashlib.sha256("\n".join(r.members).encode()).hexdigest()[:8]


def test_no_links_and_no_symbols(spark):
    none = tables(spark, [("CONTAINS", "file:a", "sym:a#b")], [("sym:a#b", "symbol"), ("file:a", "file")])
    assert C.communities(*none).collect() == []
    assert C.communities(none[0].limit(0), none[1].limit(0)).collect() == []


def test_links_grow_with_symbols_and_imports_and_no_task_folds_a_component(spark):
    """Two files of 1,200 symbols that import each other: 1.44 million pairs in one component."""
    n = 1200
    rows = [("CONTAINS", f"file:f{f}", f"sym:f{f}#s{i:04}") for f in range(2) for i in range(n)] + [("IMPORTS", "file:f0", "file:f1")]
    edges, nodes = tables(spark, rows, [(r[2], "symbol") for r in rows[:-1]])
    _, links, total = C.symbol_links(edges, nodes)
    assert links.where("b >= 0").count() <= total + 1 and links.count() <= 2 * total + 1
    got = C.communities(edges, nodes, bound=500).collect()
    # the weakest pairs are those of the smallest symbols: f0 is taken off name by name until a quarter and 600 - 1 ... are left
    assert got and max(r.member_count for r in got) <= total // 4 + 1
    plain = C.clusters(links, total // 4).where("n > 1").groupBy("cluster").count().collect()
    assert sorted(r["count"] for r in plain) == sorted(r.member_count for r in got)
