import os
import random

import pytest
from pyspark.sql import functions as F

from gneissflow import scratch
from gneissflow.functions import paths as P
from gneissflow.operators import edges as E
from gneissflow.operators import graph as G
from gneissflow.operators import history, overlap, rank, skew
from gneissflow.operators import risk as R
from gneissflow.operators import sections as V
from gneissflow.operators.communities import communities
from gneissflow.session import spread

EDGE = "kind string, src string, dst string, confidence double, tier string"
SYM = "path string, pos int, kind string, name string, qualified_name string, exported boolean, is_test boolean, heritage struct<extends:array<string>,implements:array<string>>"
IMP = "path string, pos int, kind string, imported_name string, module_specifier string"
CALL = "path string, pos int, caller_qualified_name string, callee_text string, receiver string"


def edges(spark, *rows):
    return spark.createDataFrame([(k, s, d, 1.0, "extracted") for k, s, d in rows], EDGE)


def sym(path, pos, name, kind="function", exported=True, ext=(), impl=(), owner=None):
    return (path, pos, kind, name, f"{path}#{owner + '.' if owner else ''}{name}", exported, "test/" in path, (list(ext), list(impl)))


def build(spark, files, symbols=(), imports=(), calls=()):
    f = spark.createDataFrame([(p, "typescript") for p in files], "path string, language string")
    return E.build_graph(f, spark.createDataFrame(list(symbols), SYM), spark.createDataFrame(list(imports), IMP), spark.createDataFrame(list(calls), CALL))


def as_set(df, *columns):
    return {tuple(r) for r in df.select(*columns).collect()}


def test_churn_and_cochange(spark):
    log = [(1, "10", "5", "auth"), (1, "2", "0", "util"), (2, "1", "1", "auth"), (3, "-", "-", "auth")] + [(9, "1", "1", f"f{i}") for i in range(51)]
    df = spark.createDataFrame(log, "commit_no long, added string, deleted string, path string")
    assert as_set(history.churn(df), "path", "churn") == {("auth", 17), ("util", 2)}
    assert as_set(history.cochange(df), "a", "b", "n") == {("auth", "util", 1)}


def test_import_resolution(spark):
    files = ["src/util.ts", "src/deep/mod.tsx", "src/pkg/index.ts", "src/mod.mts", "src/c.cts", "src/cli.ts", "src/index.ts", "bin/x.js"]
    asked = [("src/index.ts", "./util"), ("src/index.ts", "./deep/mod"), ("src/index.ts", "./pkg"), ("src/index.ts", "./missing"), ("src/a.ts", "../../outside"), ("src/a.ts", "lodash"), ("src/a.ts", "./mod.mjs"), ("src/a.ts", "./c.cjs"), ("bin/x.js", "../dist/src/cli.js"), ("src/a.ts", "../dist/src/cli.js"), ("src/a.ts", "./util.js")]
    imports = spark.createDataFrame([(p, i, "named", "n", m) for i, (p, m) in enumerate(asked)], IMP)
    got = {(r.path, r.module_specifier): (r.external, r.target) for r in E.resolve_imports(imports, spark.createDataFrame([(f,) for f in files], "path string")).collect()}
    want = ["src/util.ts", "src/deep/mod.tsx", "src/pkg/index.ts", None, None, None, "src/mod.mts", "src/c.cts", "src/cli.ts", None, "src/util.ts"]
    assert [got[a][1] for a in asked] == want
    assert [got[a][0] for a in asked] == [False, False, False, False, True, True, False, False, False, False, False]


def test_graph(spark):
    a, i, t = "src/auth.ts", "src/index.ts", "test/auth.test.ts"
    symbols = [sym(a, 0, "AuthService", "class", ext=["BaseService"], impl=["IAuth"]), sym(a, 1, "rotate", "method", owner="AuthService"), sym(a, 2, "tokenize", "method", owner="AuthService"), sym(a, 3, "BaseService", "class"), sym(i, 0, "main"), sym(i, 1, "IAuth", "interface")]
    imports = [(i, 0, "named", "AuthService", "./auth"), (i, 1, "named", "z", "zod"), (t, 0, "named", "AuthService", "../src/auth"), (a, 0, "named", "IAuth", "./index")]
    calls = [(i, 0, f"{i}#main", "AuthService", "identifier"), (i, 1, f"{i}#main", "unresolvedFunc", "identifier"), (i, 2, f"{i}#main", "z.string", "property"), (i, 3, f"{i}#main", "z\n  .object", "property"), (a, 0, f"{a}#AuthService.rotate", "this.tokenize", "this"), (a, 1, f"{a}#AuthService.rotate", "this.gone", "this"), (i, 4, "", "AuthService.rotate", "property"), (i, 5, "", "f()", "unresolved")]
    g = build(spark, [a, i, t], symbols, imports, calls)
    e = as_set(g.edges, "kind", "src", "dst", "confidence")
    assert len([x for x in e if x[0] == "CONTAINS"]) == 6
    assert {x for x in e if x[0] == "IMPORTS"} == {("IMPORTS", f"file:{i}", f"file:{a}", 1.0), ("IMPORTS", f"file:{t}", f"file:{a}", 1.0), ("IMPORTS", f"file:{a}", f"file:{i}", 1.0)}
    assert {x for x in e if x[0] in ("INHERITS", "IMPLEMENTS")} == {("INHERITS", f"sym:{a}#AuthService", f"sym:{a}#BaseService", 0.95), ("IMPLEMENTS", f"sym:{a}#AuthService", f"sym:{i}#IAuth", 0.9)}
    assert {x for x in e if x[0] == "CALLS"} == {("CALLS", f"sym:{i}#main", f"sym:{a}#AuthService", 0.9), ("CALLS", f"sym:{a}#AuthService.rotate", f"sym:{a}#AuthService.tokenize", 0.95), ("CALLS", f"file:{i}", f"sym:{a}#AuthService.rotate", 0.9)}
    assert {x for x in e if x[0] == "TESTED_BY"} == {("TESTED_BY", f"file:{t}", f"file:{a}", 0.8)}
    got = dict(as_set(g.unresolved, "caller", "count"))
    assert got[f"{i}#main"] == 1 and got[f"{a}#AuthService.rotate"] == 1


def test_tested_by_name(spark):
    g = build(spark, ["src/util.ts", "test/util.test.ts"])
    assert as_set(g.edges, "kind", "src", "dst", "confidence") == {("TESTED_BY", "file:test/util.test.ts", "file:src/util.ts", 0.7)}


def test_impact(spark):
    e = edges(spark, ("CALLS", "sym:A", "sym:B"), ("CALLS", "sym:B", "sym:C"), ("CALLS", "sym:C", "sym:A"), ("IMPORTS", "file:y", "file:x"))
    seeds = lambda s: spark.createDataFrame([(s,)], "id string")
    assert as_set(G.impact(e, seeds("sym:A")), "id", "depth", "score") == {("sym:C", 1, 0.5), ("sym:B", 2, 0.25)}
    assert as_set(G.impact(e, seeds("file:x")), "id", "depth", "score") == {("file:y", 1, 0.4)}


def test_impact_against_relaxation(spark):
    rng = random.Random(5)
    for _ in range(3):
        rows = {(rng.choice(["CALLS", "IMPORTS"]), f"n{rng.randrange(25)}", f"n{rng.randrange(25)}") for _ in range(60)}
        best, queue = {"n0": (1.0, 0)}, [("n0", 1.0, 0)]
        while queue:
            queue.sort(key=lambda x: -x[1])
            node, score, depth = queue.pop(0)
            if depth < 3:
                for k, s, d in rows:
                    nxt = score * (0.5 if k == "CALLS" else 0.4)
                    if d == node and nxt >= 0.05 and nxt > best.get(s, (0, 0))[0]:
                        best[s] = (nxt, depth + 1)
                        queue.append((s, nxt, depth + 1))
        want = {(n, d, round(s, 9)) for n, (s, d) in best.items() if n != "n0"}
        got = G.impact(edges(spark, *rows), spark.createDataFrame([("n0",)], "id string"))
        assert {(r.id, r.depth, round(r.score, 9)) for r in got.collect()} == want


def test_communities(spark):
    rows = [("CONTAINS", "file:a.ts", "sym:a.ts#x"), ("CONTAINS", "file:a.ts", "sym:a.ts#y"), ("CONTAINS", "file:b.ts", "sym:b.ts#z"), ("CONTAINS", "file:b.ts", "sym:b.ts#w"), ("CALLS", "sym:a.ts#x", "sym:a.ts#y"), ("CALLS", "sym:b.ts#z", "sym:b.ts#w"), ("IMPORTS", "file:a.ts", "file:b.ts")]
    nodes = spark.createDataFrame([(d, "symbol") for k, _, d in rows if k == "CONTAINS"], "id string, kind string")
    got = communities(edges(spark, *rows), nodes).collect()
    assert len(got) == 2 and all(r.member_count == 2 for r in got) and {r.label for r in got} == {"."}
    path = [("CALLS", f"sym:p#{i:02}", f"sym:p#{i + 1:02}") for i in range(20)]
    line = spark.createDataFrame([(f"sym:p#{i:02}", "symbol") for i in range(21)], "id string, kind string")
    assert all(r.member_count <= 20 or r.cohesion >= 0.1 for r in communities(edges(spark, *path), line).collect())


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(70)]
    up = {x: x for p in pairs for x in p}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    got = dict(as_set(G.components(spark.createDataFrame(pairs, "a long, b long")), "node", "comp"))
    assert got == {x: root(x) for a, b in pairs if a != b for x in (a, b)}


def test_hubs_dead_code_and_gaps(spark):
    s = spark.createDataFrame([sym("src/a.ts", 0, "helper"), sym("src/a.ts", 1, "unused"), sym("src/a.ts", 2, "inner", exported=False), sym("src/index.ts", 0, "main"), sym("src/a.ts", 3, "T", "type"), sym("test/a.test.ts", 0, "t"), sym("bin/run.ts", 0, "go")], SYM)
    e = edges(spark, ("CALLS", "sym:src/a.ts#unused", "sym:src/a.ts#helper"), ("CALLS", "sym:src/b.ts#x", "sym:src/a.ts#helper"), ("CALLS", "sym:src/a.ts#helper", "sym:src/a.ts#inner"), ("CALLS", "sym:src/b.ts#x", "sym:src/a.ts#toString"), ("TESTED_BY", "file:test/a.test.ts", "file:src/a.ts"), ("IMPORTS", "file:test/a.test.ts", "file:src/a.ts"), ("IMPORTS", "file:src/b.ts", "file:src/a.ts"))
    assert as_set(G.god_symbols(e, s), "qualified_name", "score") == {("src/a.ts#helper", 2)}
    assert as_set(G.dead_code(e, s), "qualified_name", "confidence") == {("src/a.ts#unused", 0.6)}
    assert G.dead_code(e.where("kind <> 'CALLS'"), s).count() == 0
    assert as_set(G.boundary_files(e), "path") == {("src/a.ts",)}
    assert as_set(G.dir_imports(e), "from_dir", "to_dir", "n") == {("test", "src", 1)}
    assert as_set(G.test_gaps(e, s), "path") == {("src/index.ts",), ("test/a.test.ts",)}
    nodes = spark.createDataFrame([("sym:src/a.ts#helper",)], "id string")
    assert G.integrity(nodes, e.where("dst LIKE '%helper'")).collect()[0] == (2, 0)


def test_surprises_and_tour(spark):
    e = edges(spark, ("CALLS", "sym:a", "sym:b"), ("CALLS", "sym:b", "sym:c"), *[("IMPORTS", "file:0", f"file:{i}") for i in range(1, 4)], ("CONTAINS", "file:1", "sym:a"), ("IMPORTS", "file:1", "file:9"), ("IMPORTS", "file:9", "file:0"))
    member = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "2")], "member string, community string")
    lang = spark.createDataFrame([("a", "ts"), ("b", "js"), ("c", "js")], "member string, language string")
    got = G.surprises(e, member, spark.createDataFrame([("b",)], "member string"), lang).collect()
    assert [(r.src, r.score, r.reasons) for r in got] == [("a", 7, ["cross-community", "cross-language", "hub-periphery"]), ("b", 2, ["hub-periphery"])]
    nodes = spark.createDataFrame([(f"file:{i}",) for i in (0, 1, 2, 3, 9)] + [("sym:a",)], "id string")
    def tour(start, *more):
        return [r.node_id for r in V.tour(e, nodes, spark.createDataFrame([(start,)], "id string"), *more).orderBy("step").collect()]

    assert tour("file:0", None) == tour("file:0", 6) == ["file:0", "file:1", "file:2", "file:3", "file:9", "sym:a"] and tour("file:0", 5) == ["file:0", "file:1", "file:2", "file:3", "file:9"]
    assert tour("file:0") == ["file:0", "file:1", "file:2", "file:3", "file:9", "sym:a"]
    assert tour("file:9") == ["file:9", "file:0", "file:1", "file:2", "file:3", "sym:a"]
    assert tour("file:2") == [] and tour("file:none") == []


@pytest.mark.parametrize(("tested", "total"), [(True, 0.6), (False, 0.9)])
def test_risk(spark, tested, total):
    s = spark.createDataFrame([("src/auth.ts#authUser", "authUser", "src/auth.ts")], "qualified_name string, name string, path string")
    rows = [("CALLS", "sym:lib/x.ts#f", "sym:src/auth.ts#authUser")] + ([("TESTED_BY", "file:t", "file:src/auth.ts")] if tested else [])
    churn = spark.createDataFrame([("src/auth.ts", 100)], "path string, churn long")
    e = edges(spark, *rows)
    assert tuple(R.most(churn, e).collect()[0]) == (100, 1) and tuple(R.most(churn.where("false"), e.where("false")).collect()[0]) == (0, 0)
    row = R.risk(s, e, churn, R.most(churn, e)).collect()[0]
    assert row.total_risk == total and row.factors[0].raw == int(tested) and len(row.factors) == 5


def test_overlap(spark):
    s = spark.createDataFrame([("a", "AuthService", (1, 5)), ("a", "rotate", (2, 4)), ("a", "other", (6, 8)), ("b", "all", (1, 2))], "path string, qualified_name string, range struct<startLine:int,endLine:int>")
    hunk = spark.createDataFrame([("a", 3, 3)], "path string, start int, end int")
    paths = spark.createDataFrame([("a",), ("b",)], "path string")
    assert as_set(overlap.changed_symbols(hunk, s), "qualified_name") == {("AuthService",), ("rotate",)}
    assert as_set(overlap.changed_symbols(hunk, s, paths), "qualified_name") == {("AuthService",), ("rotate",), ("all",)}
    assert overlap.changed_symbols(hunk.where("false"), s).count() == 0
    assert overlap.same_rows(paths, paths) and not overlap.same_rows(paths, paths.limit(1))


def test_overlap_against_all_pairs(spark):
    rng = random.Random(3)
    one = lambda n: [(rng.choice("ab"), i, a := rng.randrange(3000), a + rng.choice([-1, 0, 3, 40, 900])) for i in range(n)]
    hunks, spans = [(k, a, b) for k, _, a, b in one(25)] + [(None, 0, 3000)], one(300) + [(None, 999, 0, 5)]
    want = {(k, i) for k, i, a, b in spans for h, x, y in hunks if k is not None and k == h and a <= b and x <= y and a <= y and b >= x}
    got = overlap.interval_overlap(
        spark.createDataFrame(hunks, "k string, start int, end int"), spark.createDataFrame(spans, "k string, v int, start int, end int"), "k", "v", 64,
    )
    assert as_set(got, "k", "v") == want and got.count() == len(want)


def test_ranks_over_ranges(spark):
    rows = [(i, (i * 7919) % 1000) for i in range(1000)]
    got = rank.ranked(spark.createDataFrame(rows, "id long, v long"), "id", [F.desc("v")], "r").collect()
    assert {r.id: r.r for r in got} == {i: 1000 - v for i, v in rows}
    assert rank.ranked(spark.createDataFrame([], "id long, v long"), "id", [F.desc("v")], "r").count() == 0


def test_salted_joins_are_plain_joins(spark):
    left = spark.range(3000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 7 WHEN id % 50 = 1 THEN NULL ELSE id % 500 END AS k")
    right = spark.range(400).selectExpr("id AS k", "id * 2 AS x")
    hot = skew.hot_keys(left, "k")
    assert hot == [7] and skew.hot_keys(left.limit(900), "k") == []
    for how in ("inner", "left"):
        got, want = skew.salted_join(left, right, "k", "id", hot, how), left.join(right, "k", how)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.select(got.columns).collect()))


def test_spread_deals_out_few_partitions_only(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(f"{tmp_path}/one")
    spark.range(100).repartition(9).write.option("maxRecordsPerFile", 5).parquet(f"{tmp_path}/many")
    one, many = (spark.read.parquet(f"{tmp_path}/{n}") for n in ("one", "many"))
    assert spread(one).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and spread(one).count() == 100
    assert (spread(many) is many) == (many.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism)


def test_scratch_tables_go(spark):
    def made():
        inner = scratch.materialize(spark.range(5), "inner")
        paths.append(inner._scratch_path)
        return inner.where("id > 1")

    paths = []
    out = scratch.settled(made, "outer")
    exists = lambda p: os.path.exists(p.removeprefix("file:"))
    assert out.count() == 3 and not exists(paths[0]) and exists(out._scratch_path)
    scratch.drop(out)
    assert not exists(out._scratch_path)


def test_packing(spark):
    def run(items, budget):
        df = spark.createDataFrame([(i, n, s, c) for i, (n, s, c) in enumerate(items)], "o int, id string, size long, clipable boolean")
        return [(r.id, r.included, r.clipped, r.used) for r in rank.greedy_pack(df, budget, ["o"]).orderBy("ord").collect()]

    assert run([("a", 100, False), ("b", 100, False)], 150) == [("a", True, False, 100), ("b", False, False, 0)]
    assert run([("a", 500, True)], 200) == [("a", True, True, 200)]
    assert [x[1] for x in run([("a", 100, False), ("b", 100, False), ("c", 40, False), ("d", 500, True), ("e", 5, True)], 150)] == [True, False, True, True, False]


def test_ranking(spark):
    s = spark.createDataFrame([("src/a.ts#AuthService.rotate", "rotate", "src/a.ts", "rotate()", "", False), ("src/b.ts#other", "other", "src/b.ts", "other()", "", True), ("src/c.ts#far", "far", "src/c.ts", "far()", "", False)], "qualified_name string, name string, path string, signature string, jsdoc string, exported boolean")
    gods = spark.createDataFrame([("src/b.ts#other", 3)], "qualified_name string, score long")
    changed = spark.createDataFrame([("src/a.ts#AuthService.rotate",)], "qualified_name string")
    e = edges(spark, ("IMPORTS", "file:src/a.ts", "file:src/c.ts"))
    got = rank.rank_symbols(s, "locate AuthService.rotate", e, changed, gods).collect()
    assert [r.qualified_name for r in got] == ["src/a.ts#AuthService.rotate", "src/b.ts#other", "src/c.ts#far"]
    assert got[0].score == 1 / 61 + 1 / 61 and got[1].score == 1 / 62 + 1 / 61 and got[2].score == 1 / 63 + 1 / 61


def test_top_dir_variants(spark):
    r = spark.createDataFrame([("a.ts",), ("b/c.ts",)], "p string").select(P.top_dir("p").alias("x"), P.top_dir("p", None).alias("y")).collect()
    assert [tuple(x) for x in r] == [(".", "a.ts"), ("b", "b")]
