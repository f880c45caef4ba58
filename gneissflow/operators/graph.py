"""Graph analytics over edges(kind, src, dst, ...) and nodes(id, kind)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions.text import utf16_key
from ..scratch import drop, materialize
from ..session import dealt, tasks_for
from .skew import LEAST, SHARE, hot_keys, salted_join

#: Names that never count as hubs (fixed values).
NOISE = [
    "constructor", "toString", "console", "process", "require", "module", "exports", "compareBytewise", "digestOf", "canonicalJson",
    "estimateTokens", "redact", "isDenied", "canonicalizePath", "runGit", "runGitNullable", "readSource", "languageOf", "compareBytewiseBytes",
]
TYPE_ONLY = ["interface", "type", "enum"]
WEIGHT = {"CALLS": 1.0, "IMPORTS": 0.5}
IMPACT = {"CALLS": 0.5, "IMPORTS": 0.4}
DEPTH, FLOOR = 3, 0.05


def bare(id_: str | Column) -> Column:
    return F.regexp_replace(id_, "^(sym|file):", "")


def in_degree(edges: DataFrame, kind: str = "CALLS") -> DataFrame:
    """dst, n: distinct edges of a kind that lead to a node."""
    return edges.where(F.col("kind") == kind).groupBy("dst").agg(F.count(F.lit(1)).alias("n"))


def census(edges: DataFrame, top: int = 20) -> DataFrame:
    """The most-called symbols: qualified_name, n."""
    counted = in_degree(edges).where(F.col("dst").startswith("sym:")).select(bare("dst").alias("qualified_name"), "n")
    return counted.orderBy(F.desc("n"), utf16_key("qualified_name")).limit(top)


def god_symbols(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """qualified_name, score of symbols that are exported or called from another file."""
    calls = edges.where("kind = 'CALLS' AND dst LIKE 'sym:%'").select("src", bare("dst").alias("qualified_name"))
    calls = calls.where(~P.simple_name("qualified_name").isin(NOISE))
    cross = F.col("src").startswith("sym:") & (P.file_of(bare("src")) != P.file_of("qualified_name"))
    counted = calls.groupBy("qualified_name").agg(F.count(F.lit(1)).alias("score"), F.bool_or(cross).alias("_x"))
    public = symbols.where("exported").select("qualified_name").distinct().withColumn("_p", F.lit(True))
    return counted.join(public.hint("merge"), "qualified_name", "left").where(F.col("_x") | F.col("_p")).select("qualified_name", "score")


def boundary_files(edges: DataFrame) -> DataFrame:
    """path of files that another top directory imports."""
    both = edges.where("kind = 'IMPORTS' AND src LIKE 'file:%' AND dst LIKE 'file:%'").select(bare("src").alias("a"), bare("dst").alias("path"))
    return both.where(P.top_dir("a") != P.top_dir("path")).select("path").distinct()


def dir_imports(edges: DataFrame, top: int = 50) -> DataFrame:
    """from_dir, to_dir, n of imports between top directories; a root file is its own directory."""
    both = edges.where("kind = 'IMPORTS' AND src LIKE 'file:%' AND dst LIKE 'file:%'")
    both = both.select(P.top_dir(bare("src"), None).alias("from_dir"), P.top_dir(bare("dst"), None).alias("to_dir"))
    counted = both.where("from_dir <> to_dir").groupBy("from_dir", "to_dir").agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy(F.desc("n"), utf16_key("from_dir"), utf16_key("to_dir")).limit(top)


def dead_code(edges: DataFrame, symbols: DataFrame, top: int = 50) -> DataFrame:
    """Exported values that nothing calls; nothing at all where the graph has no calls."""
    calls = edges.where("kind = 'CALLS'")
    gate = calls.select(F.lit(1).alias("_g")).limit(1)
    live = symbols.where("exported AND NOT is_test").where(~F.col("kind").isin(TYPE_ONLY)).where(~P.is_dead_entry("path"))
    dead = live.join(calls.select(F.col("dst")).distinct().hint("merge"), F.concat(F.lit("sym:"), F.col("qualified_name")) == F.col("dst"), "left_anti")
    found = dead.crossJoin(F.broadcast(gate)).select("qualified_name", F.lit(0.6).alias("confidence"))  # one row
    return found.orderBy(utf16_key("qualified_name")).limit(top)


def test_gaps(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Files with symbols that no test covers; shims are left out."""
    tested = edges.where("kind = 'TESTED_BY'").select(bare("dst").alias("path")).distinct()
    return symbols.select("path").distinct().where(~P.is_shim("path")).join(tested.hint("merge"), "path", "left_anti")


def integrity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: edges whose source, and whose target, is no node."""
    ids = nodes.select(F.col("id")).distinct().hint("merge")
    a = edges.join(ids, F.col("src") == F.col("id"), "left_anti").agg(F.count(F.lit(1)).alias("missing_sources"))
    b = edges.join(ids, F.col("dst") == F.col("id"), "left_anti").agg(F.count(F.lit(1)).alias("missing_targets"))
    return a.crossJoin(b)


def impact(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """id, depth, score of what depends on the seeds (column ``id``), up to three hops back.

    A hop multiplies by 0.5 for calls and 0.4 for imports, so a shorter way always scores higher
    than a longer one: each hop keeps the best score of the nodes it reaches for the first time.
    """
    weight = F.when(F.col("kind") == "CALLS", IMPACT["CALLS"]).otherwise(IMPACT["IMPORTS"])
    back = edges.where(F.col("kind").isin(*IMPACT)).groupBy("src", "dst").agg(F.max(weight).alias("w"))
    back = materialize(back, "back")
    back = dealt(back, tasks_for(back.sparkSession, back.count()), "dst")
    seen = seeds.select("id").distinct().withColumns({"depth": F.lit(0), "score": F.lit(1.0)})
    level = seen
    for depth in range(1, DEPTH + 1):
        reached = level.hint("merge").join(back, F.col("id") == F.col("dst")).groupBy("src").agg(F.max(F.col("score") * F.col("w")).alias("score"))
        reached = reached.select(F.col("src").alias("id"), F.lit(depth).alias("depth"), "score").where(F.col("score") >= FLOOR)
        level = materialize(reached.join(seen.select("id").hint("merge"), "id", "left_anti"), "level")
        seen = seen.unionByName(level)
    return seen.where("depth > 0")


def symbol_pairs(edges: DataFrame) -> DataFrame:
    """a, b, weight of symbols that call each other, or whose files import each other; a < b.

    An import stands for all pairs of the two files' symbols, so the rows grow with the product of the
    numbers of symbols of two files (of some hundreds each), never with the square of the graph.

    No pair of an import is shuffled: a symbol x of one file meets the other file once, with the symbols
    there that a call links it with, and leaves these out.  Two files are one row whichever imports the
    other, so the pairs are distinct, unless a symbol lies in several files.
    """
    holds = edges.where("kind = 'CONTAINS' AND src IS NOT NULL AND dst LIKE 'sym:%'").select(F.col("src").alias("f"), F.col("dst").alias("s"))
    holds = materialize(holds.distinct(), "holds")
    calls = edges.where("kind = 'CALLS' AND src LIKE 'sym:%' AND dst LIKE 'sym:%' AND src <> dst")
    calls = materialize(calls.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct(), "calls")
    imports = edges.where("kind = 'IMPORTS' AND src IS NOT NULL AND dst IS NOT NULL")
    imports = materialize(imports.select(F.least("src", "dst").alias("f"), F.greatest("src", "dst").alias("g")).distinct(), "file_pairs")

    of = lambda f, s: holds.select(F.col("f").alias(f), F.col("s").alias(s)).hint("merge")
    ends = salted_join(calls, of("fa", "a"), "a", "b", hot_keys(calls, "a"))
    ends = salted_join(ends, of("fb", "b"), "b", "a", hot_keys(calls, "b"))
    first = F.col("fa") <= F.col("fb")
    known = ends.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("x"), F.greatest("fa", "fb").alias("g"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("y"))
    known = known.groupBy("x", "g").agg(F.collect_set("y").alias("known"))  # of one file
    half = salted_join(imports, of("f", "x"), "f", "g", hot_keys(imports, "f"))
    half = materialize(half.join(known.hint("merge"), ["x", "g"], "left"), "half_pairs")
    both = salted_join(half, of("g", "y"), "g", "x", hot_keys(half, "g"))
    both = both.where("x < y OR (f <> g AND x > y)").where(F.coalesce(~F.array_contains("known", F.col("y")), F.lit(True)))
    both = both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    if not holds.groupBy("s").count().where("count > 1").isEmpty():
        both = both.distinct()
    return calls.withColumn("weight", F.lit(WEIGHT["CALLS"])).union(both.withColumn("weight", F.lit(WEIGHT["IMPORTS"])))


def components(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, comp: each node that has a link, with the smallest node it can reach.

    Minimum labels with hooking and a jump: in each round a node takes the smallest label among its
    neighbours, an old label's own node learns the better label, and a node takes the label of its
    label.  Labels only fall, and the rounds grow with the logarithm of a chain's length.  Minimum
    aggregates combine before they shuffle; the joins deal out hot nodes (hubs) and hot labels (large
    components) over many tasks.  Whether a label fell, and the hot keys, fewer than ``SHARE`` each,
    reach the driver.  No links: no rows.
    """
    one = pairs.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y")
    ends = [F.struct(F.col(p).alias("node"), F.col(q).alias("y")) for p, q in ("xy", "yx", "xx", "yy")]  # each node is its own neighbour
    both = materialize(one.select(F.explode(F.array(*ends)).alias("e")).select("e.node", "e.y").distinct(), "pairs")
    hubs = hot_keys(both, "y")
    label = held = materialize(both.groupBy("node").agg(F.min("y").alias("comp")), "labels")
    total, large = label.count(), hot_keys(label, "comp")
    while True:
        of_y = salted_join(both, label.select(F.col("node").alias("y"), "comp"), "y", "node", hubs)
        own = F.max(F.when(F.col("y") == F.col("node"), F.col("comp")))
        step = of_y.groupBy("node").agg(own.alias("comp"), F.min("comp").alias("low"))
        # where a label leads: to the best that its own node, or any node with the label, has seen
        aims = step.select(F.col("node").alias("comp"), "low").union(step.select("comp", "low"))
        aims = aims.groupBy("comp").agg(F.min("low").alias("far"))
        new = salted_join(step, aims, "comp", "node", large)
        new = materialize(new.select("node", F.least("low", "far").alias("comp"), F.col("comp").alias("was")), "labels")
        drop(held)
        label, held = new.select("node", "comp"), new
        sizes = new.groupBy("comp").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("comp") < F.col("was")).alias("fell"))
        hot = F.when(F.col("n") > max(total / SHARE, LEAST - 1), F.col("comp"))
        fell, large = sizes.agg(F.bool_or("fell"), F.collect_list(hot)).first()
        if not fell:
            drop(both)
            return label


#: Links that a task of ``near_components`` joins up at once, whatever a task holds.
CHUNK = 500_000


def _stars(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each end of the links, with the smallest node it reaches by them."""
    nodes, at = np.unique(np.concatenate([x, y]), return_inverse=True)
    a, b = np.split(at, 2)
    low = np.arange(len(nodes))
    while True:
        best = np.minimum(low[a], low[b])
        new = low.copy()
        for end in (a, b):
            np.minimum.at(new, low[end], best)  # what a label leads to learns the better label
            np.minimum.at(new, end, best)
        new = new[new]
        if (new == low).all():
            return nodes, nodes[low]
        low = new


def _star_tables(chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def star() -> pa.RecordBatch:
            nodes, low = _stars(*(np.concatenate([h.column(i).to_numpy() for h in held]) for i in (0, 1)))
            return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(low)], names=["node", "low"])

        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= chunk:
                yield star()
                held, n = [], 0
        if n:
            yield star()

    return run


def near_components(pairs: DataFrame, a: str = "a", b: str = "b", chunk: int = CHUNK) -> DataFrame:
    """``components`` of whole-numbered nodes, most of whose links lead to near numbers.

    Links are dealt out in ranges of their smaller ends.  A task gives each node of ``chunk`` links the
    smallest node that they reach; only such nodes as several chunks saw differently link what is left,
    and go through the rounds.  Any links give right results; far ones only leave more to the rounds.
    """
    one = pairs.select(F.least(a, b).cast("long").alias("x"), F.greatest(a, b).cast("long").alias("y")).where("x <> y")
    tasks = tasks_for(one.sparkSession, one.count())
    stars = materialize(one.repartitionByRange(tasks, "x", "y").mapInArrow(_star_tables(chunk), "node long, low long"), "stars")
    found = materialize(stars.groupBy("node").agg(F.min("low").alias("low"), F.max("low").alias("high")), "lows")
    torn = found.where("low < high").select("node", F.col("low").alias("to"))
    if torn.isEmpty():
        return found.select("node", F.col("low").alias("comp"))
    rest = components(materialize(stars.join(torn, "node").where("low > to").select("to", "low").distinct(), "torn"), "to", "low")
    rest = rest.select(F.col("node").alias("low"), "comp")
    out = salted_join(found, rest, "low", "node", hot_keys(found, "low"), "left")
    return out.select("node", F.coalesce("comp", "low").alias("comp"))


def membership(groups: DataFrame) -> DataFrame:
    return groups.select(F.explode("members").alias("member"), F.col("id").alias("community"))


def surprises(edges: DataFrame, member_of: DataFrame, hubs: DataFrame, language_of: DataFrame, top: int = 10) -> DataFrame:
    """src, dst, score, reasons of calls between unlike symbols.

    member_of(member, community), hubs(member), language_of(member, language).
    """
    calls = edges.where("kind = 'CALLS' AND src LIKE 'sym:%' AND dst LIKE 'sym:%'")
    calls = calls.select(bare("src").alias("src"), bare("dst").alias("dst")).where("src <> dst")
    for end in ("src", "dst"):
        calls = calls.join(member_of.select(F.col("member").alias(end), F.col("community").alias(f"{end}_c")), end, "left")
        calls = calls.join(language_of.select(F.col("member").alias(end), F.col("language").alias(f"{end}_l")), end, "left")
        calls = calls.join(hubs.select(F.col("member").alias(end), F.lit(True).alias(f"{end}_h")), end, "left")
    tests = [
        (F.col("src_c") != F.col("dst_c"), 3, "cross-community"),
        (F.col("src_l") != F.col("dst_l"), 2, "cross-language"),
        (F.col("src_h").isNotNull() != F.col("dst_h").isNotNull(), 2, "hub-periphery"),
    ]
    score = sum((F.when(t, n).otherwise(0) for t, n, _ in tests), F.lit(0))
    reasons = F.array_compact(F.array(*[F.when(t, r) for t, _, r in tests]))
    found = calls.select("src", "dst", score.alias("score"), reasons.alias("reasons")).where("score > 0")
    return found.orderBy(F.desc("score"), utf16_key("src"), utf16_key("dst")).limit(top)
