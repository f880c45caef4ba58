"""Communities of symbols: components that are cut at their weakest links, without expanding file pairs.

A call links two symbols with weight 1, an import every symbol of one file with every symbol of the
other with weight 0.5.  A component that is too large, or large and loose, loses its weakest pair, in
the order of (weight, smaller symbol, larger symbol), until it falls apart; so do the parts.

That order is total, so the parts are clusters of a maximum spanning forest: a cluster falls apart at
its weakest forest link, and the pairs that are weaker than this link are gone from both parts.

*Imports stay file pairs.*  Symbols are numbered in their order.  For a file G let M be the largest
symbol of any file it has an import with.  The forest needs only (b, M) of each symbol b of G, and
(max F, max G) of each import: any other pair (x, y) of the import is the weakest on a way that leads
over x's or y's link to such an M and the largest symbols of the two files.  So links grow with
symbols plus imports.  The pairs that a cluster still has are counted from positions in files: x has
as many pairs to larger symbols as there are larger symbols in its files' partners.

*Whole components first.*  A component that is neither too large nor loose is a cluster as it is, by its
counts; only the links of others are folded.

*No task sees a large component.*  Its links are cut into ranges of ``BOUND`` in their order.  A round
folds one range of every large component; what a range has joined is one vertex of the next, with
its number of symbols and pairs.  Components of less than ``BOUND`` links are folded at once, many in
a task.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import utf16_key
from ..scratch import drop, materialize
from .graph import bare, near_components
from .rank import ranked
from .skew import LEAST, salted_join
from .skew import SHARE as HOT

LARGE, LOOSE, SHARE = 20, 0.1, 4
BOUND = 1 << 20
TASK_ROWS = 20_000
CALL, IMPORT = 1, 0  # strengths: a call is stronger than any import


def file_partners(edges: DataFrame, member: DataFrame) -> DataFrame:
    """f, g: both directions of each import between files that hold symbols; member(f, s)."""
    own = member.select("f").distinct()
    one = edges.where("kind = 'IMPORTS'").select(F.col("src").alias("f"), F.col("dst").alias("g"))
    one = one.join(own, "f", "left_semi").join(own.withColumnRenamed("f", "g"), "g", "left_semi")
    return one.select("f", "g").union(one.select(F.col("g"), F.col("f"))).distinct()


def forest_links(calls: DataFrame, member: DataFrame, partners: DataFrame) -> DataFrame:
    """w, a, b: links that hold a maximum spanning forest of all pairs; a < b.

    calls(a, b), member(f, s), partners(f, g).  As many rows as calls, symbols and imports.
    """
    top = member.groupBy("f").agg(F.max("s").alias("top"))
    of_g = partners.join(top.select(F.col("f").alias("g"), F.col("top").alias("far")), "g")
    best = of_g.groupBy("f").agg(F.max("far").alias("y"))
    up = member.join(best, "f").select(F.col("s").alias("x"), "y")
    tops = of_g.join(top, "f").where("top < far").select(F.col("top").alias("x"), F.col("far").alias("y"))
    ends = up.union(tops).where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    return calls.select(F.lit(CALL).alias("w"), "a", "b").union(ends.select(F.lit(IMPORT).alias("w"), "a", "b"))


def import_calls(calls: DataFrame, member: DataFrame, partners: DataFrame) -> DataFrame:
    """a, b of the calls that an import links too."""
    at = calls.join(member.select(F.col("s").alias("a"), "f"), "a").join(member.select(F.col("s").alias("b"), F.col("f").alias("g")), "b")
    return at.join(partners, ["f", "g"], "left_semi").select("a", "b")


def pairs_above(member: DataFrame, partners: DataFrame, both: DataFrame) -> DataFrame:
    """s, above: how many larger symbols an import, and no call, links a symbol with.

    One row for each symbol and partner of its file; each file pair is counted in one window.
    """
    asks = partners.join(member, "f").select("f", "g", "s", F.lit(0).alias("has"))
    has = partners.join(member.withColumnRenamed("f", "g"), "g").select("f", "g", "s", F.lit(1).alias("has"))
    larger = Window.partitionBy("f", "g").orderBy(F.desc("s"), "has").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = asks.union(has).withColumn("n", F.sum("has").over(larger)).where("has = 0").select("s", "n")
    less = both.select(F.col("a").alias("s"), F.lit(-1).cast("long").alias("n"))
    return counted.union(less).groupBy("s").agg(F.sum("n").alias("above"))


def pairs_beyond(member: DataFrame, partners: DataFrame, both: DataFrame) -> DataFrame:
    """a, b, beyond: for the largest symbol a of each file and every larger b it has an import with,
    the pairs of a, not calls, with symbols larger than b.  Other symbols' forest links have none."""
    top = member.groupBy("f").agg(F.max("s").alias("a"))
    far = partners.join(top, "f").join(member.select(F.col("f").alias("g"), F.col("s").alias("b")), "g").where("a < b").select("a", "b")
    far = far.join(both.withColumn("_c", F.lit(0)), ["a", "b"], "left").select("a", "b", F.coalesce("_c", F.lit(1)).alias("n"))
    larger = Window.partitionBy("a").orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, -1)
    return far.select("a", "b", F.coalesce(F.sum("n").over(larger), F.lit(0)).alias("beyond"))


_FOLDED = "kind string, x long, y long, cluster string, n long, m long"


class _Fold:
    """Kruskal's fold over links from the strongest, with the clusters that are kept on the way."""

    def __init__(self, limit: int):
        self.limit = limit
        self.up: dict[int, int] = {}
        self.state: dict[int, list] = {}  # of a root: dendrogram node, symbols, pairs
        self.parent: dict[int, int] = {}  # of dendrogram nodes, by their place
        self.kept: dict[int, tuple[str, int, int]] = {}
        self.names: list[str] = []
        self.first: dict[int, int] = {}  # the node a vertex came with

    def add(self, x: int, name: str, n: int, m: int) -> None:
        if x not in self.up:
            self.up[x] = x
            self.first[x] = len(self.names)
            self.state[x] = [len(self.names), n, m]
            self.names.append(name)

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def judge(self, root: int, more: int = 0) -> None:
        """Whether the cluster is kept, now that the link at which it would be joined is known."""
        node, n, m = self.state[root]
        m += more
        if n <= self.limit and (n <= LARGE or m / (n * (n - 1) / 2) >= LOOSE):
            self.kept[node] = (self.names[node], n, m)

    def link(self, u: int, v: int, name: str, beyond: int) -> None:
        a, b = self.root(u), self.root(v)
        if a == b:
            return
        self.judge(a, beyond)
        self.judge(b)
        x, y = self.state[a], self.state[b]
        node = len(self.names)
        self.names.append(name)
        self.parent[x[0]] = self.parent[y[0]] = node
        if x[1] < y[1]:
            a, b = b, a
        self.up[b] = a
        self.state[a] = [node, x[1] + y[1], x[2] + y[2]]

    def tops(self) -> dict[int, int]:
        """For each node the highest kept one above it or itself, if any."""
        out: dict[int, int] = {}
        for node in range(len(self.names) - 1, -1, -1):  # parents have higher places
            above = out.get(self.parent[node]) if node in self.parent else None
            if above is not None:
                out[node] = above
            elif node in self.kept:
                out[node] = node
        return out


def _folder(limit: int, last: bool):
    """One table of links, of one component or of several small ones, strongest first."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("w", "descending"), ("a", "descending"), ("b", "descending")])
        f = _Fold(limit)
        cols = ["w", "a", "b", "u", "v", "add", "beyond", "u_name", "u_n", "u_m", "v_name", "v_n", "v_m"]
        for w, a, b, u, v, add, beyond, un, uc, um, vn, vc, vm in zip(*(table[c].to_pylist() for c in cols), strict=True):
            f.add(u, un, uc, um)
            f.add(v, vn, vc, vm)
            if u != v:
                f.link(u, v, f"{w}:{a}:{b}", beyond)
            f.state[f.root(u)][2] += add
        if last:
            for x in [x for x, y in f.up.items() if x == y]:
                f.judge(x)
        tops = f.tops()
        rows = [("vertex", x, f.root(x), f.kept[tops[p]][0] if p in tops else None, None, None) for x, p in f.first.items()]
        rows += [("cluster", None, None, name, n, m) for name, n, m in (f.kept[t] for t in set(tops.values()))]
        rows += [("root", x, None, f.names[f.state[x][0]], f.state[x][1], f.state[x][2]) for x, y in f.up.items() if x == y and not last]
        names = ["kind", "x", "y", "cluster", "n", "m"]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        return pa.table({c: pa.array([r[i] for r in rows], t) for i, (c, t) in enumerate(zip(names, kinds, strict=True))})

    return run


def _with_state(links: DataFrame, state: DataFrame | None) -> DataFrame:
    """Links with what each end has come to stand for: a name, symbols, pairs."""
    for end in ("u", "v"):
        if state is None:
            own = [F.col(end).cast("string").alias(f"{end}_name"), F.lit(1).cast("long").alias(f"{end}_n"), F.lit(0).cast("long").alias(f"{end}_m")]
            links = links.select("*", *own)
        else:
            of = state.select(F.col("x").alias(end), F.col("name").alias(f"{end}_name"), F.col("n").alias(f"{end}_n"), F.col("m").alias(f"{end}_m"))
            links = links.join(of, end, "left")
            links = links.withColumns({
                f"{end}_name": F.coalesce(f"{end}_name", F.col(end).cast("string")), f"{end}_n": F.coalesce(f"{end}_n", F.lit(1)),
                f"{end}_m": F.coalesce(f"{end}_m", F.lit(0)),
            })
    return links


def _is_kept(limit: int) -> Column:
    """Whether a cluster of n symbols and m pairs is small enough, and not large and loose."""
    n = F.col("n")
    return (n <= limit) & ((n <= LARGE) | (F.col("m") / (n * (n - 1) / 2) >= LOOSE))


def clusters(links: DataFrame, limit: int, bound: int = BOUND) -> DataFrame:
    """s, cluster, n, m: the cluster each vertex ends in, its vertices and its pairs.

    links(w, a, b, add, beyond): a <= b; ``add`` pairs count from this link on for the cluster of a
    (1 for a call; a row with b = -1 is no link and carries the pairs of a's imports), ``beyond``
    pairs count for a's side until this link.
    """
    links = links.select("w", "a", "b", F.col("a").alias("u"), F.when(F.col("b") < 0, F.col("a")).otherwise(F.col("b")).alias("v"), "add", "beyond")
    comp = materialize(near_components(links.where("b >= 0")), "link_components")
    links = materialize(links.join(comp.withColumnRenamed("node", "a"), "a"), "links")
    sizes = links.groupBy("comp").agg(F.count(F.lit(1)).alias("rows"), F.sum("add").alias("m"))
    sizes = sizes.join(comp.groupBy("comp").agg(F.count(F.lit(1)).alias("n")), "comp")
    sizes = materialize(sizes.withColumn("whole", _is_kept(limit)), "sizes")
    rows, cut = F.col("rows"), ~F.col("whole")
    total, few, most = sizes.agg(F.sum("rows"), F.sum(F.when(cut & (rows <= bound), rows)), F.max(F.when(cut, rows))).first()
    hot = [r[0] for r in sizes.where(rows > max((total or 0) / HOT, LEAST - 1)).select("comp").collect()]  # fewer than HOT
    kept = sizes.where("whole").select("comp", F.concat(F.lit("c"), "comp").alias("cluster"), "n", "m")
    whole = salted_join(comp, kept, "comp", "node", hot).select(F.col("node").alias("s"), "cluster", "n", "m")
    if most is None:
        return whole
    links = salted_join(links, sizes.where(cut).select("comp", "rows"), "comp", "a", hot)
    small = _with_state(links.where(rows <= bound).drop("rows"), None)
    small = small.withColumn("bucket", F.pmod(F.xxhash64("comp"), F.lit(max(1, (few or 0) // TASK_ROWS)))).drop("comp")
    done = materialize(small.groupBy("bucket").applyInArrow(_folder(limit, True), _FOLDED), "folded")
    placed = done.where("kind = 'vertex'").select(F.col("x").alias("s"), "cluster")
    found = done.where("kind = 'cluster'").select("cluster", "n", "m")
    if most > bound:
        more, large = _ranges(links.where(rows > bound), limit, bound, -(-most // bound))
        placed, found = placed.unionByName(more), found.unionByName(large)
    parts = placed.where("cluster IS NOT NULL").join(found, "cluster").select("s", "cluster", "n", "m")
    return whole.unionByName(parts)


def _ranges(links: DataFrame, limit: int, bound: int, rounds: int) -> tuple[DataFrame, DataFrame]:
    """Large components, range after range from the strongest link."""
    order = [F.asc("comp"), F.desc("w"), F.desc("a"), F.desc("b")]
    keyed = links.withColumn("key", F.struct("w", "a", "b"))
    place = ranked(keyed.select("key", "comp", "w", "a", "b"), "key", order, "place")
    keyed = keyed.join(place, "key").drop("key")
    start = keyed.groupBy("comp").agg(F.min("place").alias("start"))
    keyed = keyed.join(F.broadcast(start), "comp").withColumn("range", F.expr(f"(place - start) div {bound}")).drop("place", "start", "rows")
    keyed = materialize(keyed, "ranges")
    ends = F.explode(F.array("u", "v")).alias("s")
    at = materialize(keyed.select("comp", ends).distinct().select("comp", "s", F.col("s").alias("root"), F.lit(None).cast("string").alias("cluster")), "vertices")
    state, found = None, []
    for r in range(rounds):
        own = keyed.where(F.col("range") == r)
        for end in ("u", "v"):
            now = at.select(F.col("s").alias(end), F.col("root").alias("_r"))
            own = own.join(now, end).drop(end).withColumnRenamed("_r", end)
        folded = _with_state(own, state).groupBy("comp").applyInArrow(_folder(limit, False), _FOLDED)
        folded = materialize(folded, "folded")
        moved = folded.where("kind = 'vertex'").select(F.col("x").alias("root"), F.col("y").alias("_to"), F.col("cluster").alias("_c"))
        old = at
        at = at.join(moved, "root", "left")
        at = at.select("comp", "s", F.coalesce("_to", "root").alias("root"), F.coalesce("_c", "cluster").alias("cluster"))
        at = materialize(at, "vertices")
        drop(old)
        fresh = folded.where("kind = 'root'").select("x", F.col("cluster").alias("name"), "n", "m")
        if state is not None:
            fresh = state.join(folded.where("kind = 'vertex'").select("x"), "x", "left_anti").unionByName(fresh)
        state = materialize(fresh, "roots")
        found.append(folded.where("kind = 'cluster'").select("cluster", "n", "m"))
    whole = state.where(_is_kept(limit))
    at = at.join(whole.select(F.col("x").alias("root"), F.col("name").alias("_c")), "root", "left")
    kept = whole.select(F.col("name").alias("cluster"), "n", "m")
    for one in found:
        kept = kept.unionByName(one)
    return at.select("s", F.coalesce("_c", "cluster").alias("cluster")), kept


def symbol_links(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(numbered, links, symbols): id and s of each symbol in UTF-16 order, and the links between them.

    Each symbol is contained in one file.  Links are those ``clusters`` takes.
    """
    symbols = nodes.where("kind = 'symbol'").select("id").distinct()
    numbered = materialize(ranked(symbols, "id", [utf16_key("id"), F.asc("id")], "s"), "numbered")
    end = lambda c, n: numbered.select(F.col("id").alias(c), F.col("s").alias(n))
    calls = edges.where("kind = 'CALLS' AND src LIKE 'sym:%' AND dst LIKE 'sym:%' AND src <> dst").select("src", "dst")
    calls = calls.join(end("src", "x"), "src").join(end("dst", "y"), "dst")
    calls = materialize(calls.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "calls")
    holds = edges.where("kind = 'CONTAINS' AND dst LIKE 'sym:%'").groupBy("dst").agg(F.min("src").alias("f"))
    member = materialize(holds.join(end("dst", "s"), "dst").select("f", "s"), "member")
    partners = materialize(file_partners(edges, member), "partners")
    both = import_calls(calls, member, partners)
    links = forest_links(calls, member, partners).join(pairs_beyond(member, partners, both), ["a", "b"], "left")
    beyond = F.when(F.col("w") == IMPORT, F.coalesce("beyond", F.lit(0))).otherwise(0).alias("beyond")
    links = links.select("w", "a", "b", F.when(F.col("w") == CALL, 1).otherwise(0).cast("long").alias("add"), beyond)
    above = pairs_above(member, partners, both).where("above > 0")
    own = above.select(F.lit(IMPORT).alias("w"), F.col("s").alias("a"), F.lit(-1).cast("long").alias("b"), F.col("above").alias("add"), F.lit(0).cast("long").alias("beyond"))
    return numbered, materialize(links.unionByName(own), "forest_links"), numbered.count()


def communities(edges: DataFrame, nodes: DataFrame, bound: int = BOUND) -> DataFrame:
    """id, label, members, member_count, cohesion of groups of symbols that belong together.

    Parts of at most a quarter of the symbols that have 20 members at most, or a tenth of all their
    pairs.  label: the commonest directory, ties in UTF-16 order.  id: from the SHA-256 of the members,
    so a community's names are one row.  A graph without calls and imports has none.
    """
    numbered, links, total = symbol_links(edges, nodes)
    limit = max(2, -(-total // SHARE))
    at = clusters(links, limit, bound).where("n > 1").join(numbered, "s")
    at = materialize(at.select("cluster", "n", "m", "s", bare("id").alias("name")), "placed")
    file = F.split("name", "#")[0]
    folder = F.when(file.contains("/"), F.regexp_replace(file, "/[^/]*$", "")).otherwise(".").alias("dir")
    dirs = at.select("cluster", folder).groupBy("cluster", "dir").agg(F.count(F.lit(1)).alias("k"))
    label = dirs.groupBy("cluster").agg(F.min_by("dir", F.struct(-F.col("k"), utf16_key("dir"))).alias("label"))
    members = F.transform(F.array_sort(F.collect_list(F.struct("s", "name"))), lambda x: x["name"])
    out = at.groupBy("cluster").agg(members.alias("members"), F.first("n").alias("n"), F.first("m").alias("m")).join(label, "cluster")
    digest = F.sha2(F.array_join("members", "\n").cast("binary"), 256)
    cohesion = F.col("m") / (F.col("n") * (F.col("n") - 1) / 2)
    return out.select(
        F.concat(F.lit("c-"), F.substring(digest, 1, 8)).alias("id"), "label", "members", F.col("n").cast("int").alias("member_count"),
        F.round(cohesion, 4).alias("cohesion"),
    )
