"""Parts of a report as relations; the report takes its bounded heads from them.

files(path, language), symbols(path, pos, kind, name, qualified_name, exported), member_of(member, community).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions.text import utf16_key
from ..scratch import materialize
from .graph import bare, in_degree, test_gaps
from .rank import ranked, top_n

MEMBERS = ["method", "constructor"]
TOUR_LEAST, TOUR_MOST = 5, 12


def totals(files: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: files, symbols, edges."""
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return count(files, "files").crossJoin(count(symbols, "symbols")).crossJoin(count(edges, "edges"))  # one row each


def group_files(member_of: DataFrame, symbols: DataFrame, most: int = 5) -> DataFrame:
    """community, path, n, rank: the files that hold most members; a member without a file is in ``<unknown>``."""
    own = symbols.select(F.col("qualified_name").alias("member"), "path").distinct()
    rows = member_of.join(own, "member", "left").groupBy("community", F.coalesce("path", F.lit("<unknown>")).alias("path"))
    return top_n(rows.agg(F.count(F.lit(1)).alias("n")), ["community"], [F.desc("n"), utf16_key("path")], most)


def group_hubs(member_of: DataFrame, edges: DataFrame) -> DataFrame:
    """community, member, n: the member that most calls lead to, ties in UTF-16 order."""
    fan = in_degree(edges).where("dst LIKE 'sym:%'").select(bare("dst").alias("member"), "n")
    rows = member_of.join(fan.hint("merge"), "member", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    best = F.min_by(F.struct("member", "n"), F.struct(-F.col("n"), utf16_key("member"))).alias("b")
    return rows.groupBy("community").agg(best).select("community", "b.member", "b.n")


def fullest_files(files: DataFrame, symbols: DataFrame, most: int) -> DataFrame:
    """path, n, rank of the files with most symbols."""
    counted = files.select("path").join(symbols.groupBy("path").agg(F.count(F.lit(1)).alias("n")), "path", "left")
    head = counted.select("path", F.coalesce("n", F.lit(0)).alias("n")).orderBy(F.desc("n"), utf16_key("path")).limit(most)
    return top_n(head, [], [F.desc("n"), utf16_key("path")], most)  # of ``most`` rows


def outline_rows(files: DataFrame, symbols: DataFrame, most_files: int = 20, most: int = 30) -> DataFrame:
    """file_rank, path, rank, qualified_name, kind, exported: the first symbols, no members, of the fullest files."""
    top = fullest_files(files, symbols, most_files).withColumnRenamed("rank", "file_rank")
    inner = symbols.where(~F.col("kind").isin(MEMBERS)).join(F.broadcast(top), "path")  # ``most_files`` rows
    rows = top_n(inner, ["path"], [utf16_key("qualified_name"), F.col("pos")], most)
    return rows.select("file_rank", "path", "rank", "qualified_name", "kind", "exported")


def layer_counts(files: DataFrame) -> DataFrame:
    """layer, n."""
    return files.groupBy(P.layer("path").alias("layer")).agg(F.count(F.lit(1)).alias("n"))


def layer_nodes(files: DataFrame) -> DataFrame:
    """layer, nodes: the sorted file nodes of each layer, one array."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct(utf16_key("path").alias("u"), "path"))), lambda x: F.concat(F.lit("file:"), x["path"]))
    return files.groupBy(P.layer("path").alias("layer")).agg(listed.alias("nodes"))


def language_rows(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """language, files, dirs, symbols: files with and without symbols."""
    count = symbols.groupBy("path").agg(F.count(F.lit(1)).alias("s"))
    own = files.select("path", "language", P.top_dir("path").alias("d")).join(count, "path", "left")
    return own.groupBy("language").agg(F.count(F.lit(1)).alias("files"), F.countDistinct("d").alias("dirs"), F.coalesce(F.sum("s"), F.lit(0)).alias("symbols"))


def entry_ranking(files: DataFrame) -> DataFrame:
    """path, score, rank of the files that look like entries, best first."""
    scored = files.select("path", P.entry_score("path").alias("score")).where("score > 0")
    places = ranked(scored, "path", [F.desc("score"), utf16_key("path")], "rank")
    return scored.join(places, "path").select("path", "score", F.col("rank").cast("int").alias("rank"))


def skip_counts(contents: DataFrame, denied: DataFrame) -> DataFrame:
    """reason, n: files that were not read, and paths that the rules exclude (``denied``)."""
    own = contents.where("reason IS NOT NULL").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    return own.union(denied.groupBy(F.lit("denied").alias("reason")).agg(F.count(F.lit(1)).alias("n")))


def questions(gods: DataFrame, hits: DataFrame, edges: DataFrame, symbols: DataFrame, dead: DataFrame, sizes: DataFrame, member_of: DataFrame) -> DataFrame:
    """ord, text, node_id: up to five questions, each from the first row of one list.

    gods(qualified_name, score), hits(src, dst, score), dead(qualified_name), sizes(community, n).
    """
    def first(df: DataFrame, order: list, ord_: int, text, node) -> DataFrame:
        return df.orderBy(*order).limit(1).select(F.lit(ord_).alias("ord"), text.alias("text"), node.alias("node_id"))

    sym = lambda c: F.concat(F.lit("sym:"), c)
    told = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    q = F.col("qualified_name")
    big = sizes.orderBy(F.desc("n"), utf16_key("community")).limit(1).select("community")
    hub = group_hubs(member_of.join(F.broadcast(big), "community", "left_semi"), edges)  # one row
    rows = [
        first(gods, [F.desc("score"), utf16_key("qualified_name")], 1, told("What depends on ", q, "?"), sym(q)),
        first(hits, [F.desc("score"), utf16_key("src"), utf16_key("dst")], 2, told("Why does ", F.col("src"), " connect to ", F.col("dst"), "?"), sym(F.col("src"))),
        first(test_gaps(edges, symbols), [utf16_key("path")], 3, told("What tests cover ", F.col("path"), "?"), told("file:", F.col("path"))),
        first(dead, [utf16_key("qualified_name")], 4, told("Is ", q, " still needed?"), sym(q)),
        first(hub, [utf16_key("community")], 5, told("What is the role of community ", F.col("community"), "?"), sym(F.col("member"))),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out


def tour(edges: DataFrame, nodes: DataFrame, start: DataFrame, most: int | None = TOUR_MOST, least: int = TOUR_LEAST) -> DataFrame:
    """step (from 1), node_id: breadth-first reading order over imports and containment from the one row of
    ``start`` (column ``id``): at most ``most`` nodes (None: all it reaches), none at all under ``least``.

    A node comes after its first parent in the order, and in UTF-16 order among that parent's others.  A
    round joins the nodes of the last one with their steps and keeps the smallest parent of each new
    node; places are counted in ranges, or of the few rows that are left to take.
    """
    steps = edges.where(F.col("kind").isin("IMPORTS", "CONTAINS")).select("src", "dst")
    steps = materialize(steps.join(nodes.select(F.col("id").alias("dst")).distinct(), "dst", "left_semi").distinct(), "steps")
    first = start.join(nodes.select("id").distinct(), "id", "left_semi").select(F.lit(1).cast("long").alias("step"), F.col("id").alias("node_id"))
    seen = front = materialize(first, "tour")
    taken = seen.count()
    while taken and (most is None or taken < most):
        near = front.join(steps, F.col("node_id") == F.col("src")).groupBy("dst").agg(F.min("step").alias("parent"))
        near = near.join(seen.select(F.col("node_id").alias("dst")), "dst", "left_anti")
        order = [F.asc("parent"), utf16_key("dst")]
        if most is None:
            placed = ranked(near, "dst", order, "place")
        else:
            head = near.orderBy(*order).limit(most - taken)
            placed = head.select("dst", F.row_number().over(Window.orderBy(*order)).alias("place"))  # of at most ``most`` rows
        front = materialize(placed.select((F.col("place") + taken).cast("long").alias("step"), F.col("dst").alias("node_id")), "tour")
        more = front.count()
        if not more:
            break
        taken += more
        seen = seen.unionByName(front)
    return seen.select(F.col("step").cast("int").alias("step"), "node_id").where(F.lit(taken >= least))
