"""Nearest neighbours by a forest of random-projection trees.

Trees, and the centres of their leaves, are fitted on a bounded sample: a node projects its rows on
the direction between the centres that a few Lloyd steps reach from two random rows, and splits at
their middle (at the median if that would leave under a twentieth on a side).  Every row is then
routed to one leaf of each tree.  A query keeps one priority queue over the nodes of all trees,
ordered by the largest inner product with the centre of a leaf below the node, and takes leaves
from it until they hold a share of all rows and ``SPARE`` more in sum.  Leaf candidates are ranked by
their exact inner product.

The share is measured, not set: for ``PROBES`` rows of the sample the true neighbours in the sample
are known, and so is what the queue reads until it meets each of them.  The share is what finds
``TARGET`` of them.  Grouped vectors so read a small part of the rows, vectors without structure a
large one.  In a larger table the neighbours lie nearer than in its sample, so the share is no less
than needed there.

Equal vectors are one class with its smallest ids, so copies of one vector do not fill a leaf.
Neighbouring leaves of a tree form bundles; a vector is sent once to each bundle that it has a leaf
in, and large bundles, or those of many queries, are cut into blocks of bounded size.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import materialize

TREES = 8
LEAF = 12  # most sample rows of a leaf
FIT = 8192  # most rows that the trees are fitted on
SAMPLE, SAMPLE_BYTES = 65536, 32 << 20  # most rows that the leaves' centres come from, and their bytes
SHARE, SPARE = None, 200  # leaves are taken until they hold share * rows + SPARE rows, repeats included; None: measured
PROBES, NEIGHBOURS, TARGET = 256, 20, 0.95  # rows the share is measured with, their neighbours, part of them to be found
FIRST = 24  # leaves that give a query its first bound
BUNDLES = 16  # of a tree at least
ROW_BLOCK, QUERY_BLOCK = 4096, 1024


class Forest:
    """Trees as arrays: direction, threshold, the two children, the leaves' centres, the root.

    A leaf is its number, counted from left to right, below 0: ``-1 - number``.
    """

    def __init__(self, sample: np.ndarray, rows: int, trees: int = TREES, seed: int = 5):
        self.dim = sample.shape[1] if sample.size else 0
        self.trees = [self._tree(sample[:FIT], np.random.default_rng(seed + t)) for t in range(trees)]
        placed = [self.route(sample, t) for t in range(trees)]
        self.trees = [(*tree[:3], self._centres(sample, at, len(tree[3])), tree[4]) for at, tree in zip(placed, self.trees, strict=True)]
        self.share = self._needed(sample, placed) / max(1, len(sample))
        blocks = max(BUNDLES, -(-rows // ROW_BLOCK))
        self.bundles = [min(self.leaves(t), blocks) for t in range(trees)]

    @staticmethod
    def _centres(sample: np.ndarray, at: np.ndarray, leaves: int) -> np.ndarray:
        total = np.zeros((leaves, sample.shape[1]))
        np.add.at(total, at, sample)
        return total / np.maximum(1, np.bincount(at, minlength=leaves))[:, None]

    def _needed(self, sample: np.ndarray, placed: list[np.ndarray]) -> int:
        """Rows that leaves hold, in the queue's order, before ``TARGET`` of the probes' neighbours are met."""
        sizes = np.concatenate([np.bincount(at, minlength=len(tree[3])) for at, tree in zip(placed, self.trees, strict=True)])
        first = np.cumsum([0, *(len(tree[3]) for tree in self.trees)])[:-1]
        leaf_of = np.stack(placed, axis=1) + first
        centres, k, needs = np.concatenate([tree[3] for tree in self.trees]), min(NEIGHBOURS, len(sample) - 1), []
        for i in range(0, min(PROBES, len(sample)) if k > 0 else 0, 64):
            probes = np.arange(i, min(i + 64, PROBES, len(sample)))
            scores = sample[probes] @ sample.T
            scores[np.arange(len(probes)), probes] = -np.inf  # not its own neighbour
            near = np.argpartition(scores, scores.shape[1] - k, axis=1)[:, -k:]
            order = np.argsort(-(sample[probes] @ centres.T), axis=1, kind="stable")
            held = sizes[order]
            before = np.empty_like(held)
            np.put_along_axis(before, order, held.cumsum(axis=1) - held, axis=1)
            needs.append(np.stack([before[j][leaf_of[n]].min(axis=1) for j, n in enumerate(near)]))
        return int(np.quantile(np.concatenate(needs), TARGET, method="higher")) + 1 if needs else 1

    def leaves(self, t: int) -> int:
        return len(self.trees[t][3])

    def bundle(self, t: int, leaf: np.ndarray) -> np.ndarray:
        return leaf * self.bundles[t] // max(1, self.leaves(t))

    @staticmethod
    def _direction(x: np.ndarray, rng) -> tuple[np.ndarray, float]:
        a, b = x[rng.choice(len(x), 2, replace=False)]
        some = x[rng.choice(len(x), min(len(x), 256), replace=False)]
        for _ in range(4):
            side = some @ (a - b) > (a @ a - b @ b) / 2
            if side.all() or not side.any():
                break
            a, b = some[side].mean(0), some[~side].mean(0)
        d = a - b
        n = np.linalg.norm(d)
        if n == 0:
            d = rng.normal(size=x.shape[1])
            n = np.linalg.norm(d)
        d = d / n
        p = x @ d
        t = float((a @ d + b @ d) / 2)
        share = (p < t).mean()
        return d, t if 0.05 < share < 0.95 else float(np.median(p))

    def _tree(self, x: np.ndarray, rng):
        dirs, cuts, kids, leaf = [], [], [], []
        todo = [(np.arange(len(x)), -1, 0)]
        root = None
        while todo:
            at, up, side = todo.pop()
            low = None
            if len(at) > LEAF:
                d, t = self._direction(x[at], rng)
                low = x[at] @ d < t
                if low.all() or not low.any():
                    low = None
            if low is None:
                leaf.append(x[at].mean(0) if len(at) else np.zeros(self.dim))
                me = -len(leaf)
            else:
                me = len(dirs)
                dirs.append(d)
                cuts.append(t)
                kids.append([0, 0])
                todo += [(at[~low], me, 1), (at[low], me, 0)]  # the left one is taken first
            if up < 0:
                root = me
            else:
                kids[up][side] = me
        dirs, leaf = (np.array(a, np.float64).reshape(len(a), self.dim) for a in (dirs, leaf))
        return dirs, np.array(cuts), np.array(kids, int).reshape(-1, 2), leaf, root

    def route(self, x: np.ndarray, t: int) -> np.ndarray:
        """Leaf of each row in tree ``t``."""
        dirs, cuts, kids, _, root = self.trees[t]
        at = np.full(len(x), root)
        while (live := np.flatnonzero(at >= 0)).size:
            for n in np.unique(at[live]):
                own = live[at[live] == n]
                at[own] = kids[n, (x[own] @ dirs[n] >= cuts[n]).astype(int)]
        return -at - 1

    @staticmethod
    def _promise(vectors: np.ndarray, tree) -> np.ndarray:
        """Per vector and node: the inner product with a leaf's centre, the best of its leaves for a node.

        The columns are the inner nodes, then the leaves from the last to the first, so that a leaf's
        number below 0 is its place as well.
        """
        kids, inner = tree[2], len(tree[2])
        out = np.empty((inner + len(tree[3]), len(vectors)))
        out[inner:] = tree[3][::-1] @ vectors.T
        for n in range(inner - 1, -1, -1):  # children come after their parents
            np.maximum(out[kids[n, 0]], out[kids[n, 1]], out=out[n])
        return out.T

    def visit(self, vectors: np.ndarray, sizes: list[list[int]], search: float) -> Iterator[list[tuple[int, int]]]:
        """For each vector the (tree, leaf) pairs in the order of one queue over all trees."""
        best = [self._promise(vectors, tree) for tree in self.trees]
        kids = [tree[2].tolist() for tree in self.trees]
        for i in range(len(vectors)):
            near = [b[i].tolist() for b in best]
            heap = [(-near[t][tree[4]], t, tree[4]) for t, tree in enumerate(self.trees)]
            heapq.heapify(heap)
            got, total = [], 0
            while heap and total < search:
                _, t, n = heapq.heappop(heap)
                score, two = near[t], kids[t]
                while n >= 0:
                    a, b = two[n]
                    if score[a] < score[b]:
                        a, b = b, a
                    heapq.heappush(heap, (-score[b], t, b))
                    n = a
                if held := sizes[t][-n - 1]:
                    got.append((t, -n - 1))
                    total += held
            yield got


def _matrix(col: pa.Array) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    if not len(col):
        return np.zeros((0, 0))
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1)


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products, summed from the first component on in double precision."""
    return np.cumsum(a * b, axis=1)[:, -1] if a.size else np.zeros(len(a))


_FOUND = pa.schema([("query", pa.int64()), ("cand", pa.int64()), ("score", pa.float64())])


def _rank_block(keep: int):
    """One block of rows of a bundle against one block of queries: each query's best in its leaves."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _FOUND.empty_table()
        right = right.sort_by("leaf")
        q, x = _matrix(left["vec"]), _matrix(right["vec"])
        leaf = right["leaf"].to_numpy()
        visits = left["leaves"].combine_chunks()
        wanted, who = visits.flatten().to_numpy(), np.repeat(np.arange(len(q)), visits.value_lengths().to_numpy())
        rough = np.full((len(q), len(x)), -np.inf)
        for n in np.unique(leaf):
            a, b = np.searchsorted(leaf, [n, n + 1])
            own = who[wanted == n]
            rough[own, a:b] = q[own] @ x[a:b].T
        least = left["floor"].to_numpy()
        if len(x) > keep:
            least = np.maximum(least, np.partition(rough, len(x) - keep, axis=1)[:, len(x) - keep])
        # the rough products may differ from the exact ones by rounding
        spare = 1e-14 * q.shape[1] * np.linalg.norm(q, axis=1) * np.linalg.norm(x, axis=1).max()
        at, cand = np.nonzero((rough >= (least - spare)[:, None]) & (rough > -np.inf))
        parts = range(0, len(at), 1 << 16)
        score = np.concatenate([np.zeros(0), *(exact_scores(q[at[i : i + (1 << 16)]], x[cand[i : i + (1 << 16)]]) for i in parts)])
        named = right["cand"].to_numpy()[cand]
        order = np.lexsort((named, -score, at))  # ties by the smaller class
        first = np.searchsorted(at[order], at[order])
        order = order[np.arange(len(order)) - first < keep]
        return pa.table([left["query"].to_numpy()[at[order]], named[order], score[order]], schema=_FOUND)

    return run


def usable(table: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id, vec of the rows that take part; vec keeps single precision where it has it."""
    kind = "array<float>" if table.schema[vec_col].dataType == T.ArrayType(T.FloatType()) else "array<double>"
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast(kind).alias("vec"))
    rows = rows.where("vec_id IS NOT NULL AND vec IS NOT NULL AND size(vec) > 0")
    bad = F.exists("vec", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return rows.where(~F.coalesce(bad, F.lit(True)) & F.exists("vec", lambda v: v != 0))


def _sample(classes: DataFrame, total: int, most: int) -> np.ndarray:
    """About ``most`` rows of ``total`` (never a tenth more) by a hash of their id, in its order."""
    u = F.shiftrightunsigned(F.xxhash64("cand", F.lit(11)), 11) / F.lit(float(1 << 53))
    got = classes.select("cand", "vec", u.alias("u")).where(F.col("u") < min(1.0, most / max(1, total)))
    got = got.limit(most + most // 10).toArrow().sort_by([("u", "ascending"), ("cand", "ascending")])
    return _matrix(got["vec"])


def nearest(
    table: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vec_col: str = "embedding",
    share: float | None = SHARE, spare: int = SPARE,
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found for every row whose id ``every`` divides.

    Nearness is the inner product.  A row is not its own neighbour (rows with the query's id).
    Ties go to the smaller id.  Null, zero and non-finite vectors, null ids, and vectors whose
    length is not the commonest one (of equally common the smaller) take no part.  Repeated rows
    count once.  An empty table gives no rows.  ``share`` is the part of the rows that a query reads
    (repeats over trees included); None takes the one that the forest measured on its sample.  Reaches
    the driver: the sample, and one size for each leaf, both of fixed bounds.
    """
    spark = table.sparkSession
    rows = usable(table, id_col, vec_col)
    kind = rows.schema["vec"].dataType.simpleString()
    dims = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    dim = dims[0]["n"] if dims else 1
    rows = rows.where(F.size("vec") == dim)
    low = Window.partitionBy("vec").orderBy("vec_id")
    ids = rows.distinct().withColumn("__g_n", F.row_number().over(low)).where(F.col("__g_n") <= k + 1)
    classes = ids.groupBy("vec").agg(F.min("vec_id").alias("cand"), F.sort_array(F.collect_list("vec_id")).alias("ids"))
    classes = materialize(classes, "classes")
    total = classes.count()
    forest = Forest(_sample(classes, total, max(2, min(SAMPLE, SAMPLE_BYTES // (8 * dim)))), total)
    shared = spark.sparkContext.broadcast(forest)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(1))
                leaves = np.stack([own.route(x, t) for t in range(len(own.trees))], axis=1).astype(np.int32)
                leaves = pa.ListArray.from_arrays(np.arange(0, leaves.size + 1, leaves.shape[1], dtype=np.int32), leaves.reshape(-1))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), leaves], names=["cand", "vec", "leaves"])

    index = materialize(classes.select("cand", "vec").mapInArrow(route, f"cand long, vec {kind}, leaves array<int>"), "index")
    counted = index.select(F.posexplode("leaves").alias("tree", "leaf")).groupBy("tree", "leaf").count().collect()
    sizes = [[0] * forest.leaves(t) for t in range(len(forest.trees))]
    for r in counted:
        sizes[r["tree"]][r["leaf"]] = r["count"]
    search = (forest.share if share is None else share) * total + spare

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A query's leaves by (phase, tree, bundle)."""
        own = shared.value
        kinds = pa.list_(pa.struct([("phase", pa.int32()), ("tree", pa.int32()), ("bundle", pa.int32()), ("leaves", pa.list_(pa.int32()))]))
        for batch in batches:
            if not batch.num_rows:
                continue
            out = []
            for got in own.visit(_matrix(batch.column(1)), sizes, search):
                by: dict[tuple[int, int, int], list[int]] = {}
                for turn, (t, leaf) in enumerate(got):
                    by.setdefault((int(turn >= FIRST), t, int(own.bundle(t, leaf))), []).append(leaf)
                out.append([{"phase": p, "tree": t, "bundle": b, "leaves": x} for (p, t, b), x in by.items()])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, kinds)], names=["query", "vec", "visits"])

    asked = rows.where(F.col("vec_id") % every == 0).distinct().join(classes.select("vec", "cand"), "vec").select("vec_id", "cand")
    asked = materialize(asked, "asked")
    queries = index.select("cand", "vec").join(asked.select("cand").distinct(), "cand", "left_semi")
    visited = "array<struct<phase:int,tree:int,bundle:int,leaves:array<int>>>"
    routed = materialize(queries.mapInArrow(visits, f"query long, vec {kind}, visits {visited}"), "visits")
    routed = routed.select("query", "vec", F.explode("visits").alias("v")).select("query", "vec", "v.*")
    held = index.select("cand", "vec", F.posexplode("leaves").alias("tree", "leaf"))
    parts = F.lit([[b, forest.leaves(t)] for t, b in enumerate(forest.bundles)])
    part = F.element_at(parts, F.col("tree") + 1)
    held = held.withColumn("bundle", F.floor(F.col("leaf") * part[0] / part[1]).cast("int"))
    row_blocks = held.groupBy("tree", "bundle").agg(F.ceil(F.count(F.lit(1)) / ROW_BLOCK).cast("long").alias("xb"))

    def ranked(asking: DataFrame) -> DataFrame:
        """Group keys bound both sides: a block of rows and a block of queries of one bundle."""
        query_blocks = asking.groupBy("tree", "bundle").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("long").alias("qb"))
        cut = row_blocks.join(query_blocks, ["tree", "bundle"])
        each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        left = asking.join(cut, ["tree", "bundle"]).withColumn("j", F.pmod(F.xxhash64("query"), "qb")).withColumn("i", each("xb"))
        right = held.join(cut, ["tree", "bundle"]).withColumn("i", F.pmod(F.xxhash64("cand"), "xb")).withColumn("j", each("qb"))
        keys = ["tree", "bundle", "i", "j"]
        left = left.select(*keys, "query", "vec", "leaves", "floor").groupBy(*keys)
        return left.cogroup(right.select(*keys, "cand", "vec", "leaf").groupBy(*keys)).applyInArrow(_rank_block(k + 1), "query long, cand long, score double")

    order = Window.partitionBy("query").orderBy(F.desc("score"), "cand")
    first = ranked(routed.where("phase = 0").withColumn("floor", F.lit(float("-inf")))).distinct()
    first = materialize(first.withColumn("__g_n", F.row_number().over(order)).where(F.col("__g_n") <= k + 1), "first")
    floor = first.groupBy("query").agg(F.when(F.max("__g_n") == k + 1, F.min("score")).otherwise(float("-inf")).alias("floor"))
    rest = ranked(routed.where("phase = 1").join(floor, "query"))
    found = first.select("query", "cand", "score").union(rest).distinct()
    found = found.withColumn("__g_n", F.row_number().over(order)).where(F.col("__g_n") <= k + 1).drop("__g_n")
    each = found.join(classes.select("cand", F.explode("ids").alias("vec_id")), "cand")
    by_id = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    each = each.withColumn("__g_n", F.row_number().over(by_id)).where(F.col("__g_n") <= k + 1).drop("__g_n", "cand")
    out = each.join(asked.select(F.col("cand").alias("query"), F.col("vec_id").alias("query_id")), "query").where("vec_id <> query_id")
    by_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = out.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", "score")
