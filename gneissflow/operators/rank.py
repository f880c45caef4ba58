"""Ranking, fusion, candidate lists and greedy packing."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as T
from ..scratch import materialize
from .graph import bare

RRF = 60


def text_score(terms: list[str], identifiers: list[str]) -> Column:
    """Points of a symbol row for the words and identifiers of a request."""
    name, qname, path = F.lower("name"), F.lower("qualified_name"), F.lower("path")
    context = F.lower(F.concat_ws(" ", F.coalesce("signature", F.lit("")), F.coalesce("jsdoc", F.lit(""))))
    score = F.when(F.col("exported"), 1).otherwise(0)
    for t in terms:
        for where, points in ((name, 3), (qname, 2), (path, 2), (context, 1)):
            score = score + F.when(where.contains(t), points).otherwise(0)
    for i in (x.lower() for x in identifiers):
        score = score + F.when((name == i) | qname.endswith(i), 15).otherwise(0)
    return score


def ranked(df: DataFrame, key: str, order: list[Column], as_: str) -> DataFrame:
    """key and its place (from 1) in one order over all rows.

    The order is cut into ranges, one for each task; a place is the place in the range and the number
    of rows in the ranges before it, so no task sees all rows.  Rows alike in ``order`` stay together.
    """
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    cut = materialize(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranked")
    sizes = cut.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # one row for each task
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    at = cut.withColumn("_place", place).join(F.broadcast(sizes), "_part")
    return at.select(key, (F.col("_place") + F.col("_before")).alias(as_))


def fuse(keys: DataFrame, key: str, lists: list[DataFrame]) -> DataFrame:
    """Reciprocal-rank fusion: keys with score, the sum over the lists in their order of 1/(60+rank)."""
    out, score = keys.select(key).distinct(), F.lit(0.0)
    for i, one in enumerate(lists):
        rank = next(c for c in one.columns if c != key)
        out = out.join(one.select(key, F.col(rank).alias(f"_r{i}")), key, "left")
        score = score + F.coalesce(1.0 / (F.lit(float(RRF)) + F.col(f"_r{i}")), F.lit(0.0))
    return out.select(key, score.alias("score"))


def _first_places(df: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """key, place of the first ``n`` rows; only they are sorted as a whole."""
    head = df.orderBy(*order).limit(n)
    return head.select(key, F.row_number().over(Window.orderBy(*order)).alias("place"))


def _places_of(df: DataFrame, key: str, points: str | None, wanted: DataFrame) -> DataFrame:
    """key, place of the wanted keys in the order of (points falling, key in UTF-16 order), without a sort.

    The wanted keys are bounded by the caller.  Each task counts how many rows lie between each two of
    them and passes on one number for each gap.
    """
    spark = df.sparkSession
    less = -F.col(points).cast("double") if points else F.lit(0.0)
    keyed = df.select(key, less.alias("p"), T.utf16_key(key).alias("u"))
    own = keyed.join(F.broadcast(wanted.select(key)), key, "left_semi").collect()
    cuts = sorted((r["p"], r["u"], r[key]) for r in own)
    sent = spark.sparkContext.broadcast([c[:2] for c in cuts])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gaps = [0] * (len(sent.value) + 1)
        for batch in batches:
            for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                gaps[bisect_right(sent.value, row)] += 1
        hit = [i for i, n in enumerate(gaps) if n]
        yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int64()), pa.array([gaps[i] for i in hit], pa.int64())], names=["gap", "n"])

    counted = keyed.select("p", "u").mapInArrow(count, "gap long, n long").groupBy("gap").agg(F.sum("n").alias("n")).collect()
    by = {r["gap"]: r["n"] for r in counted}
    before, places = 0, []
    for i, c in enumerate(cuts):
        before += by.get(i, 0)
        places.append((c[2], before + 1))
    sent.destroy()
    return spark.createDataFrame(places, f"{key} {dict(df.dtypes)[key]}, place long")


def fuse_top(key: str, lists: list[tuple[DataFrame, str | None]], k: int) -> DataFrame:
    """The ``k`` best keys of the first list by reciprocal-rank fusion, with score; no list is sorted as a whole.

    lists: (rows, column of points or None); a list is in the order of falling points, then of the key
    by UTF-16.  A key is in a list once.  The first n rows of each list are read.  A key that stands in none
    of them scores less than the sum of 1/(60+n+1) over the lists that go on; n grows until k keys reach
    that by the rows read alone.  n = lists * (60 + k) is enough once one list has k rows.  Of the keys read,
    those that may still be among the k get their places in the other lists by counting.
    """
    n = len(lists) * (RRF + k)
    orders = [[*([F.desc(p)] if p else []), T.utf16_key(key)] for _, p in lists]
    while True:
        heads = [materialize(_first_places(df, key, o, n), "head") for (df, _), o in zip(lists, orders, strict=True)]
        longer = [h.count() == n for h in heads]
        rest = 1.0 / (RRF + n + 1)
        each = heads[0].select(key, F.lit(0).alias("i"), "place")
        for i, h in enumerate(heads[1:], 1):
            each = each.union(h.select(key, F.lit(i), "place"))
        seen = each.groupBy(key).agg(*[F.max(F.when(F.col("i") == i, F.col("place"))).cast("long").alias(f"_p{i}") for i in range(len(lists))])
        part = lambda i: F.coalesce(1.0 / (F.lit(float(RRF)) + F.col(f"_p{i}")), F.lit(0.0))
        low = sum((part(i) for i in range(len(lists))), F.lit(0.0))
        more = sum((F.when(F.col(f"_p{i}").isNull(), rest).otherwise(0.0) for i in range(len(lists)) if longer[i]), F.lit(0.0))
        seen = materialize(seen.withColumns({"_low": low, "_high": low + more}), "seen")
        kth = seen.where("_p0 IS NOT NULL").orderBy(F.desc("_low")).limit(k).agg(F.min("_low").alias("low"), F.count(F.lit(1)).alias("n")).first()
        if not any(longer) or (kth["n"] == k and kth["low"] >= sum(longer) * rest):
            break
        n *= 4
    seen = seen if longer[0] else seen.where("_p0 IS NOT NULL")
    able = seen if kth["n"] < k else seen.where(F.col("_high") >= kth["low"] * (1 - 1e-12))
    able = materialize(able, "able")
    for i, (df, points) in enumerate(lists):
        if longer[i]:
            at = _places_of(df, key, points, able.where(F.col(f"_p{i}").isNull())).withColumnRenamed("place", "_at")
            able = able.join(F.broadcast(at), key, "left").withColumn(f"_p{i}", F.coalesce(f"_p{i}", "_at")).drop("_at")
    return able.where("_p0 IS NOT NULL").select(key, low.alias("score")).orderBy(F.desc("score"), T.utf16_key(key)).limit(k)


def symbol_lists(symbols: DataFrame, intent: str, edges: DataFrame, changed: DataFrame, gods: DataFrame) -> list[tuple[DataFrame, str | None]]:
    """The four ranked lists of symbols by qualified_name: words, hubs, changed, near; a name counts once."""
    terms, ids = T.terms_py(intent)
    once = symbols.withColumn("points", text_score(terms, ids)).groupBy("qualified_name").agg(F.max("points").alias("points"))
    near = import_neighbours(edges, changed, symbols)
    return [(once, "points"), (gods, "score"), (changed.select("qualified_name").distinct(), None), (near, None)]


def import_neighbours(edges: DataFrame, changed: DataFrame, symbols: DataFrame) -> DataFrame:
    """Symbols of the files that changed files import."""
    paths = changed.select(P.file_of("qualified_name").alias("p")).distinct()
    imports = edges.where("kind = 'IMPORTS' AND src LIKE 'file:%'").select(bare("src").alias("p"), bare("dst").alias("path"))
    near = imports.join(paths, "p", "left_semi").select("path").distinct()
    return symbols.join(near, "path", "left_semi").select("qualified_name").distinct()


def rank_symbols(symbols: DataFrame, intent: str, edges: DataFrame, changed: DataFrame, gods: DataFrame) -> DataFrame:
    """qualified_name, score in fused order; a name that stands twice counts once."""
    q = T.utf16_key("qualified_name")
    lists = symbol_lists(symbols, intent, edges, changed, gods)
    places = [ranked(df, "qualified_name", [*([F.desc(p)] if p else []), q], "r") for df, p in lists]
    return fuse(lists[0][0], "qualified_name", places).orderBy(F.desc("score"), q)


def top_symbols(symbols: DataFrame, intent: str, edges: DataFrame, changed: DataFrame, gods: DataFrame, k: int) -> DataFrame:
    """The first ``k`` rows of ``rank_symbols``."""
    lists = symbol_lists(symbols, intent, edges, changed, gods)
    return fuse_top("qualified_name", [(materialize(df, "ranked_list"), p) for df, p in lists], k)


def top_n(df: DataFrame, by: list[str], order: list[Column], n: int, as_: str = "rank") -> DataFrame:
    """The first ``n`` rows of each group."""
    return df.withColumn(as_, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(as_) <= n)


def fold_pack(left: int, items: Iterable[tuple[int, bool]]) -> Iterator[tuple[int, bool, int]]:
    """(used, included, what is left) of items (size, clipable) in their order."""
    for size, clipable in items:
        fits = left > 0 if clipable else size <= left
        used = min(size, left) if fits else 0
        left -= used
        yield used, fits, left


def _size_classes(cut: DataFrame) -> DataFrame:
    """part, class, n, total, least, most: items of each range by the power of two of their size; clipable
    items are class -1.  At most 64 rows for each range."""
    kind = F.when(F.col("clipable"), F.lit(-1)).otherwise(F.length(F.bin("size"))).alias("class")
    counts = [F.count(F.lit(1)).alias("n"), F.sum("size").alias("total"), F.min("size").alias("least"), F.max("size").alias("most")]
    return cut.groupBy("_part", kind).agg(*counts)


def _starts(cut: DataFrame, budget: int, order: list[str]) -> dict[int, tuple[int, int]]:
    """What is left, and the place, at the start of each range.

    What a range takes follows from its size classes where all that could fit does fit, or nothing can;
    only other ranges are read, one after the other, by a task that holds one number.
    """
    classes: dict[int, list] = {}
    for r in _size_classes(cut).collect():
        classes.setdefault(r["_part"], []).append(r)
    out, left, place = {}, budget, 0
    for part in sorted(classes):
        out[part] = left, place
        own = classes[part]
        place += sum(r["n"] for r in own)
        able = [r for r in own if (r["class"] == -1 and left > 0) or (r["class"] >= 0 and r["least"] <= left)]
        total = sum(r["total"] for r in able)
        if not able:
            continue
        if total < left and all(r["class"] == -1 or r["most"] <= left for r in able):
            left -= total
            continue
        rows = cut.where(F.col("_part") == part).where(F.col("clipable") | (F.col("size") <= left))  # larger ones never fit
        rows = rows.coalesce(1).sortWithinPartitions(*order).select("size", "clipable")

        def rest(batches: Iterator[pa.RecordBatch], now: int = left) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for _, _, now in fold_pack(now, zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                    pass
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64())], names=["left"])

        left = rows.mapInArrow(rest, "left long").first()["left"]
    return out


_PACKED = "ord long, id string, size long, used long, included boolean, clipped boolean"


def greedy_pack(items: DataFrame, budget: int, order: list[str], parts: int | None = None) -> DataFrame:
    """ord, id, size, used, included, clipped: items in order under a budget, skipping what does not fit.

    items(id, size, clipable, <order>); ``order`` is total, sizes are 0 or more.  An item that can be
    clipped takes what is left, if anything is; another fits whole or not at all.  The order is cut into
    ranges; once it is known what is left at the start of each, all ranges are folded at the same time.
    """
    parts = parts or max(int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    slim = items.select(F.col("id").cast("string").alias("id"), F.col("size").cast("long").alias("size"), "clipable", *[c for c in order if c != "id"])
    cut = materialize(slim.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "pack_ranges")
    starts = _starts(cut, budget, order)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, left, place = None, 0, 0
        for batch in batches:
            part, ids, sizes, clips = (batch.column(c).to_pylist() for c in range(4))
            used, fits, places = [], [], []
            for p, size, clip in zip(part, sizes, clips, strict=True):
                if p != at:
                    at, (left, place) = p, starts[p]
                u, f, left = next(fold_pack(left, [(size, clip)]))
                used.append(u)
                fits.append(f)
                places.append(place)
                place += 1
            clipped = [f and u < s for u, f, s in zip(used, fits, sizes, strict=True)]
            cols = [pa.array(places, pa.int64()), pa.array(ids, pa.string()), pa.array(sizes, pa.int64()), pa.array(used, pa.int64())]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(fits, pa.bool_()), pa.array(clipped, pa.bool_())], names=["ord", "id", "size", "used", "included", "clipped"])

    rows = cut.repartition(parts, "_part").sortWithinPartitions("_part", *order).select("_part", "id", "size", "clipable")
    return rows.mapInArrow(fold, _PACKED)


def packed_list(packed: DataFrame, most: int = 50) -> DataFrame:
    """id, kept: what a pack keeps, the first ``most`` of what it leaves out, and how many more there are."""
    left = packed.where("NOT included")
    shown = left.orderBy("ord").limit(most).select("id", F.lit(False).alias("kept"))
    more = left.agg((F.count(F.lit(1)) - most).alias("n")).where("n > 0")
    told = more.select(F.concat(F.lit("..."), F.col("n").cast("string"), F.lit(" more")).alias("id"), F.lit(False).alias("kept"))
    return packed.where("included").select("id", F.lit(True).alias("kept")).union(shown).union(told)
