"""Benchmark decontamination by spaced seeds.

A seed looks at five tokens of a window, as a fixed mask says, so a changed token under a hole of the
mask does not hide a hit.  The masks are lossless: every way to match ``MIN_SHARE`` of 9 to 17 tokens
holds one of them whole.  A longer item falls into parts of 9 to 17 tokens, one of which matches to
that share, and so does a stretch that scores ``MIN_RUN``; none of them is missed.  An item of fewer
tokens has one seed, of all its tokens, and must match wholly.  The hashes of all windows of the test
items fill a Bloom filter, of bounded size whatever the items' number; one Arrow pass over the
training texts keeps the windows that pass it, an equi-join on the hash settles which are real, and
every (document, item, diagonal) with a hit is compared token by token.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import hot_keys, salted_join
from ..scratch import materialize
from .textcore import PUNCT, mix, word_hashes

MASKS = ("111011", "11001011", "101111", "111100001", "1100001011", "1001010101", "1000100111", "1010001101", "110111")
SPAN = 9  # fewest tokens of an item that may differ
WHOLE = tuple("1" * n for n in range(1, SPAN))  # masks of the shorter items, by length
BLOOM_LEAST, BLOOM_MOST = 20, 28  # logarithm of the filter's bits: 128 KiB to 32 MiB
BLOOM_SHARE = 128  # bits for a seed, as long as BLOOM_MOST allows; beyond it more windows pass and the join drops them
BLOOM_HASHES = 6  # at 128 bits for a seed one window in 10**8 passes by chance
MIN_SHARE = (7, 10)  # matched tokens of the item
MIN_RUN, MISS = 12, 3  # or a stretch scoring so much, a match 1 and a mismatch -MISS
_P = np.uint64(0x9E3779B97F4A7C15)


def masks_of(n: int) -> list[int]:
    """Numbers of the masks, in ``MASKS + WHOLE``, that an item of ``n`` tokens is looked for by."""
    return list(range(len(MASKS))) if n >= SPAN else [len(MASKS) + n - 1][: max(0, n)]


def seed_hashes(tokens: np.ndarray, mask: int) -> np.ndarray:
    """One hash for each window as long as the mask."""
    bits = (MASKS + WHOLE)[mask]
    n = len(tokens) - len(bits) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, np.uint64(mask + 1), np.uint64)
    for q in (i for i, c in enumerate(bits) if c == "1"):
        h = h * _P + tokens[q : q + n]
        h ^= h >> np.uint64(29)
    return mix(h)


def _token_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First column as it is; tokens; hash and position of every window of every mask."""
    for batch in batches:
        for i, h, offs in word_hashes(batch.column(1), PUNCT, True):
            toks, seeds, at = [], [], []
            for r in range(len(offs) - 1):
                t = h[offs[r] : offs[r + 1]]
                toks.append(t.view(np.int64))
                own = [seed_hashes(t, m) for m in masks_of(len(t))] or [np.zeros(0, np.uint64)]
                seeds.append(np.concatenate(own).view(np.int64))
                at.append(np.concatenate([np.arange(len(s)) for s in own]))
            n = len(toks)
            cols = [batch.column(0).slice(i, n), *(pa.array(x, pa.list_(pa.int64())) for x in (toks, seeds, at))]
            yield pa.RecordBatch.from_arrays(cols, names=["item_id", "tokens", "seeds", "at"])


def bloom_bits(seeds: int) -> int:
    """Logarithm of the filter's bits for so many seeds."""
    return min(BLOOM_MOST, max(BLOOM_LEAST, (seeds * BLOOM_SHARE - 1).bit_length()))


def _slots(h: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    step = (h >> np.uint64(32)) | np.uint64(1)
    for k in range(BLOOM_HASHES):
        yield (h + np.uint64(k) * step) & np.uint64((1 << bits) - 1)


def bloom_of(seeds: DataFrame, bits: int) -> np.ndarray:
    """The filter over column ``seed``: at most 2**bits bits reach the driver, never the seeds."""
    words = seeds.mapInArrow(_words_of(bits), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    bloom = np.zeros(1 << (bits - 6), np.uint64)
    got = words.toArrow()
    bloom[got["word"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return bloom


def _words_of(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(0).to_numpy().view(np.uint64)
            s = np.unique(np.concatenate(list(_slots(h, bits)))) if len(h) else np.zeros(0, np.uint64)
            word, first = np.unique(s >> np.uint64(6), return_index=True)
            own = np.bitwise_or.reduceat(np.uint64(1) << (s & np.uint64(63)), first) if len(s) else s
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(own.view(np.int64))], names=["word", "bits"])

    return run


def _passes(bloom: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Positions of the hashes that pass the filter."""
    at = np.arange(len(h))
    for slot in _slots(h, len(bloom).bit_length() + 5):
        s = slot[at]
        at = at[(bloom[(s >> np.uint64(6)).astype(np.int64)] >> (s & np.uint64(63))) & np.uint64(1) == 1]
        if not len(at):
            break
    return at


def _scanner(bloom, masks: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bloom.value
        for batch in batches:
            for i, h, offs in word_hashes(batch.column(2), PUNCT, True):
                # all windows of the run at once; those over a border of texts are dropped below
                pos, val, row = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
                for m in masks:
                    s = seed_hashes(h, m)
                    at = _passes(bits, s)
                    own = np.searchsorted(offs, at, "right") - 1
                    fits = at + len((MASKS + WHOLE)[m]) <= offs[own + 1]
                    at, own = at[fits], own[fits]
                    if m >= len(MASKS) and len(at):  # a whole item is alike everywhere: its first place in a text is the best
                        first = np.unique(np.stack([own, s[at].view(np.int64)]), axis=1, return_index=True)[1]
                        at, own = at[first], own[first]
                    pos.append(at)
                    val.append(s[at])
                    row.append(own)
                pos, val, row = np.concatenate(pos), np.concatenate(val), np.concatenate(row)
                for r in np.unique(row):
                    own = row == r
                    cols = [batch.column(0).slice(i + r, 1), batch.column(1).slice(i + r, 1)]
                    cols += [pa.array([x.view(np.int64)], pa.list_(pa.int64())) for x in (h[offs[r] : offs[r + 1]], val[own])]
                    cols += [pa.array([pos[own] - offs[r]], pa.list_(pa.int64()))]
                    yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "text_hash", "tokens", "hits", "at"])

    return run


def alike() -> Column:
    """Whether each token of ``item`` from its first inside the text on is that of ``tokens`` along ``diag``."""
    off = F.greatest(F.lit(0), -F.col("diag")).cast("int")
    tail = F.slice("tokens", (F.greatest(F.lit(0), F.col("diag")) + 1).cast("int"), F.size("item") - off)
    return F.zip_with(F.slice("item", off + 1, F.size("item")), tail, lambda x, y: F.coalesce(x == y, F.lit(False)))


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents that hold a test item: one row for each distinct (doc_id, text) and item.

    doc_id, text_hash, item_id, item_tokens, matched (tokens alike on the best diagonal), run (score
    of its best stretch), doc_start (token of the document under the item's first token; negative if
    the item begins before the text).  Tokens are runs of letters, digits and non-ASCII bytes; A-Z and
    the Latin-1 capitals are lower-cased, other letters stay as they are.  A hit counts if ``MIN_SHARE`` of the item's tokens match, or a stretch scores ``MIN_RUN``.
    Items of fewer than ``SPAN`` tokens count if all tokens match, at their first place in the text.
    Texts without a token give no rows.
    Items with the same tokens are compared once and all reported.  Other columns are not read.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    columns = "item_id long, tokens array<long>, seeds array<long>, at array<long>"
    items = items.mapInArrow(_token_rows, columns).where(F.size("seeds") > 0)
    items = materialize(items.withColumn("cls", F.sha2(F.array_join("tokens", ",").cast("binary"), 256)), "items")
    one = items.groupBy("cls").agg(F.first("tokens").alias("item"), F.first("seeds").alias("seeds"), F.first("at").alias("at"))
    classes = materialize(one, "item_classes")
    seeds = classes.select("cls", F.explode(F.arrays_zip("seeds", "at")).alias("s"))
    seeds = materialize(seeds.select("cls", F.col("s.seeds").alias("seed"), F.col("s.at").alias("item_at")), "seeds")
    bloom = spark.sparkContext.broadcast(bloom_of(seeds.select("seed").distinct(), bloom_bits(seeds.count())))
    sizes = classes.select(F.least(F.size("item"), F.lit(SPAN)).alias("n")).distinct().toArrow()["n"].to_pylist()  # SPAN rows at most
    masks = sorted({m for n in sizes for m in masks_of(n)})
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))
    columns = "doc_id long, text_hash long, tokens array<long>, hits array<long>, at array<long>"
    passed = materialize(src.mapInArrow(_scanner(bloom, masks), columns), "passed")
    hits = passed.select("doc_id", "text_hash", F.explode(F.arrays_zip("hits", "at")).alias("h"))
    hits = hits.select("doc_id", "text_hash", F.col("h.hits").alias("seed"), F.col("h.at").alias("at"))
    found = salted_join(hits, seeds.select("seed", "cls", "item_at"), "seed", "doc_id", hot_keys(hits, "seed"))
    found = found.select("doc_id", "text_hash", "cls", (F.col("at") - F.col("item_at")).alias("diag")).distinct()
    texts = passed.select(F.col("doc_id").alias("__g_id"), F.col("text_hash").alias("__g_th"), "tokens").dropDuplicates(["__g_id", "__g_th"])
    both = found.join(texts, F.col("doc_id").eqNullSafe(F.col("__g_id")) & (F.col("text_hash") == F.col("__g_th")))
    both = both.join(classes.select("cls", "item"), "cls")
    both = both.select("doc_id", "text_hash", "cls", "diag", F.size("item").alias("item_tokens"), alike().alias("same"))
    matched = F.size(F.filter("same", lambda s: s))
    state = F.struct(F.lit(0).alias("c"), F.lit(0).alias("b"))

    def grow(s, eq):
        c = F.greatest(F.lit(0), s["c"] + F.when(eq, 1).otherwise(-MISS))
        return F.struct(c.alias("c"), F.greatest(s["b"], c).alias("b"))

    run = F.aggregate("same", state, grow, lambda s: s["b"])
    both = both.select("doc_id", "text_hash", "cls", "diag", "item_tokens", matched.alias("matched"), run.alias("run"))
    both = both.where(f"matched * {MIN_SHARE[1]} >= item_tokens * {MIN_SHARE[0]} OR run >= {MIN_RUN}")
    most = F.max(F.struct("matched", "run", (-F.col("diag")).alias("d"), "item_tokens"))
    best = both.groupBy("doc_id", "text_hash", "cls").agg(most.alias("m"))
    named = best.join(items.select("cls", "item_id"), "cls")
    return named.select("doc_id", "text_hash", "item_id", "m.item_tokens", "m.matched", "m.run", (-F.col("m.d")).alias("doc_start"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a test item."""
    found = overlaps(docs, benchmark).select(F.col("doc_id").alias("__g_id"), F.col("text_hash").alias("__g_th")).distinct()
    found = materialize(found, "leaks")
    same = F.col("__g_id").eqNullSafe(F.col("doc_id").cast("long")) & (F.col("__g_th") == F.xxhash64("text"))
    return docs.join(found, same, "left_anti")


def oracle_sql() -> str:
    """DuckDB SQL of the query over ``documents`` and ``benchmark``, with the same masks."""
    masks = [(k, [i for i, c in enumerate(m) if c == "1"], len(m), SPAN, 1 << 30) for k, m in enumerate(MASKS)]
    masks += [(len(MASKS) + n, list(range(n)), n, n, n) for n in range(1, SPAN)]
    rows = ", ".join(f"({k}, {o}, {n}, {lo}, {hi})" for k, o, n, lo, hi in masks)
    word = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
    toks = f"lower(regexp_extract_all(coalesce(text, ''), '{word}')::VARCHAR)::VARCHAR[]"
    return f"""
WITH d AS (SELECT doc_id, {toks} AS w FROM documents), i AS (SELECT item_id, {toks} AS t FROM benchmark),
am(k, o, l, lo, hi) AS (VALUES {rows}),
m AS (SELECT * FROM am WHERE EXISTS (SELECT 1 FROM i WHERE len(t) BETWEEN lo AND hi)),
ds AS (SELECT doc_id, p, k, list_transform(o, lambda q: w[p + q]) AS s FROM (SELECT doc_id, w, k, o, unnest(range(1, len(w) - l + 2)) AS p FROM d, m)),
sd AS (SELECT item_id, p, k, list_transform(o, lambda q: t[p + q]) AS s FROM (SELECT item_id, t, k, o, unnest(range(1, len(t) - l + 2)) AS p FROM i JOIN m ON len(t) BETWEEN lo AND hi)),
h AS (SELECT DISTINCT doc_id, item_id, ds.p - sd.p AS g FROM ds JOIN sd USING (k, s)),
e AS (SELECT doc_id, item_id, g, len(t) AS n, list_transform(range(greatest(1, 1 - g), least(len(t), len(w) - g) + 1), lambda j: CASE WHEN t[j] = w[j + g] THEN 1 ELSE -{MISS} END) AS v FROM h JOIN i USING (item_id) JOIN d USING (doc_id)),
f AS (SELECT doc_id, item_id, g, n, len(list_filter(v, lambda x: x = 1)) AS matched, list_max(list_transform(range(1, len(v) + 1), lambda b: list_max(list_transform(range(1, b + 1), lambda a: list_sum(v[a:b]))))) AS run FROM e),
best AS (SELECT doc_id, item_id, n, max({{'m': matched, 'r': greatest(run, 0), 'd': -g}}) AS x FROM f WHERE matched * {MIN_SHARE[1]} >= n * {MIN_SHARE[0]} OR run >= {MIN_RUN} GROUP BY 1, 2, 3)
SELECT doc_id, item_id, CAST(n AS INT) AS item_tokens, CAST(x.m AS INT) AS matched, CAST(x.r AS INT) AS run, CAST(-x.d AS BIGINT) AS doc_start FROM best"""
