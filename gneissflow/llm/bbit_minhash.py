"""Near-duplicate classes by b-bit MinHash.

1. One Arrow pass turns each whole text into its set of distinct word shingles (64-bit hashes), a
   128-bit key of that set, ``ROWS * BANDS`` minima, their low ``BITS`` bits packed in bit planes,
   and one hash per band of minima.  Texts with the same set are one node from here on.
2. Nodes that share a band are candidates.  In every bucket each node is paired with one leader of
   the bucket, never with all others; then with a second leader, unless both are linked to the same
   first one.  The few pairs of one bucket that still lie in different components are compared in
   blocks of packed signatures, so no link is lost.
3. A pair whose b-bit estimate, corrected for chance collisions, lies ``SLACK`` (6 standard
   deviations) under the threshold is dropped; every other pair is confirmed on its full sets.
4. Links become components.

A pair at the threshold shares no band with probability (1 - s**ROWS)**BANDS: 6e-11 at 0.85 and
9e-8 at 0.8.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from ..operators.skew import hot_keys, salted_join
from ..scratch import materialize
from .textcore import mix, shingles, word_hashes

ROWS, BANDS, BITS = 5, 40, 4
PLANE = -(-ROWS * BANDS // 64)
BLOCK = 512
BLOCK_SIZE = 2_000_000  # shingles of a block, about
_rng = np.random.default_rng(20240607)
_A = (_rng.integers(0, 1 << 32, ROWS * BANDS, dtype=np.uint64).astype(np.uint32) | np.uint32(1))[:, None]
_B = _rng.integers(0, 1 << 32, ROWS * BANDS, dtype=np.uint64).astype(np.uint32)[:, None]
_SALT = mix(np.arange(1, BANDS + 1, dtype=np.uint64))


def slack(threshold: float) -> float:
    """Six standard deviations of the collision-corrected estimate at the threshold."""
    c = 2.0**-BITS
    p = c + (1 - c) * threshold
    return 6 * math.sqrt(p * (1 - p) / (ROWS * BANDS)) / (1 - c)


def minima(sets: np.ndarray) -> np.ndarray:
    """The smallest value of each hash function over one set; 32-bit multiply-and-mix functions."""
    x = (sets ^ (sets >> np.uint64(32))).astype(np.uint32)
    low = np.full(ROWS * BANDS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 4096):
        h = x[None, i : i + 4096] * _A
        h ^= h >> np.uint32(15)
        h += _B
        h *= np.uint32(0x85EBCA6B)
        np.minimum(low, h.min(axis=1), out=low)
    return low


def packed(low: np.ndarray) -> np.ndarray:
    """Bit planes of the low ``BITS`` bits: BITS x PLANE words of 64."""
    out = np.zeros((BITS, PLANE * 64), np.uint8)
    for b in range(BITS):
        out[b, : len(low)] = (low >> np.uint32(b)) & np.uint32(1)
    return np.packbits(out, axis=1, bitorder="little").view(np.uint64).reshape(-1)


def band_keys(low: np.ndarray) -> np.ndarray:
    rows = low.astype(np.uint64).reshape(BANDS, ROWS)
    h = _SALT.copy()
    for r in range(ROWS):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + rows[:, r])
    return h


def _set_key(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


_SIGNED = "doc_id long, text_hash long, n_shingles long, key binary, sig array<long>, bands array<long>"


def _signer(k: int):
    types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    names = ["doc_id", "text_hash", "n_shingles", "key", "sig", "bands"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, seen = batch.column(0), batch.column(1)
            for i, h, offs in word_hashes(batch.column(2)):
                n, keys, sigs, bands, memo = [], [], [], [], {}
                for r in range(len(offs) - 1):
                    s = shingles(h[offs[r] : offs[r + 1]], k)
                    n.append(len(s))
                    if not len(s):
                        keys.append(None)
                        sigs.append(None)
                        bands.append(None)
                        continue
                    key = _set_key(s)
                    if key not in memo:
                        low = minima(s)
                        memo[key] = packed(low).view(np.int64), band_keys(low).view(np.int64)
                    keys.append(key)
                    sigs.append(memo[key][0])
                    bands.append(memo[key][1])
                m = len(n)
                cols = [ids.slice(i, m), seen.slice(i, m), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, types[4]), pa.array(bands, types[5])]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, key, sig, bands of each row (the last three null if empty)."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(_signer(k), _SIGNED)


def _full_sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, h, offs in word_hashes(batch.column(1)):
                rows = [shingles(h[offs[r] : offs[r + 1]], k).view(np.int64) for r in range(len(offs) - 1)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(rows)), pa.array(rows, pa.list_(pa.int64()))], names=["key", "members"])

    return run


def _mismatches(x: str, y: str) -> F.Column:
    """Positions whose low bits differ, from two packed signatures."""
    words = []
    for w in range(PLANE):
        diff = None
        for b in range(BITS):
            d = F.col(x)[b * PLANE + w].bitwiseXOR(F.col(y)[b * PLANE + w])
            diff = d if diff is None else diff.bitwiseOR(d)
        words.append(F.bit_count(diff))
    return sum(words[1:], words[0])


def estimate(mismatch, bits: int = BITS, size: int = ROWS * BANDS):
    """Similarity from a count of unlike positions, corrected for chance matches of ``bits`` bits."""
    c = 2.0**-bits
    return (1 - mismatch / size - c) / (1 - c)


def _verified(pairs: DataFrame, sigs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose full sets reach the threshold.

    A leader stands in the pairs of its whole bucket: pairs of such nodes are dealt out over many tasks
    on either side, and the node's signature and set go to each of them.
    """
    pairs = materialize(pairs, "pairs")
    hot = {c: hot_keys(pairs, c) for c in ("a", "b")}

    def both(rows: DataFrame, of: DataFrame, what: str) -> DataFrame:
        rows = salted_join(rows, of.select(F.col("key").alias("a"), F.col(what).alias("_a")), "a", "b", hot["a"])
        return salted_join(rows, of.select(F.col("key").alias("b"), F.col(what).alias("_b")), "b", "a", hot["b"])

    likely = both(pairs, sigs, "sig").where(estimate(_mismatches("_a", "_b")) >= percent / 100 - slack(percent / 100)).select("a", "b")
    met = F.size(F.array_intersect("_a", "_b")).cast("long")
    return both(likely, sets, "members").where(met * 100 >= (F.size("_a") + F.size("_b") - met) * percent).select("a", "b")


def _confirm_blocks(percent: int):
    """Within one pair of blocks: links between components, confirmed on the full sets.

    A pair counts if it shares a band; pairs that links found here already connect are skipped.
    """
    least = percent / 100 - slack(percent / 100)

    def run(table: pa.Table) -> pa.Table:
        rows = table.select(["key", "comp", "block", "sig", "bands", "members"]).combine_chunks()
        key, block = rows["key"].to_pylist(), np.array(rows["block"].to_pylist())
        sig = np.array(rows["sig"].to_pylist(), np.int64).view(np.uint64).reshape(len(key), BITS, PLANE)
        bands = np.array(rows["bands"].to_pylist(), np.int64).reshape(len(key), BANDS)
        sets = [np.array(x.values) for x in rows["members"].chunk(0)] if len(key) else []
        size = np.array([len(x) for x in sets])
        code: dict = {}
        up = np.array([code.setdefault(c, len(code)) for c in rows["comp"].to_pylist()])  # labels merge below
        own, other = table["bi"][0].as_py(), table["bj"][0].as_py()
        left, right = np.flatnonzero(block == own), np.flatnonzero(block == other)
        out_a, out_b = [], []
        for i in left:
            rest = right[(up[right] != up[i]) & ((right > i) if own == other else True)]
            rest = rest[(bands[rest] == bands[i]).any(axis=1)]
            diff = np.zeros((len(rest), PLANE), np.uint64)
            for b in range(BITS):
                diff |= sig[rest, b] ^ sig[i, b]
            for j in rest[estimate(np.bitwise_count(diff).sum(axis=1)) >= least]:
                if up[i] == up[j]:
                    continue
                met = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * met >= percent * (size[i] + size[j] - met):
                    out_a.append(min(key[i], key[j]))
                    out_b.append(max(key[i], key[j]))
                    up[up == up[j]] = up[i]
        return pa.table({"a": pa.array(out_a, pa.binary()), "b": pa.array(out_b, pa.binary())})

    return run


def _across(at: DataFrame, sigs: DataFrame, sets: DataFrame, percent: int) -> DataFrame | None:
    """Links that the rounds have not tried: pairs that share a bucket but not a component.

    The buckets with several components fall into clusters that share nothing with each other.  A
    cluster is cut into blocks of about ``BLOCK`` nodes or ``BLOCK_SIZE`` shingles, and only the pairs of blocks that meet in
    a bucket are compared, each as one task-sized group.
    """
    ends = [F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count(F.lit(1)).alias("n"), F.min("key").alias("head")]
    open_ = at.groupBy("band").agg(*ends).where("c0 <> c1 AND n > 2").select("band", "head")  # a leader has met the other one of two
    rows = materialize(at.join(open_, "band"), "open")
    if rows.isEmpty():
        return None
    cluster = components(rows, "head", "key")
    nodes = rows.select("key", F.col("comp").alias("fine")).distinct().join(cluster.withColumnRenamed("node", "key"), "key")
    nodes = nodes.join(sigs.select("key", "n_shingles"), "key")
    size = F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n_shingles") / BLOCK_SIZE)
    nodes = materialize(nodes, "open_nodes")
    nodes = salted_join(nodes, nodes.groupBy("comp").agg(F.ceil(size).alias("blocks")), "comp", "key", hot_keys(nodes, "comp"))
    block = F.xxhash64("comp", F.pmod(F.xxhash64("key"), "blocks")).alias("block")
    nodes = materialize(nodes.select("key", F.col("fine").alias("comp"), block), "blocks")
    there = rows.select("band", "key").join(nodes.select("key", "block"), "key").select("band", "block").distinct()
    met = there.withColumnRenamed("block", "bi").join(there.withColumnRenamed("block", "bj"), "band")
    met = met.where("bi <= bj").select("bi", "bj").distinct()
    each = met.select("bi", "bj", F.explode(F.array_distinct(F.array("bi", "bj"))).alias("block"))
    full = nodes.join(sigs, "key").join(sets, "key")
    return each.join(full, "block").groupBy("bi", "bj").applyInArrow(_confirm_blocks(percent), "a binary, b binary")


def _stars(links: DataFrame, turn) -> DataFrame:
    """node, star: the first in the leaders' order of a node and those linked to it, its leader as a
    rule.  Nodes with one star are connected."""
    ends = links.union(links.select("b", "a")).toDF("node", "y")
    best = ends.groupBy("node").agg(F.min_by("y", turn("y", 0)).alias("y"))
    return best.select("node", F.when(turn("y", 0) < turn("node", 0), F.col("y")).otherwise(F.col("node")).alias("star"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """(decisions, signed): one row per row of ``docs``.

    decisions: doc_id, text_hash, n_shingles, component_id.  Rows with the same doc_id and text get
    the same decision.  Null, empty and blank texts have the empty set and are linked with nothing:
    their component_id is their own doc_id.  A null doc_id takes part in links; component_id is the
    smallest non-null doc_id of the component.  Columns other than doc_id and text are not read.
    """
    signed = materialize(signatures(docs, k), "signed")
    first = F.min_by(F.struct("doc_id", "text_hash", "n_shingles", "sig", "bands"), F.struct("doc_id", "text_hash"))
    nodes = signed.where("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("low_id"), first.alias("r"))
    nodes = materialize(nodes.select("key", "low_id", "r.*"), "nodes")
    rows = nodes.select("key", F.explode("bands").alias("band"))
    shared = rows.groupBy("band").agg(F.min("key").alias("first"), F.max("key").alias("last")).where("first <> last")
    buckets = materialize(rows.join(shared.select("band"), "band"), "buckets")
    members = buckets.select("key").distinct()
    chosen = nodes.select("key", "doc_id", "text_hash", "n_shingles", "sig", "bands").join(members, "key", "left_semi")
    sigs = materialize(chosen, "sigs")
    full = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))
    wanted = sigs.select("key", F.col("doc_id").alias("__g_id"), F.col("text_hash").alias("__g_th"))
    texts = wanted.join(full, F.col("__g_id").eqNullSafe(F.col("doc_id")) & (F.col("__g_th") == F.col("text_hash"))).select("key", "text")
    sets = materialize(texts.mapInArrow(_full_sets(k), "key binary, members array<long>").dropDuplicates(["key"]), "sets")
    sigs = sigs.select("key", "n_shingles", "sig", "bands")

    turn = lambda c, n: F.struct(F.xxhash64(c, F.lit(n)), F.col(c))
    heads = buckets.groupBy("band").agg(F.min_by("key", turn("key", 0)).alias("head"), F.min_by("key", turn("key", 1)).alias("next"))
    met = materialize(buckets.join(heads, "band").where("key <> head OR key <> next").select("key", "head", "next").distinct(), "met")
    pair = lambda df, c: df.where(F.col(c) != F.col("key")).select(F.least(c, "key").alias("a"), F.greatest(c, "key").alias("b")).distinct()
    links = materialize(_verified(pair(met, "head"), sigs, sets, percent), "links")
    named = _stars(links, turn)
    open_ = materialize(met.where("key <> next").select("key", "next").distinct(), "open_pairs")
    of_next = named.select(F.col("node").alias("next"), F.col("star").alias("t"))
    open_ = salted_join(open_, of_next, "next", "key", hot_keys(open_, "next"), "left")
    open_ = open_.join(named.select(F.col("node").alias("key"), F.col("star").alias("s")), "key", "left")
    open_ = open_.where(F.coalesce("s", "key") != F.coalesce("t", "next"))
    links = materialize(links.union(_verified(pair(open_, "next"), sigs, sets, percent)), "links")
    comps = components(links)
    at = buckets.join(comps.withColumnRenamed("node", "key"), "key", "left").withColumn("comp", F.coalesce("comp", "key"))
    more = _across(at, sigs, sets, percent)
    if more is not None:
        comps = components(materialize(links.union(more), "links"))

    low = nodes.select("key", "low_id").join(comps.withColumnRenamed("node", "key"), "key", "left")
    low = materialize(low.select("key", "low_id", F.coalesce("comp", "key").alias("comp")), "low")
    by_comp = low.groupBy("comp").agg(F.min("low_id").alias("component_id"))
    named = salted_join(low, by_comp, "comp", "key", hot_keys(low, "comp")).select("key", "component_id")
    slim = signed.drop("sig", "bands")
    out = salted_join(slim, materialize(named, "named"), "key", "doc_id", hot_keys(slim, "key"), "left")
    component = F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "text_hash", "n_shingles", component.alias("component_id")), signed


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each near-duplicate class: the one with the smallest doc_id.

    Empty texts are classes of their own.  Of repeated rows (same doc_id and text) one stays; if
    all of a class have a null doc_id, one text of it stays.  All columns of ``docs`` are kept.
    """
    found, _ = near_duplicates(docs, k, percent)
    found = materialize(found, "classes")
    none = F.col("component_id").isNull()
    # the text that stays for each class: its smallest id, then the smallest text hash
    order = F.struct(F.coalesce(F.col("doc_id") != F.col("component_id"), F.lit(False)), "text_hash")
    stay = found.groupBy("component_id", F.when(none, F.col("text_hash")).alias("__g_g")).agg(F.min_by("text_hash", order).alias("__g_keep"))
    gone = salted_join(found, stay.where(~none).drop("__g_g"), "component_id", "doc_id", hot_keys(found, "component_id"))
    other = (F.col("doc_id") != F.col("component_id")) | F.col("doc_id").isNull() | (F.col("text_hash") != F.col("__g_keep"))
    gone = gone.where(other).select(F.col("doc_id").alias("__g_id"), F.col("text_hash").alias("__g_th")).distinct()
    twice = found.groupBy(F.col("doc_id").alias("__g_id"), F.col("text_hash").alias("__g_th")).count().where("count > 1").select("__g_id", "__g_th")
    twice = materialize(twice, "twice")
    same = F.col("__g_id").eqNullSafe(F.col("doc_id")) & (F.col("__g_th") == F.xxhash64("text"))
    kept = docs.join(gone, same, "left_anti")
    if twice.isEmpty():
        return kept
    once = kept.join(twice, same, "left_semi").withColumn("__g_th", F.xxhash64("text")).dropDuplicates(["doc_id", "__g_th"]).drop("__g_th")
    return kept.join(twice, same, "left_anti").unionByName(once)
