"""Each training-data operator against a plain version, on the small tables and on odd inputs."""

import itertools
import re
import time
import zlib

import numpy as np
import plain_versions as plain
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gneissflow.llm import bbit_minhash as mh
from gneissflow.llm import hilbert_shard as hs
from gneissflow.llm import markov_secrets as ms
from gneissflow.llm import mixing as mx
from gneissflow.llm import patience_license as pl
from gneissflow.llm import queries as q
from gneissflow.llm import rp_forest as rp
from gneissflow.llm import spaced_seeds as ss
from gneissflow.llm import subword_quality as sq
from gneissflow.llm import textcore as tc
from gneissflow.llm import token_scan as ts
from gneissflow.llm import url_filter as uf


def docs_of(spark, sf, name="documents"):
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ---- shared word hashing


def test_words_match_plain_python():
    texts = ["a B  c\td", None, "", "  ", "É é\x0bX", "z" * 50, "one"]
    got = [h[offs[r] : offs[r + 1]] for _, h, offs in tc.word_hashes(pa.array(texts)) for r in range(len(offs) - 1)]
    assert [len(g) for g in got] == [len(plain.words(t)) for t in texts]
    again = [h[offs[0] : offs[1]] for t in texts for _, h, offs in tc.word_hashes(pa.array([t], pa.string()))]
    assert all((a == b).all() for a, b in zip(got, again, strict=True))


def test_long_text_is_hashed_in_pieces():
    text = " ".join(f"w{i % 5000}" for i in range(700_000))
    (_, h, offs), = tc.word_hashes(pa.array([text]))
    short = np.concatenate([x for _, x, _ in tc.word_hashes(pa.array([" ".join(f"w{i}" for i in range(5000))]))])
    assert offs[-1] == 700_000 and (h == np.tile(short, 140)).all()


# ---- 1 decontamination


def test_spaced_seeds_against_all_pairs(spark, sf):
    docs, bench = docs_of(spark, sf), docs_of(spark, sf, "benchmark")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    items = [(r.item_id, r.text) for r in bench.collect()][:12]
    some = bench.where(F.col("item_id").isin([i for i, _ in items]))
    # plant copies with every sixth word replaced, and cut ones
    base = 10**6
    for n, (_, t) in enumerate(items):
        w = t.split()
        rows.append((base + n, "lead in words here " + " ".join("qqq" if i % 6 == 5 else x for i, x in enumerate(w)) + " and out"))
        rows.append((base + 100 + n, " ".join(w[: len(w) * 3 // 4])))
    rows = [r for r in rows if r[1] is not None and len(r[1]) < 4000]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in ss.overlaps(table, some).collect()}
    assert got == plain.leaks(rows, items)
    assert {base + n for n in range(12)} <= {d for d, _ in got}


def test_masks_hit_every_admitted_pattern():
    for n in range(ss.SPAN, 2 * ss.SPAN):
        k = n - -(-n * ss.MIN_SHARE[0] // ss.MIN_SHARE[1])
        places = [sum(1 << (i + q) for q, c in enumerate(m) if c == "1") for m in ss.MASKS for i in range(n - len(m) + 1)]
        lost = [sum(1 << i for i in c) for c in itertools.combinations(range(n), k)]
        assert all(any(x & p == 0 for p in places) for x in lost), n


def test_spaced_seeds_find_changed_short_items(spark):
    rng = np.random.default_rng(1)
    items, rows = [], []
    for n in range(9, 27):
        w = [f"i{n}w{j}" for j in range(n)]
        items.append((n, " ".join(w)))
        for v in range(12):
            lost = set(rng.choice(n, n * 3 // 10 + (v == 0), replace=False).tolist())
            rows.append((n * 100 + v, "before it " + " ".join("zz" if j in lost else x for j, x in enumerate(w)) + " after it"))
    got = {(r.doc_id, r.item_id) for r in ss.overlaps(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = plain.leaks(rows, items)
    assert got == want and {(n * 100 + v, n) for n in range(9, 27) for v in range(1, 12)} <= want


def test_spaced_seeds_find_items_of_few_tokens(spark):
    items = [(n, " ".join(f"I{n}w{j}" for j in range(n))) for n in range(1, 10)] + [(20, "la la"), (21, "?!"), (22, "I3w0 i3w1, i3w2")]
    rows = [(n, f"so {t.lower()}, and {t} again") for n, t in items[:9]] + [(30, items[4][1].replace("w2", "x")), (31, items[2][1][5:]), (32, "la la la"), (33, items[6][1])]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.item_tokens, r.matched, r.run, r.doc_start) for r in ss.overlaps(docs, bench).collect()}
    assert got == {(n, n): (n, n, n, 1) for n in range(1, 10)} | {(3, 22): (3, 3, 3, 1), (32, 20): (2, 2, 2, 0), (33, 7): (7, 7, 7, 0)}
    assert set(got) == plain.leaks(rows, items)
    assert {r.doc_id for r in ss.clean(docs, bench).collect()} == {30, 31}


def test_spaced_seeds_compare_very_long_items_whole(spark):
    n = (1 << 20) + 40
    pair = spark.range(1, n + 1).agg(F.sort_array(F.collect_list("id")).alias("item")).withColumn("tokens", F.concat(F.array(F.lit(0), F.lit(-5)), F.slice("item", 2, n)).cast("array<long>"))
    got = pair.withColumn("diag", F.lit(1)).select(ss.alike().alias("s")).select(F.size("s").alias("n"), F.size(F.filter("s", lambda x: x)).alias("m")).first()
    assert tuple(got) == (n, n - 1)


def test_filter_grows_with_the_seeds_within_its_bounds(spark):
    assert [ss.bloom_bits(n) for n in (0, 1 << 10, 1 << 15, 1 << 40)] == [20, 20, 22, 28]
    rng = np.random.default_rng(0)
    own, other = (rng.integers(0, 1 << 63, 20_000).astype(np.uint64) for _ in range(2))
    bloom = ss.bloom_of(spark.createDataFrame([(int(x),) for x in own.view(np.int64)], "seed long"), ss.bloom_bits(len(own)))
    assert len(ss._passes(bloom, own)) == len(own) and len(ss._passes(bloom, other)) < 3


def test_spaced_seeds_odd_inputs(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "too short"), (4, "alpha beta gamma delta epsilon zeta eta theta iota kappa"), (5, "alpha beta gamma delta epsilon zeta eta theta iota kappa"), (None, "alpha beta gamma delta epsilon zeta eta theta iota kappa")], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id or 0) for r in ss.overlaps(odd_docs, bench).collect())
    assert got == [(d, i) for d in (1, 2) for i in (0, 4, 5)]
    assert ss.overlaps(no_docs, bench).count() == 0 and ss.overlaps(odd_docs, bench.where("false")).count() == 0
    kept = ss.clean(odd_docs, bench)
    assert kept.columns == odd_docs.columns and kept.count() == 9


# ---- 2 licences


def test_patience_alignment_by_definition():
    rng = np.random.default_rng(0)
    for n in range(300):
        a, b = (rng.integers(0, 30 if n % 2 else 8, rng.integers(0, 25)).tolist() for _ in range(2))
        m, want = pl.patience(a, b), plain.align(a, b)
        assert all(a[i] == b[j] for i, j in m)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(m, m[1:], strict=False))
        once = [(i, b.index(w)) for i, w in enumerate(a) if a.count(w) == b.count(w) == 1]
        longest = [1] * len(once)
        for i in range(len(once)):
            longest[i] += max((longest[k] for k in range(i) if once[k][1] < once[i][1]), default=0)
        assert len(pl._increasing(once)) == max(longest, default=0)
        assert not want or m
    assert pl.patience([1, 2, 3], [1, 2, 3]) == [(0, 0), (1, 1), (2, 2)]
    assert pl.patience([9, 1, 8, 2, 7, 3], [1, 2, 3]) == [(1, 0), (3, 1), (5, 2)]


def test_license_coverage_does_not_depend_on_the_place():
    tm = pl.Templates()
    words = lambda t: np.concatenate([h for _, h, _ in tc.word_hashes(pa.array([t]), tc.PUNCT, True)])
    t = tm.names.index("ISC")
    n = len(tm.words[t])
    rng = np.random.default_rng(5)
    body = pl.TEMPLATES["ISC"].split()
    for rate in (0.0, 0.12):
        own = [w if rng.random() >= rate else f"x{i}" for i, w in enumerate(body)]
        for before in range(0, 2 * n, 7):
            doc = words(" ".join([f"f{i}" for i in range(before)] + own + [f"g{i}" for i in range(90)]))
            at = np.minimum(np.searchsorted(tm.vocab, doc), len(tm.vocab) - 1)
            got = tm.find(doc, t, np.where(tm.vocab[at] == doc, at, -1))
            # brute force: every stretch that holds the copy, from its first word on
            best = max(len(pl.patience(doc[before : before + k].tolist(), tm.words[t].tolist())) for k in range(n - 3, n + 4))
            assert [m for _, _, m in got] == [best]
            assert rate or got == [(before, before + n, n)]


def test_license_scan(spark, odd_docs, no_docs):
    mit = pl.TEMPLATES["MIT"]
    changed = " ".join(w for i, w in enumerate(mit.split()) if i % 12 != 3)
    filler = " ".join(f"filler{i}" for i in range(300))
    rows = [(1, f"{filler} {mit} {filler}"), (2, f"{filler} {changed}"), (3, "Released under the MIT License. All rights reserved. All rights reserved."), (4, "rights of all are reserved by the license"), (5, filler)]
    got = pl.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.license, r.start_word, r.coverage))
    assert by[1] == [("MIT", 300, 1.0)]
    assert by[2][0][0] == "MIT" and by[2][0][2] > 0.85
    assert sorted(by[3]) == [("MIT-notice", 0, 1.0), ("all-rights-reserved", 5, 1.0), ("all-rights-reserved", 8, 1.0)]
    assert 4 not in by and 5 not in by
    assert pl.scan(odd_docs).count() == 0 and pl.scan(no_docs).count() == 0


def test_license_lines_of_the_table(spark, sf):
    docs = docs_of(spark, sf).collect()
    want = {(r.doc_id, n) for r in docs for n, t in pl.TEMPLATES.items() if len(t) < 80 and t in r.text}
    got = {(r.doc_id, r.license) for r in pl.scan(docs_of(spark, sf)).collect()}
    assert want <= got and len(got) <= len(want) * 1.1 + 2


# ---- 3 nearest neighbours


def recall(found, ids, vecs):
    """Mean share of the true 20 nearest; checks form and scores on the way."""
    want, got, at = plain.nearest(ids, vecs, 20, 20), {}, {int(i): n for n, i in enumerate(ids)}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
        assert r["rank"] == len(got[r.query_id]) and r.vec_id != r.query_id
        assert abs(r.score - float(vecs[at[r.query_id]] @ vecs[at[r.vec_id]])) < 1e-12
    assert set(got) == set(want) and all(len(v) == 20 == len(set(v)) for v in got.values())
    return np.mean([len(set(got[i]) & set(want[i])) / 20 for i in want])


@pytest.mark.parametrize("size", ["0.001", "0.1"])
def test_forest_recall_on_the_tables(spark, sf, size):
    e = docs_of(spark, sf.replace("0.001", size), "embeddings")
    rows = e.collect()
    ids, vecs = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)
    assert recall(rp.nearest(e), ids, vecs) >= 0.9


def test_forest_recall_on_many_vectors(spark):
    """12,000 vectors without any structure, the hardest case, with the settings that run; and grouped ones with few reads."""
    rng = np.random.default_rng(11)
    ids = np.arange(1, 12_001)
    loose = rng.normal(size=(12_000, 64))
    grouped = rng.normal(size=(200, 64))[rng.integers(0, 200, 12_000)] + 0.4 * rng.normal(size=(12_000, 64))
    for vecs, share, spare in ((loose, rp.SHARE, rp.SPARE), (grouped, 0.02, 100)):
        vecs = (vecs / np.linalg.norm(vecs, axis=1, keepdims=True)).astype(np.float32)
        table = spark.createDataFrame(zip(ids.tolist(), vecs.tolist(), strict=True), "vec_id long, embedding array<float>")
        assert recall(rp.nearest(table, share=share, spare=spare), ids, vecs.astype(np.float64)) >= 0.9


def test_share_follows_the_structure_of_the_vectors(spark):
    """The measured share: small for grouped vectors, large without structure, enough for the neighbours in both."""
    rng = np.random.default_rng(12)
    loose = rng.normal(size=(6000, 32))
    grouped = rng.normal(size=(150, 32))[rng.integers(0, 150, 6000)] + 0.3 * rng.normal(size=(6000, 32))
    forests = [rp.Forest(x / np.linalg.norm(x, axis=1, keepdims=True), 6000) for x in (loose, grouped)]
    assert forests[1].share < 0.03 < 0.1 < forests[0].share <= len(forests[0].trees)
    vecs = (grouped / np.linalg.norm(grouped, axis=1, keepdims=True)).astype(np.float32)
    ids = np.arange(1, 6001)
    table = spark.createDataFrame(zip(ids.tolist(), vecs.tolist(), strict=True), "vec_id long, embedding array<float>")
    assert recall(rp.nearest(table), ids, vecs.astype(np.float64)) >= 0.9
    for few in (np.zeros((0, 0)), np.ones((1, 3)), np.ones((40, 3)), np.eye(3)):
        assert 0 <= rp.Forest(few, len(few)).share <= 8


def test_leaves_come_from_one_queue(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 16))
    forest = rp.Forest(x, len(x), trees=3)
    leaves = [forest.route(x, t) for t in range(3)]
    sizes = [np.bincount(c, minlength=forest.leaves(t)).tolist() for t, c in enumerate(leaves)]
    (got,) = forest.visit(x[:1], sizes, 500)
    scores = {(t, n): float(forest.trees[t][3][n] @ x[0]) for t in range(3) for n in range(forest.leaves(t)) if sizes[t][n]}
    order = sorted(scores, key=lambda k: -scores[k])
    assert got == order[: len(got)] and sum(sizes[t][n] for t, n in got[:-1]) < 500 <= sum(sizes[t][n] for t, n in got)


def test_forest_odd_inputs(spark):
    schema = "vec_id long, embedding array<float>, score string"
    one = [1.0, 0.0]
    rows = [(i, one, "a") for i in range(0, 60)] + [(60, [0.0, 0.0], "z"), (80, None, "n"), (100, [float("nan"), 1.0], "x"), (120, [None, 1.0], "x"), (140, [0.5, 0.5], "x"), (140, [0.5, 0.5], "x"), (160, [1.0, 2.0, 3.0], "x"), (None, one, "x")]
    got = rp.nearest(spark.createDataFrame(rows, schema)).orderBy("query_id", "rank").collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(by) == {0, 20, 40, 140}
    assert [v for _, v, _ in by[20]] == [i for i in range(21) if i != 20]
    assert [v for _, v, _ in by[140]] == list(range(20)) and by[140][0][2] == 0.5
    assert rp.nearest(spark.createDataFrame([], schema)).count() == 0
    assert rp.nearest(spark.createDataFrame([(0, one, "a")], schema)).count() == 0


# ---- 4 mixing


def _fill(children, budget):
    """Water level by plain search over whole numbers, largest level that fits."""
    live, given = dict(children), {}
    while live:
        w = sum(c[0] for c in live.values())
        full = {n for n, (wt, cap) in live.items() if cap * w <= budget * wt}
        if not full:
            return given | {n: min(cap, budget * wt // w) for n, (wt, cap) in live.items()}
        first = min(full, key=lambda n: (live[n][1] / live[n][0], n))
        given[first] = live[first][1]
        budget -= live.pop(first)[1]
    return given


def test_budgets_against_a_plain_version(spark, sf):
    out = mx.mix(docs_of(spark, sf), share=(9, 10), max_epochs=3).collect()
    docs = docs_of(spark, sf).collect()
    name = {0: "web", 1: "books", 2: "code", 3: "talk"}
    leaf = {r.doc_id: (name[int(r.source[3:]) % 4], r.lang, r.source) for r in docs}
    size = {r.doc_id: len(plain.words(r.text)) for r in docs}
    tokens = {}
    for i, k in leaf.items():
        tokens[k] = tokens.get(k, 0) + size[i]
    total = sum(tokens.values()) * 9 // 10
    cap = lambda *p: sum(3 * n for k, n in tokens.items() if k[: len(p)] == p)
    want = {}
    for d, b in _fill({d: (mx.DOMAIN_WEIGHTS[d], cap(d)) for d in {k[0] for k in tokens}}, total).items():
        for g, c in _fill({g: (mx.LANG_WEIGHTS.get(g, 1), cap(d, g)) for g in {k[1] for k in tokens if k[0] == d}}, b).items():
            for s, x in _fill({s: (1, cap(d, g, s)) for s in {k[2] for k in tokens if k[:2] == (d, g)}}, c).items():
                want[d, g, s] = x
    got, runs = {}, {}
    for r in out:
        k = leaf[r.doc_id]
        got[k] = got.get(k, 0) + r.take
        assert r.n_tokens == size[r.doc_id] and 0 <= r.take <= r.n_tokens
        runs.setdefault((k, r.epoch), []).append((r.start, r.take))
    assert got == {k: v for k, v in want.items() if v}
    for pieces in runs.values():
        at = 0
        for start, take in sorted(pieces):
            assert start == at
            at += take


def test_mixing_odd_inputs(spark, odd_docs, no_docs):
    assert mx.mix(no_docs).count() == 0
    got = mx.mix(odd_docs, share=(1, 1), max_epochs=1)
    assert got.where("take < n_tokens").count() == 0
    kept = mx.select_documents(odd_docs, (1, 1))
    assert kept.columns == odd_docs.columns
    assert mx.mix(odd_docs, budget=0).count() == 0


def test_a_long_document_does_not_empty_its_leaf(spark):
    rows = [(1, "w " * 1000, "en", "src0"), (2, "v " * 1000, "de", "src1"), (3, "u " * 10, "de", "src1"), (3, "u " * 10, "de", "src1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = mx.select_documents(docs, (1, 2)).groupBy("source").count().collect()
    assert {r.source for r in kept} == {"src0", "src1"}
    assert mx.select_documents(docs, (1, 1)).count() == 4


# ---- 5 shards


def test_hilbert_index_walks_cell_by_cell(spark):
    for n, o in ((2, 3), (3, 2)):
        cells = spark.range(1 << n * o).select(*[(F.shiftright("id", o * i) % (1 << o)).alias(f"x{i}") for i in range(n)])
        rows = cells.select("*", hs.hilbert_index([F.col(f"x{i}") for i in range(n)], o).alias("h")).collect()
        assert all(r.h == plain.hilbert_index(list(r)[:n], o) for r in rows)
        by = {r.h: tuple(r)[:n] for r in rows}
        assert sorted(by) == list(range(1 << n * o))
        assert all(sum(abs(a - b) for a, b in zip(by[i], by[i + 1], strict=True)) == 1 for i in range(len(by) - 1))


def test_shards_against_a_plain_version(spark, sf, odd_docs):
    for docs in (docs_of(spark, sf), odd_docs.where("doc_id > 2")):
        rows = [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()]
        got = {r.doc_id: (r.curve, r.shard, r.slot) for r in hs.shards(docs, 8).collect()}
        assert got == plain.shards(rows, 8)


def test_shards_can_be_skipped_by_minima_and_maxima(spark, sf):
    """Readers of one language, one source or the long texts skip shards; by chance they would skip none."""
    docs = docs_of(spark, sf.replace("0.001", "0.01"))
    at = hs.assign(docs, 16).withColumn("size", F.octet_length("text"))
    ends = [f(c).alias(f"{n}_{c}") for c in ("lang", "source", "size") for n, f in (("lo", F.min), ("hi", F.max))]
    shards = at.groupBy("shard").agg(*ends).collect()
    read = lambda c, v: sum(r[f"lo_{c}"] <= v <= r[f"hi_{c}"] for r in shards)
    langs, sources = ([r[0] for r in docs.select(c).distinct().collect()] for c in ("lang", "source"))
    assert np.mean([read("lang", v) for v in langs]) <= 8
    assert np.mean([read("source", v) for v in sources]) <= 12
    assert sum(r.hi_size >= 1 << 13 for r in shards) < 16


def test_shards(spark, sf):
    docs = {r.doc_id: r for r in docs_of(spark, sf).collect()}
    out = q.op5_hilbert_shards(spark, sf).collect()
    assert sorted(r.doc_id for r in out) == sorted(docs)
    sums, slots, order = {}, {}, {}
    for r in out:
        raw = docs[r.doc_id].text.encode()
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
        sums[r.shard] = sums.get(r.shard, 0) + r.size
        slots.setdefault(r.shard, []).append(r.slot)
        order[r.shard, r.slot] = r.curve
    assert set(sums) == set(range(8)) and max(sums.values()) - min(sums.values()) <= 2 * max(r.size for r in out)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    curve = [order[k] for k in sorted(order)]
    assert curve == sorted(curve)


def test_shards_odd_inputs(spark, odd_docs, no_docs):
    out = hs.shards(odd_docs, 3).collect()
    assert len(out) == 12 and {r.shard for r in out} <= {0, 1, 2}
    assert hs.shards(no_docs).count() == 0
    assert sorted(map(str, hs.assign(odd_docs, 3).collect())) == sorted(map(str, hs.assign(odd_docs.repartition(3), 3).collect()))
    got = hs.assign(odd_docs, 3)
    assert got.count() == 12 and got.select("shard", "slot").distinct().count() == 12
    assert hs.assign(no_docs).count() == 0


# ---- 6 token counts


@pytest.mark.parametrize("block", [7, 64, 1 << 16])
def test_separator_scan_round_trip(spark, sf, block):
    docs = docs_of(spark, sf).limit(60)
    with open(ts.VOCABULARY, "rb") as f:
        enc = ts.load_encoding(f.read())
    want = {r.doc_id: len(enc.encode_ordinary(r.text)) for r in docs.collect()}
    got = ts.separator_scan(ts.token_streams(docs, block=block)).collect()
    assert {r.doc_id: r.n_tokens for r in got} == want and all(r.closed for r in got)
    for s in {r.stream for r in got}:
        at = 0
        for r in sorted((r for r in got if r.stream == s), key=lambda r: r.ordinal):
            assert r.start == at
            at += r.n_tokens + 1


def test_flat_files(spark, tmp_path):
    rng = np.random.default_rng(1)
    want = {}
    for n in range(3):
        t = rng.integers(0, 5, 1000 * n).astype(np.uint16)
        t[t == 0] = ts.EOD
        t.tofile(tmp_path / f"f{n}.bin")
        ends = [*np.flatnonzero(t == ts.EOD), *([len(t)] if len(t) and t[-1] != ts.EOD else [])]
        want |= {(f"f{n}.bin", i): int(b - a - 1) for i, (a, b) in enumerate(zip([-1, *ends[:-1]], ends, strict=True))} if ends else {}
    got = {(r.stream.rsplit("/", 1)[1], r.ordinal): r.n_tokens for r in ts.separator_scan(ts.token_files(spark, str(tmp_path), 13)).collect()}
    assert got == want


def test_flat_files_with_an_odd_end(spark, tmp_path):
    t = np.array([5, 6, ts.EOD, 7], np.uint16).tobytes()
    for name, data in (("a.bin", t + b"\x01"), ("b.bin", b"\x01"), ("c.bin", b"")):
        (tmp_path / name).write_bytes(data)
    got = ts.separator_scan(ts.token_files(spark, str(tmp_path), 2)).orderBy("ordinal").collect()
    assert [(r.n_tokens, r.closed) for r in got] == [(2, True), (1, False)]


def test_one_huge_text_among_small_blocks(spark):
    """A text of many blocks: each token is copied once, whatever the number of cuts."""
    text = " ".join(f"w{i % 999}" for i in range(400_000))
    docs = spark.createDataFrame([(1, "a b"), (2, text), (3, "c")], "doc_id long, text string").coalesce(1)
    with open(ts.VOCABULARY, "rb") as f:
        enc = ts.load_encoding(f.read())
    got = {r.doc_id: r.n_tokens for r in ts.separator_scan(ts.token_streams(docs, block=64)).collect()}
    assert got == {i: len(enc.encode_ordinary(t)) for i, t in ((1, "a b"), (2, text), (3, "c"))}


def test_token_counts_odd_inputs(spark, odd_docs, no_docs):
    got = ts.separator_scan(ts.token_streams(odd_docs)).collect()
    assert len(got) == 12 and sum(r.n_tokens == 0 for r in got) == 3
    assert ts.separator_scan(ts.token_streams(no_docs)).count() == 0


# ---- 7 near-duplicates


def _variants(rng, words, n, rate):
    return [" ".join(str(rng.integers(10**6)) if rng.random() < rate else w for w in words) for _ in range(n)]


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_against_all_pairs(spark, sf, k, percent):
    rng = np.random.default_rng(2)
    rows = [(r.doc_id, r.text) for r in docs_of(spark, sf).collect()]
    base = [f"w{i}" for i in range(150)]
    more = _variants(rng, base, 60, 0.015) + _variants(rng, base, 40, 0.04) + [" ".join(base[: 150 - i]) for i in range(0, 60, 4)] * 2
    rows += [(10**6 + i, t) for i, t in enumerate(more)] + [(2 * 10**6, None), (2 * 10**6 + 1, ""), (2 * 10**6 + 2, "a b"), (2 * 10**6 + 3, "A  b"), (2 * 10**6 + 4, "a")]
    found, _ = mh.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k, percent)
    assert {r.doc_id: r.component_id for r in found.collect()} == plain.near_classes(rows, k, percent)


def test_estimate_is_corrected_for_chance():
    rng = np.random.default_rng(3)
    for share in (0.2, 0.5, 0.9):
        errors = []
        for _ in range(30):
            common, own = rng.integers(1 << 62, size=int(400 * share)), [rng.integers(1 << 62, size=int(200 * (1 - share))) for _ in range(2)]
            sets = [np.unique(np.concatenate([common, o]).astype(np.uint64)) for o in own]
            a, b = (mh.packed(mh.minima(s)).reshape(mh.BITS, mh.PLANE) for s in sets)
            mism = int(np.bitwise_count(np.bitwise_or.reduce(a ^ b, axis=0)).sum())
            true = len(np.intersect1d(*sets)) / len(np.union1d(*sets))
            errors.append(mh.estimate(mism) - true)
        assert abs(np.mean(errors)) < 0.02


def test_near_duplicates_odd_inputs(spark, odd_docs, no_docs):
    found, _ = mh.near_duplicates(odd_docs, 3, 85)
    by = {(r.doc_id, r.n_shingles > 0): r.component_id for r in found.collect()}
    assert len(found.collect()) == 12
    assert by[1, True] == by[2, True] == 1 and by[3, False] == 3 and by[4, False] == 4 and by[None, True] == 7 and by[7, True] == 7 and by[None, False] is None
    kept = mh.keep_one(odd_docs, 3, 85)
    assert kept.columns == odd_docs.columns
    ids = sorted((r.doc_id or -1) for r in kept.select("doc_id").collect())
    assert ids == [-1, 1, 3, 4, 5, 6, 7, 8, 9]
    assert mh.near_duplicates(no_docs)[0].count() == 0 and mh.keep_one(no_docs).count() == 0


# ---- 8 secrets

TRICKY = [
    None, "", "password=short", "PassWord : 'longenough1'", "token=token:abcdefg", "api_key == abcdefgh", "apikey=\"abc/def+ghi=\" AKIA" + "A1" * 9, "AKIAAKIA" + "B2" * 8,
    "é🙂 token = \"" + "0a" * 20 + "\" end", "deadbeef" * 3 + "x" + "f" * 23, "secret=secret=secretsecret", "AKIA" + "Z" * 15, "passwd:abcdef,passwd:ghijkl",
    "xAKIA" + "Q9" * 10 + "q", "token=" + "a" * 5 + " token=" + "b" * 6, "ſecret=abcdefgh toKen=abcdefgh",
]


def test_base_spans(spark, sf):
    rows = [(i, t) for i, t in enumerate(TRICKY)] + [(100 + r.doc_id, r.text) for r in docs_of(spark, sf).collect()]
    found = ms.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", ms.told("base_spans").alias("b"), ms.told("spans").alias("s"))
    got = {r.doc_id: (r.b, r.s) for r in found.collect()}
    for i, t in rows:
        want = plain.base_spans(t)
        assert got[i][0] == ",".join(f"{k}:{a}:{b}" for k, a, b in want), t
        spans = [x.split(":") for x in got[i][1].split(",") if x]
        assert [s for s in spans if s[0] != "markov"] == [x.split(":") for x in got[i][0].split(",") if x]
        for k, a, b in spans:
            if k == "markov":
                assert all(int(b) <= x or int(a) >= y for _, x, y in want) and re.fullmatch(ms.CANDIDATE, t[int(a) : int(b)])


def test_models_tell_random_from_ordinary(spark):
    table = ms.train(ms.labelled_samples(spark, 2000))
    fresh = ms.labelled_samples(spark, 4000).where("length(text) >= 20")
    hit = fresh.select("label", (ms.llr_per_pair(F.col("text"), ms.ratio_table(table)) >= ms.LLR_PER_PAIR).alias("hit")).groupBy("label").agg(F.avg(F.col("hit").cast("int")).alias("r")).collect()
    rate = {r.label: r.r for r in hit}
    assert rate[1] > 0.95 and rate[0] < 0.01
    # the same numbers by plain Python
    samples = ms.labelled_samples(spark, 300)
    counts = {}
    code = lambda c: ms.ALPHABET.find(c) if c in ms.ALPHABET else ms.CLASSES - 1
    for r in samples.collect():
        for x, y in zip(r.text, r.text[1:], strict=False):
            p = code(x) * ms.CLASSES + code(y)
            n = counts.get(p, (0, 0))
            counts[p] = (n[0] + (r.label == 0), n[1] + (r.label == 1))
    assert np.allclose(ms.train(samples), ms.ratios(counts))


def test_model_spans_and_odd_inputs(spark, odd_docs, no_docs):
    rows = [(1, "key 9fJx2LqTz7VbN4mKsW8dYp3R end"), (2, "call get_user_name_from_table_index now"), (3, "Rindfleischetikettierungsaufgabe unterderunteren")]
    got = {r.doc_id: r.s for r in ms.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", ms.told("spans").alias("s")).collect()}
    assert got == {1: "markov:4:28", 2: "", 3: ""}
    out = ms.find_secrets(odd_docs)
    assert out.count() == 12 and set(odd_docs.columns) < set(out.columns) and ms.find_secrets(no_docs).count() == 0


def test_model_spans_against_a_plain_version(spark):
    table = ms.train(ms.labelled_samples(spark, 1000))
    rng = np.random.default_rng(9)
    chars, words = np.array(list(ms.ALPHABET)), ms.WORDS
    texts = []
    for _ in range(150):
        parts = []
        for _ in range(rng.integers(1, 7)):
            parts.append("".join(rng.choice(chars[:62], rng.integers(4, 30))) if rng.random() < 0.5 else str(rng.choice(words)))
        texts.append("x " + str(rng.choice(list("/_-="))).join(parts) + " \u00e9 token=abcdefgh")
    found = ms.find_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), table)
    for r in found.collect():
        got = [(s.start, s.end) for s in r.spans if s.kind == "markov"]
        want = plain.markov_spans(texts[r.doc_id], plain.base_spans(texts[r.doc_id]), table, ms.CLASSES, ms.ALPHABET, ms.CANDIDATE, ms.LEAST, ms.LLR_PER_PAIR)
        assert got == sorted(want), texts[r.doc_id]


def test_long_runs_take_time_in_proportion(spark):
    """One run of a million characters; time by the square would be hours."""
    rng = np.random.default_rng(1)
    long = "".join(rng.choice(np.array(list(ms.ALPHABET[:62])), 1_000_000))
    docs = spark.createDataFrame([(1, f"a {long} b"), (2, "word_" * 60_000)], "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in ms.find_secrets(docs).collect()}
    assert got == {1: [(2, 1_000_002)], 2: []} and time.time() - began < 120


def test_secret_scan_is_native(spark, sf):
    plan = lambda df: df._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan(q.op8_markov_secret_scan(spark, sf)))
    assert "Exchange" not in plan(ms.find_secrets(docs_of(spark, sf)))


def test_random_strings_joined_to_names_and_paths(spark):
    rng = np.random.default_rng(3)
    b64 = np.array(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"))
    made = lambda n, kinds=62: "".join(rng.choice(b64[:kinds], n))
    heads = {"AWS_SECRET_ACCESS_KEY=": (40, 64), "DB_CREDENTIAL=": (24, 62), "client_secret_": (24, 62), "sk_live_": (24, 62), "config/database/": (32, 62), "srv/data/customer/config/session/": (32, 62), "": (24, 62)}
    rows, where = [], {}
    for h, (n, kinds) in heads.items():
        for _ in range(60):
            where[len(rows)] = (h, 4 + len(h), n)
            rows.append((len(rows), f"see {h}{made(n, kinds)} there"))
    two = len(rows)
    rows.append((two, f"x {made(32)}/customer/account/settings/parser/{made(32)} y"))
    plain = range(two + 1, two + 401)
    ordinary = [r.text for r in ms._ordinary_samples(spark, 9000).where("id >= 8000 AND length(text) >= 20").limit(400).collect()]
    rows += zip(plain, ordinary, strict=False)
    got = {r.doc_id: [(s.start, s.end, s.match) for s in r.spans] for r in ms.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(t[a:b] == m for i, t in rows for a, b, m in got[i])
    for head in heads:
        own = [i for i, (h, *_) in where.items() if h == head]
        # the random part is covered to nine tenths
        hit = [sum(max(0, min(b, where[i][1] + where[i][2]) - max(a, where[i][1])) for a, b, _ in got[i]) >= 0.9 * where[i][2] for i in own]
        print(head, sum(hit) / len(hit))
        assert sum(hit) >= 0.9 * len(hit), head
    assert [(a, b) for a, b, _ in got[two]] == [(2, 34), (68, 100)]
    assert sum(bool(got[i]) for i in plain if i in got) <= 8


# ---- 9 URLs


def test_url_rules_against_a_plain_version(spark):
    hosts = ["net", "a.net", "example.net", "x.example.net", "notexample.net", "example.com", "EXAMPLE.com", "b.org", "org", "", "a.b.c.example.com"]
    paths = ["", "/", "/en/", "/en", "/en/x/y", "/de/", "/de/?q=/en/", "/fr/a#/b", "/fr", "//de/", "?x", "#y"]
    urls = [f"{s}://{h}{p}" for s in ("http", "HTTPS", "") for h in hosts for p in paths] + [None, "", "nothing", "a/b://net/", "x://y://net/", "http://net:80/", "http://u@a.net/\n/en/"]
    pages = spark.createDataFrame([(i % 50, u, "keep") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    rules = [*uf.RULES, ("com", "/d", "allow"), ("c.example.com", "", "block")]

    def plain(u):
        if u is None or "://" not in u:
            return "", "", None, "allow"
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", u)
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[1])
        fit = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and m[2].startswith(p)]
        best = max(fit, default=None)
        return host, m[2], best and best[2], best[3] if best else "allow"

    got = sorted((str(r.url), r.host, r.path, str(r.rule), r.verdict) for r in uf.judge(pages, uf.rule_table(spark, rules)).collect())
    assert got == sorted((str(u), a, b, str(c), d) for u in urls for a, b, c, d in [plain(u)])
    assert uf.judge(pages.where("false"), uf.rule_table(spark)).count() == 0


def test_hostile_urls_take_time_in_proportion(spark):
    pages = [(1, "http://a.net" + "/" * 100_000), (2, "http://" + "a." * 100_000 + "example.com/de/" + "x/" * 50_000), (3, "http://" + "." * 100_000)]
    began = time.time()
    got = {r.page_id: (r.rule, r.verdict) for r in uf.judge(spark.createDataFrame(pages, "page_id long, url string"), uf.rule_table(spark)).collect()}
    assert got == {1: ("net/", "block"), 2: ("example.com/de/", "block"), 3: (None, "allow")} and time.time() - began < 60
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert [r.verdict for r in uf.judge(spark.createDataFrame(pages, "page_id long, url string"), none).collect()] == ["allow"] * 3


# ---- 10 quality


def test_quality_held_out(spark, sf):
    sf = sf.replace("0.001", "0.01")
    out = q.op10_subword_quality(spark, sf).collect()
    marks = {r.doc_id: r.quality for r in docs_of(spark, sf, "labels").collect()}
    assert len(out) == docs_of(spark, sf).count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in out)
    held = [(r.predicted, marks[r.doc_id]) for r in out if r.held_out and r.doc_id in marks]
    assert np.mean([a == b for a, b in held]) > 0.93


def test_scores_do_not_depend_on_batches_and_match_counts(spark):
    rng = np.random.default_rng(4)
    texts = [" ".join("".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(1, 9))) for _ in range(rng.integers(0, 80))) for _ in range(60)] + ["", None, "é"]
    model = rng.normal(size=sq.BUCKETS + 1)
    whole = sq.score_batch(pa.array(texts), model)
    one = np.array([sq.score_batch(pa.array([t], pa.string()), model)[0] for t in texts])
    assert (whole == one).all()
    for (ids, share), s in zip(sq.document_counts(pa.array(texts)), whole, strict=True):
        assert abs(1 / (1 + np.exp(-(share @ model[ids] + model[-1]))) - s) < 1e-9
    long = " ".join(f"w{i % 7919}" for i in range(900_000))
    (ids, share), = sq.document_counts(pa.array([long]))
    assert abs(1 / (1 + np.exp(-(share @ model[ids] + model[-1]))) - sq.score_batch(pa.array([long]), model)[0]) < 1e-6


def test_quality_odd_inputs(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (None, 1), (6, None), (8, 0), (9, 0)], "doc_id long, quality int")
    model = sq.fit(odd_docs, labels)
    assert sq.score(odd_docs, model).count() == 12
    assert sq.keep_good(odd_docs, labels.where("false")).count() == 12
    assert sq.score(no_docs, sq.fit(no_docs, labels)).count() == 0


def test_long_texts_and_labels_without_text_leave_the_sample_to_others(spark):
    rows = [(i, f"good fine text {i}" if i % 2 else f"bad poor spam {i}") for i in range(60)]
    docs = "doc_id long, text string"
    marks = [(i, i % 2) for i in range(60)]
    labels = lambda extra: spark.createDataFrame(marks + extra, "doc_id long, quality int")
    want = sq.fit(spark.createDataFrame(rows, docs), labels([]), size=4000)
    long = [(i, "long " * (1000 if i % 2 else 150)) for i in range(100, 130)]  # over the bound, or over an eighth of it
    got = sq.fit(spark.createDataFrame(rows + long, docs), labels([(i, 1) for i, _ in long]), size=1200)
    assert want.any() and (got == want).all()
    lost = [(i, 1) for i in range(1000, 1400)]
    got = sq.fit(spark.createDataFrame(rows + [(i, None) for i in range(1000, 1100)], docs), labels(lost), rows=60)
    assert (got == want).all()


def test_training_against_a_plain_trainer():
    """The same steps one number at a time, and the fold into one number for each bucket."""
    rng = np.random.default_rng(6)
    texts = pa.array([" ".join(rng.choice(["aa", "bb", "cc", "dd"], 6)) for _ in range(8)])
    labels = rng.integers(0, 2, 8)
    got = sq.train(texts, labels, seed=3)
    docs, r = sq.document_counts(texts), np.random.default_rng(3)
    emb = r.uniform(-1 / sq.DIM, 1 / sq.DIM, (sq.BUCKETS, sq.DIM))
    out, bias, steps, done = [[0.0, 0.0] for _ in range(sq.DIM)], [0.0, 0.0], sq.EPOCHS * 8, 0
    for _ in range(sq.EPOCHS):
        for i in r.permutation(8):
            rate = sq.RATE * (1 - done / steps)
            done += 1
            ids, share = docs[i]
            hidden = [sum(float(s) * emb[b, k] for b, s in zip(ids, share, strict=True)) for k in range(sq.DIM)]
            z = [sum(h * o[c] for h, o in zip(hidden, out, strict=True)) + bias[c] for c in (0, 1)]
            p1 = 1 / (1 + np.exp(z[0] - z[1]))
            grad = [1 - p1 - (labels[i] == 0), p1 - (labels[i] == 1)]
            back = [o[0] * grad[0] + o[1] * grad[1] for o in out]
            for k in range(sq.DIM):
                for c in (0, 1):
                    out[k][c] -= rate * hidden[k] * grad[c]
            bias = [b - rate * g for b, g in zip(bias, grad, strict=True)]
            for b, s in zip(ids, share, strict=True):
                for k in range(sq.DIM):
                    emb[b, k] -= rate * len(ids) ** 0.5 * s * back[k]
    want = np.append(emb @ (np.array(out)[:, 1] - np.array(out)[:, 0]), bias[1] - bias[0])
    assert np.allclose(got, want)


def test_model_does_not_depend_on_the_order_of_repeated_ids(spark):
    rows = [(i, f"{'good' if i % 2 else 'bad'} text {i} {v}") for i in range(40) for v in range(3)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    fits = [sq.fit(spark.createDataFrame(x, "doc_id long, text string").repartition(n), labels) for x, n in ((rows, 1), (rows[::-1], 5))]
    assert fits[0].any() and (fits[0] == fits[1]).all()


def test_budgets_of_many_siblings_take_time_in_proportion_and_do_not_overflow(spark):
    def leaves(n, tokens):
        return spark.range(n).selectExpr("'web' AS mix_domain", "'en' AS mix_lang", "concat('s', id) AS mix_source", f"{tokens} + id * 7919 % 1000003 AS tokens", "1L AS docs")

    def took(n):
        began = time.time()
        got = mx.leaf_budgets(leaves(n, 10**10), mx.default_levels(), None, (1, 2), 4).agg(F.sum("given"), F.count("given")).first()
        assert got[1] == n and 0 <= leaves(n, 10**10).agg(F.sum("tokens")).first()[0] // 2 - got[0] < n
        return time.time() - began

    took(2000)
    assert took(160_000) < 8 * max(took(40_000), 2)
    # 10**13 tokens in each of 100,000 sources: capacity times weights passes 2**63
    got = mx.leaf_budgets(leaves(100_000, 10**13), mx.default_levels(), 10**12, (1, 2), 4).agg(F.min("given"), F.max("given")).first()
    assert tuple(got) == (10**7, 10**7)


def test_stretches_of_long_mixed_runs_take_time_in_proportion(spark):
    table = ms.train(ms.labelled_samples(spark, 1000))
    rng = np.random.default_rng(8)
    chars = np.array(list(ms.ALPHABET[:62]))

    def mixed(n):
        parts, size = [], 0
        while size < n:
            parts.append("".join(rng.choice(chars, rng.integers(18, 40))) if rng.random() < 0.5 else str(rng.choice(ms.WORDS)))
            size += len(parts[-1]) + 1
        return "_".join(parts)[:n]

    def found(text):
        began = time.time()
        row = ms.find_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string"), table).first()
        assert all(s.match == text[s.start : s.end] for s in row.spans)
        return [(s.start, s.end) for s in row.spans if s.kind == "markov"], time.time() - began

    text = mixed(70_000)
    want = plain.markov_spans(text, plain.base_spans(text), table, ms.CLASSES, ms.ALPHABET, ms.CANDIDATE, ms.LEAST, ms.LLR_PER_PAIR)
    assert found(text)[0] == sorted((a, b) for a, b, *_ in want)
    spans, seconds = found(mixed(1_000_000))
    assert len(spans) > 10_000 and seconds < 60
    many = " ".join(f"token=abc{i:07}" for i in range(30_000))
    began = time.time()
    assert len(ms.find_secrets(spark.createDataFrame([(1, many)], "doc_id long, text string"), table).first().base_spans) == 30_000
    assert time.time() - began < 40
