"""Spelling variants, main text of pages, and resampling towards a target, each against a plain version."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gneissflow.llm import html_extract as hx
from gneissflow.llm import queries as q
from gneissflow.llm import spelling_groups as sg
from gneissflow.llm import target_resample as tr

FOLD = {i: i + 32 for i in range(65, 91)}


# ---- 11 spelling variants


def plain_words(rows, every=97):
    seen = Counter()
    for doc_id, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", (text or "").translate(FOLD)):
            h = zlib.crc32(f"{'null' if doc_id is None else doc_id}:{w}".encode())
            if h % every == 0:
                at = h % len(w)
                w = w[:at] + w[at + 1 :]
            if len(w) >= 5:
                seen[w] += 1
    return {w: n for w, n in seen.items() if n >= 3}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def plain_variants(n):
    near = {w: [] for w in n}
    for a, b in itertools.combinations(n, 2):
        if abs(len(a) - len(b)) <= 1 and one_edit(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w, own in near.items():
        best = min(own, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def rows_of(df):
    return [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()]


def test_variants_of_the_documents(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = rows_of(q.op11_spelling_variants(spark, sf))
    assert len(got) == len(set(got)) and set(got) == plain_variants(plain_words(rows))


@pytest.mark.parametrize("shard, size", [(sg.SHARD, sg.ROUND_BYTES), (7, 4000), (1, 1)])
def test_shards_and_rounds_change_nothing(spark, shard, size):
    rng = random.Random(6)
    n = {"".join(rng.choice("abé🙂") for _ in range(rng.randrange(1, 7))): rng.randrange(1, 40) for _ in range(60)}
    words = spark.createDataFrame(list(n.items()), "word string, n long")
    if shard == 1:
        words, n = words.limit(6), None
        n = {r.word: r.n for r in words.collect()}
        words = spark.createDataFrame(list(n.items()), "word string, n long")
    assert set(rows_of(sg.variants(words, 2, shard, size))) == plain_variants(n)


def test_automata_on_tries(spark):
    rng = random.Random(3)
    for _ in range(40):
        letters = "abé🙂"[: rng.randint(1, 4)]
        words = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(1, rng.choice([3, 6, 40])))) for _ in range(rng.randint(1, 120))})
        i, j = sg.Trie(words, np.ones(len(words))).near(words)
        assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == [(x, y) for x in range(len(words)) for y in range(len(words)) if one_edit(words[x], words[y])]
    long = sorted(["a" * 5000, "a" * 5001, "b" + "a" * 4999, "c"])
    assert [x.tolist() for x in sg.Trie(long, np.ones(4)).near(long)] == [[0, 0, 1, 2], [1, 2, 0, 0]]


def test_forms_lead_to_the_last_word(spark):
    """A chain of 25 words, each with twice the count of the one before."""
    n = {"x" * (i + 5): 2**i for i in range(25)}
    got = {r.word: r for r in sg.variants(spark.createDataFrame(list(n.items()), "word string, n long")).collect()}
    assert {r.root for r in got.values()} == {"x" * 29} and got["x" * 29].form is None and got["x" * 5].form == "x" * 6


def test_words_odd_inputs(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = {r.word: r.n for r in sg.corpus_words(odd_docs, least_count=1).collect()}
    seen = Counter()
    for doc_id, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", (text or "").translate(FOLD)):
            h = zlib.crc32(f"{'null' if doc_id is None else doc_id}:{w}".encode())
            w = w[: h % len(w)] + w[h % len(w) + 1 :] if h % 97 == 0 else w
            if len(w) >= 5:
                seen[w] += 1
    assert got == dict(seen)
    assert sg.variants(sg.corpus_words(no_docs)).collect() == []
    with pytest.raises(ValueError):
        sg.variants(no_docs.selectExpr("text AS word", "doc_id AS n"), factor=1)


# ---- 12 main text

ARTICLE = ["A head line", "First paragraph with a link and more words that make it long enough to be text.", "No.", "Ünïcode & <signs> “here” stay.", "One Two three"]


def page(body, **more):
    return f"<!DOCTYPE html><html><head><title>T {'x' * 300}</title><style>p{{}}</style><script>var a='</p><p>no';</script></head><body>{body}</body></html>"


INNER = (
    "<h1>A head\n line</h1><p>First paragraph with a <a href=/x>link</a> and more words that <b>make it</b> long&nbsp;enough to be text.<p>No.</p>"
    "<div>&Uuml;n&#239;code &amp; &lt;signs&gt; &ldquo;here&rdquo; stay.</div><ul><li>One<li>Two</ul>three"
)
WANT = "\n\n".join([*ARTICLE[:4], "One", "Two", "three"])
NAV = "<nav><ul>" + "".join(f"<li><a href=/{i}>menu {i}</a>" for i in range(8)) + "</ul></nav>"
LONG = "Words of an advert that are as long as any paragraph of the article and should not be in it at all, never."
PAGES = {
    "article": page(f"{NAV}<div class='ad'>{LONG}</div><article>{INNER}</article><footer>{LONG}</footer>"),
    "main": page(f"<header><h2>Site</h2><p>{LONG}</p></header><main><div>{INNER}</div></main><aside>{LONG}</aside>"),
    "inside": page(f"<article>{INNER}<div id='comments'><p>{LONG}</p></div><form><p>{LONG}<input></form><div class='share-buttons'>{LONG}</div></article>"),
    "comment articles": page(f"<article>{INNER}</article><section class='comments'><article class='comment'>{LONG * 9}</article></section>"),
    "plain": page(f"{NAV}<div class='wrap'><div class='cookie-notice'>{LONG}</div><div class='text'>{INNER}</div></div><div>Imprint</div>"),
    "cut": page(f"<article>{INNER}</article>").split("</article>")[0],
    "unclosed": page(f"{NAV}<article>{INNER.replace('</div>', '').replace('</p>', '')}</article><div role=contentinfo>{LONG}</div>"),
    "scripts": page(f"<article>{INNER}<script>document.write('<p>no</p>')</script><noscript>{LONG}</noscript><template><p>{LONG}</p></template><!-- {LONG} --></article>"),
}


@pytest.mark.parametrize("kind", PAGES)
def test_main_text_of_templates(kind):
    assert hx.main_text(PAGES[kind]) == WANT


def test_pages_against_a_plain_reading_of_their_markup(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: r for r in q.op12_html_main_text(spark, sf).collect()}
    assert len(got) == pages.count()
    for r in pages.collect():
        inside = re.search("<article>(.*?)(</article>|$)", r.html or "", re.S)
        blocks = re.split("</?(?:p|h1)>", inside[1]) if inside else []
        import html

        told = [" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in blocks]
        want = "\n\n".join(b for b in told if b)
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want) and got[r.page_id].url == r.url


def test_pages_odd_inputs(spark):
    rows = [(1, None, None), (2, "u", ""), (None, "u", "   "), (3, "u", "just text"), (3, "u", "just text"), (4, "u", "<div" * 2000), (5, None, "<p>" * 20_000 + "end"),
            (6, "u", "<div>" * 20_000 + "deep"), (7, "u", "<article>" + "w " * 500_000 + "</article>"), (8, "u", "&am &amp &#0; &#x110000; </p></p>"), (9, "u", "<!-- never closed <p>x")]
    table = spark.createDataFrame([(*r, "t", 5) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = hx.extract(table)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    rows = got.collect()
    by = {r.page_id: r for r in rows}
    assert len(rows) == 11 and all(r.n_chars == len(r.text) for r in rows)
    assert [by[i].text for i in (1, 2, None)] == ["", "", ""] and by[3].text == "just text" and by[5].text == "end" and by[6].text == "deep"
    assert by[7].n_chars == 999_999 and by[8].text.startswith("&am & ")
    assert hx.extract(table.limit(0)).collect() == []


def test_clusters_part_at_the_largest_gap():
    cut = hx.threshold(np.array([1.0, 2, 1, 50, 52, 55]))
    assert 2 < cut < 50 and hx.threshold(np.array([3.0])) < 3 and hx.threshold(np.array([3.0, 3.0])) < 3
    flat = hx.smoothed(np.array([0.0, 0, 10, 0, 0]))
    assert abs(flat.sum() - 10) < 1 and flat[2] == flat.max()


# ---- 13 resampling


def plain_resample(docs, target, plan):
    words = lambda t: re.findall(tr.WORD, (t or "").translate(FOLD))
    grams = lambda w: [" ".join(w[i : i + k]) for k in range(plan.n_min, plan.n_max + 1) for i in range(len(w) - k + 1)]
    bucket = lambda f: zlib.crc32(f.encode()) % plan.buckets
    own = [(d, words(t)) for d, t in docs]
    s, t = Counter(bucket(f) for _, w in own for f in grams(w)), Counter(bucket(f) for x in target for f in grams(words(x)))
    n, m = s.total(), t.total()
    gain = {b: math.floor(1000 * math.log((t[b] + 1.0) * (n + plan.buckets) / ((s[b] + 1.0) * (m + plan.buckets)))) for b in s}
    rows = []
    for d, w in own:
        g = grams(w)
        weight = sum(gain[bucket(f)] for f in g) // len(g) if g else 0
        h = int(hashlib.sha256(f"{plan.seed}:{'null' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append((d, len(w), len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= plan.least_words), key=lambda r: (-r[4], r[0] is not None, r[0] or 0, r[3], r[2]))
    drawn = [*[(r, i) for i, r in enumerate(able[: len(able) * plan.percent // 100], 1)]]
    left = Counter(rows) - Counter(r for r, _ in drawn)
    return Counter((*r, i) for r, i in drawn) + Counter({(*r, None): k for r, k in left.items()})


def told(df):
    return Counter((r.doc_id, r.n_words, r.n_features, r.weight, r.score, r.rank) for r in df.collect())


def texts(spark, sf, name, *cols):
    return [tuple(r) for r in spark.read.parquet(f"{sf}/{name}.parquet").select(*cols).collect()]


@pytest.mark.parametrize("plan, frequent", [(tr.Plan(), tr.FREQUENT), (tr.Plan(), 40), (tr.Plan(1, 2, 500, 7, 5, 50), 1000)])
def test_resampling_against_a_plain_version(spark, sf, monkeypatch, plan, frequent):
    """Also with few frequent features, so that most meet the dictionary in the join."""
    monkeypatch.setattr(tr, "FREQUENT", frequent)
    docs, target = texts(spark, sf, "documents", "doc_id", "text"), [t for (t,) in texts(spark, sf, "benchmark", "text")]
    got = tr.resample(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet"), plan)
    assert told(got) == plain_resample(docs, target, plan)


def test_resampling_odd_inputs(spark, odd_docs, no_docs):
    plan = tr.Plan(least_words=2, percent=60)
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert told(tr.resample(odd_docs, odd_docs.limit(2), plan)) == plain_resample(docs, [t for _, t in docs[:2]], plan)
    assert told(tr.resample(odd_docs, no_docs, plan)) == plain_resample(docs, [], plan)
    assert tr.resample(no_docs, odd_docs).collect() == []
    ranks = sorted(r.rank for r in tr.resample(odd_docs, no_docs, plan).where(F.col("rank").isNotNull()).collect())
    assert ranks == list(range(1, len(ranks) + 1)) and ranks


def test_drawn_documents_are_nearer_to_the_target(spark, sf):
    got = q.op13_target_resampling(spark, sf).where("n_features >= 20")
    mean = lambda df: df.agg(F.avg("weight")).first()[0]
    assert mean(got.where("rank IS NOT NULL")) > mean(got)


# ---- 6 token streams


def test_documents_of_a_stream_do_not_depend_on_tasks(spark, sf, tmp_path):
    """The same rows of two files in 1, 3 and 8 parts, with short blocks that end inside documents."""
    from gneissflow.llm import token_scan as ts

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(90)
    docs.repartition(2, "doc_id").write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    found = [Counter(tuple(r) for r in ts.separator_scan(ts.token_streams(ts.placed(docs, n), block=500)).collect()) for n in (1, 3, 8)]
    assert found[0] == found[1] == found[2] and found[0].total() == 90
    plain = {r.doc_id: r.n_tokens for r in ts.separator_scan(ts.token_streams(docs)).collect()}
    assert plain == {r[2]: r[4] for r in found[0]}
