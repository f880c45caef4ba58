"""Registered queries of the training-data operators, and their SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_worker_path, spread
from . import bbit_minhash, hilbert_shard, html_extract, markov_secrets, mixing, patience_license, rp_forest, spaced_seeds, spelling_groups
from . import subword_quality, target_resample, token_scan, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ensure_worker_path(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(_table(spark, sf_dir, "documents"))


def op1_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, item_tokens, matched, run, doc_start of each test item found in a document."""
    found = spaced_seeds.overlaps(_documents(spark, sf_dir), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "item_tokens", "matched", "run", "doc_start")


def op2_patience_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place of a licence text in every document."""
    return patience_license.scan(_documents(spark, sf_dir))


def op3_rp_forest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors found for each vec_id divisible by 20."""
    return rp_forest.nearest(_table(spark, sf_dir, "embeddings"))


def op4_hierarchical_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, epochs and token prefixes that make up half of all tokens in target weights."""
    return mixing.mix(_table(spark, sf_dir, "documents")).drop("text_hash")


def op5_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 8 shards of near-equal bytes along a Hilbert curve."""
    out = hilbert_shard.shards(_table(spark, sf_dir, "documents"), 8)
    law, grown = F.lit("bytes").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    return out.select("doc_id", "size", "text_crc32", law, "shard", "slot", grown, "curve")


def op6_separator_scan_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count of each document, found by the separators of the token streams."""
    return token_scan.separator_scan(token_scan.token_streams(token_scan.placed(_table(spark, sf_dir, "documents"))))


def op7_bbit_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of each document: 3-word shingles, similarity of 0.85."""
    found, _ = bbit_minhash.near_duplicates(_documents(spark, sf_dir), 3, 85)
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept")
    return found.select("doc_id", "n_shingles", "component_id", kept)


def op8_markov_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in each document, by patterns and by the models."""
    docs = spread(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = markov_secrets.find_secrets(docs)
    n = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    digest = F.sha2(markov_secrets.told("base_spans").cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), digest, markov_secrets.told("spans").alias("spans"))


def op9_url_prefix_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, deciding rule and verdict of each page."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, url_filter.rule_table(spark)).select("page_id", "host", "path", "rule", "verdict")


def op10_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of each document."""
    docs = _documents(spark, sf_dir)
    model = subword_quality.fit(docs, _table(spark, sf_dir, "labels"))
    return subword_quality.score(docs, model).drop("text_hash")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form and root of each frequent word of the documents."""
    return spelling_groups.variants(spelling_groups.corpus_words(_documents(spark, sf_dir)))


def op12_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of each page."""
    return html_extract.extract(spread(_table(spark, sf_dir, "pages")))


def op13_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and rank of each document, drawn towards the benchmark's words."""
    return target_resample.resample(_documents(spark, sf_dir), _table(spark, sf_dir, "benchmark")).drop("n_words")


QUERIES = {f.__name__: f for f in (
    op1_spaced_seed_decontamination, op2_patience_license_scan, op3_rp_forest_neighbours, op4_hierarchical_mixture, op5_hilbert_shards,
    op6_separator_scan_tokens, op7_bbit_minhash_neardup, op8_markov_secret_scan, op9_url_prefix_filter, op10_subword_quality,
    op11_spelling_variants, op12_html_main_text, op13_target_resampling,
)}

ORACLE_SQL = {
    "op1_spaced_seed_decontamination": spaced_seeds.oracle_sql(),
    "op5_hilbert_shards": hilbert_shard.oracle_sql(),
    "op7_bbit_minhash_neardup": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS sh FROM w),
n AS (SELECT doc_id, CAST(len(sh) AS BIGINT) AS n FROM s), x AS (SELECT doc_id, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
u AS (SELECT a AS x, b AS y FROM l UNION SELECT b, a FROM l UNION SELECT doc_id, doc_id FROM n),
r(x, y) AS (SELECT x, y FROM u UNION SELECT r.x, u.y FROM r JOIN u ON r.y = u.x)
SELECT doc_id, n AS n_shingles, min(y) AS component_id, doc_id = min(y) AS kept FROM n JOIN r ON x = doc_id GROUP BY 1, 2""",
    "op4_hierarchical_mixture": mixing.ORACLE_SQL,
    "op11_spelling_variants": spelling_groups.ORACLE_SQL,
    "op12_html_main_text": html_extract.ORACLE_SQL,
    "op13_target_resampling": target_resample.oracle_sql(),
    "op9_url_prefix_filter": r"""
WITH p AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
rules(rh, rp, rv) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
best AS (
  SELECT page_id, host, path, max({'n': length(rh || rp), 'rule': rh || rp, 'v': rv}) AS b
  FROM p LEFT JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
  GROUP BY page_id, host, path)
SELECT page_id, host, path, CASE WHEN b.n IS NOT NULL THEN b.rule END AS rule, coalesce(b.v, 'allow') AS verdict FROM best""",
}
