"""Importance resampling of documents towards a target distribution, by a distinct-feature dictionary.

1. Every n-gram string of the documents and of the target texts is counted once over the whole
   corpus.  Each distinct string is hashed once into one of ``buckets`` buckets, and the counts are
   added up by bucket.
2. A bucket's gain is the log ratio of its share in the target and in the documents, add-one
   smoothed, in thousandths.
3. The gains are joined back to the feature counts of each document.  Features that make up a
   ``FREQUENT``-th of all occurrences are fewer than ``FREQUENT`` and at most ``FREQUENT_BYTES``
   long: that part of the dictionary has a bounded size, goes to every task, and covers most of a
   text.  The others meet the dictionary in a join on the string, in which no key is hot.
4. A document's score is its mean gain plus a seeded Gumbel variate of its id; the highest scores
   are drawn.

All sums are sums of whole numbers, so no order of addition shows in the result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.rank import ranked
from ..scratch import drop, materialize

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
FREQUENT = 1 << 17
FREQUENT_BYTES = 48
FLUSH = 1 << 18  # distinct strings that a task holds before it passes their counts on
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = {ord(u): ord(v) for u, v in zip(UPPER, LOWER, strict=True)}
_word = re.compile(WORD)


@dataclass(frozen=True)
class Plan:
    """Lengths of n-grams, buckets, seed, words a document needs to be drawn, and the share drawn."""

    n_min: int = 1
    n_max: int = 1
    buckets: int = 10_000
    seed: int = 2024
    least_words: int = 20
    percent: int = 10


def _features(text: str | None, plan: Plan) -> tuple[int, Counter[str]]:
    """The number of words of a text, and its runs of n_min to n_max words with their counts."""
    words = _word.findall((text or "").translate(_FOLD))
    seen: Counter[str] = Counter()
    for k in range(plan.n_min, plan.n_max + 1):
        seen.update(words if k == 1 else (" ".join(words[i : i + k]) for i in range(len(words) - k + 1)))
    return len(words), seen


def feature_counts(texts: DataFrame, plan: Plan) -> DataFrame:
    """feature, n of text(text): each task adds up before anything is shuffled."""

    def told(seen: Counter[str]) -> pa.RecordBatch:
        cols = [pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())]
        return pa.RecordBatch.from_arrays(cols, names=["feature", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0):
                seen.update(_features(text.as_py(), plan)[1])
                if len(seen) > FLUSH:
                    yield told(seen)
                    seen = Counter()
        yield told(seen)

    return texts.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "feature string, n long")


def dictionary(docs: DataFrame, target: DataFrame, plan: Plan) -> DataFrame:
    """feature, bucket, n (in ``docs``), m (in ``target``): one row for each distinct string.

    A frequent string is a few rows of each task before the shuffle, however often it occurs.
    """
    a = feature_counts(docs, plan).select("feature", "n", F.lit(0).cast("long").alias("m"))
    b = feature_counts(target, plan).select("feature", F.lit(0).cast("long").alias("n"), F.col("n").alias("m"))
    counted = a.unionByName(b).groupBy("feature").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    return counted.select("feature", (F.crc32(F.col("feature").cast("binary")) % plan.buckets).cast("int").alias("bucket"), "n", "m")


def gains(entries: DataFrame, plan: Plan) -> DataFrame:
    """bucket, gain of the buckets that any string falls into: at most ``buckets`` rows."""
    by = entries.groupBy("bucket").agg(F.sum("n").alias("s"), F.sum("m").alias("t"))
    total = by.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("all_s"), F.coalesce(F.sum("t"), F.lit(0)).alias("all_t"))
    d = lambda c, more: (F.col(c) + more).cast("double")
    ratio = d("t", 1) * d("all_s", plan.buckets) / (d("s", 1) * d("all_t", plan.buckets))
    return by.crossJoin(F.broadcast(total)).select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))  # one row


_COUNTED = "doc_id long, n_words long, n_features long, known long, rest array<struct<feature:string,n:int>>"


def _counter(plan: Plan, known):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain_of = known.value.get
        for batch in batches:
            n_words, n_features, sums, features, counts, ends = [], [], [], [], [], [0]
            for text in batch.column(1):
                size, seen = _features(text.as_py(), plan)
                total = 0
                for feature, n in seen.items():
                    gain = gain_of(feature)
                    if gain is None:
                        features.append(feature)
                        counts.append(n)
                    else:
                        total += n * gain
                n_words.append(size)
                n_features.append(seen.total())
                sums.append(total)
                ends.append(len(features))
            pairs = pa.StructArray.from_arrays([pa.array(features, pa.string()), pa.array(counts, pa.int32())], ["feature", "n"])
            rest = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)
            cols = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_features, pa.int64()), pa.array(sums, pa.int64()), rest]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_words", "n_features", "known", "rest"])

    return run


def weights(docs: DataFrame, target: DataFrame, plan: Plan) -> DataFrame:
    """row, doc_id, n_words, n_features, weight: one row for each row of ``docs``."""
    spark = docs.sparkSession
    entries = materialize(dictionary(docs, target, plan), "dictionary")
    by_bucket = materialize(gains(entries, plan), "gains")
    total = entries.agg(F.sum("n")).first()[0] or 0
    gained = entries.where("n > 0").join(F.broadcast(by_bucket), "bucket")  # at most one row for each bucket
    common = (F.col("n") * FREQUENT > total) & (F.octet_length("feature") <= FREQUENT_BYTES)
    top = gained.where(common).select("feature", "gain").toArrow()  # fewer than FREQUENT rows
    known = spark.sparkContext.broadcast(dict(zip(top["feature"].to_pylist(), top["gain"].to_pylist(), strict=True)))
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = src.mapInArrow(_counter(plan, known), _COUNTED).withColumn("row", F.monotonically_increasing_id())
    counted = materialize(counted, "counted")
    known.destroy()
    others = counted.select("row", F.explode("rest").alias("f")).select("row", F.col("f.feature").alias("feature"), F.col("f.n").alias("n"))
    others = others.join(gained.where(~common).select("feature", "gain"), "feature")
    others = others.groupBy("row").agg(F.sum(F.col("n") * F.col("gain")).alias("other"))
    out = counted.drop("rest").join(others, "row", "left").withColumn("sum", F.col("known") + F.coalesce("other", F.lit(0)))
    n = F.nullif("n_features", F.lit(0))
    mean = F.expr("(sum - pmod(sum, nullif(n_features, 0))) div nullif(n_features, 0)")
    out = materialize(out.select("row", "doc_id", "n_words", "n_features", F.when(n.isNull(), 0).otherwise(mean).cast("long").alias("weight")), "weights")
    drop(entries, by_bucket, counted)
    return out


def gumbel(doc_id: str, seed: int) -> Column:
    """Seeded variate of an id, in thousandths: floor(-1000 ln(-ln u)) with u from SHA-256."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(docs: DataFrame, target: DataFrame, plan: Plan | None = None) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank: one row for each row of ``docs``.

    docs(doc_id, text), target(text); other columns are not read.  Null and empty texts, and texts
    without words, have no features and weight 0.  Of the rows with ``least_words`` words the
    ``percent`` with the highest scores are drawn and ranked from 1; the others have no rank.  Ties go
    to the smaller doc_id, then the smaller weight and number of features; a null id is drawn as the
    text ``null`` and comes first among ties.  Repeated rows are drawn on their own, one after the
    other.  An empty table gives no rows; an empty target makes rare buckets gain.
    """
    plan = plan or Plan()
    scored = weights(docs, target, plan).withColumn("score", F.col("weight") + gumbel("doc_id", plan.seed))
    able = scored.where(F.col("n_words") >= plan.least_words)
    drawn = able.count() * plan.percent // 100
    order = [F.desc("score"), F.asc("doc_id"), F.asc("weight"), F.asc("n_features")]
    place = ranked(able.select("row", "score", "doc_id", "weight", "n_features"), "row", order, "rank").where(F.col("rank") <= drawn)
    out = scored.join(place, "row", "left")
    return out.select("doc_id", "n_words", "n_features", "weight", "score", F.col("rank").cast("long").alias("rank"))


def oracle_sql(plan: Plan | None = None) -> str:
    """DuckDB SQL of the query over ``documents`` and ``benchmark``, for single words; CRC-32 by its table."""
    p = plan or Plan()
    table = "list_transform(range(0, 256), lambda n: list_reduce(range(0, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n))"
    crc = "xor(list_reduce(b, lambda c, y: xor(c >> 8, t[1 + (xor(c, y) & 255)]), 4294967295), 4294967295)"
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}')"
    return f"""
WITH d AS (SELECT doc_id, {words} AS ws FROM documents),
x AS (SELECT doc_id, unnest(ws) AS f FROM d),
y AS (SELECT unnest({words}) AS f FROM benchmark),
c AS (SELECT f, sum(n) AS n, sum(m) AS m FROM (SELECT f, 1 AS n, 0 AS m FROM x UNION ALL SELECT f, 0, 1 FROM y) GROUP BY f),
k AS (SELECT f, n, m, {crc} % {p.buckets} AS b FROM (SELECT *, list_transform(regexp_extract_all(hex(encode(f)), '..'), lambda h: CAST('0x' || h AS BIGINT)) AS b FROM c), (SELECT {table} AS t)),
s AS (SELECT b, sum(n) AS s, sum(m) AS t FROM k GROUP BY b),
g AS (SELECT b, CAST(floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + {p.buckets})::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + {p.buckets})::DOUBLE))) AS BIGINT) AS gain FROM s),
w AS (SELECT doc_id, CAST(floor(sum(gain)::DOUBLE / count(*)) AS BIGINT) AS weight FROM x JOIN k USING (f) JOIN g USING (b) GROUP BY doc_id),
o AS (
  SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{p.seed}:' || d.doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM d LEFT JOIN w USING (doc_id)),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, {p.percent} * count(*) OVER () // 100 AS drawn FROM o WHERE n_features >= {p.least_words})
SELECT o.doc_id, n_features, weight, score, CASE WHEN rank <= drawn THEN rank END AS rank FROM o LEFT JOIN r USING (doc_id)"""
