"""Supervised subword embeddings for document quality.

Features of a text are its words, its pairs of neighbouring words (a word that is repeated stands as
one mark, whatever the word) and its character n-grams (bytes, ``GRAMS``), hashed into ``BUCKETS``
rows of a learned embedding.  A document is the mean of its rows, padded with ``PAD`` zero rows so
that a few features of a short text decide little; a softmax layer gives the class.  Training is
numpy stochastic gradient descent on a bounded sample of labelled rows.

A document's logit difference is the mean over its features of (embedding . output weights), so the
trained model is folded into one number per bucket and scoring is a table lookup and a sum.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .textcore import _P, BLANK, LOWER, _powers, buffers, mix, runs

BUCKETS = 1 << 16
GRAMS = (3, 4)
DIM = 8
PAD = 40
EPOCHS = 5
RATE = 1.5
SAMPLE_ROWS = 4000
SAMPLE_BYTES = 24 << 20
FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3


def _features(raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(kind, position): the bucket of the feature that begins at a byte, or -1.

    ``bounds`` holds the begins of the texts and the end.  A pair of words stands at its second
    word.  Features never reach over the border of two texts.
    """
    n = len(raw)
    out = np.full((2 + len(GRAMS), n), -1, np.int32)
    if not n:
        return out
    border = np.zeros(n + 1, bool)
    border[bounds] = True
    left = np.flatnonzero(border)  # begins of texts and the end
    room = np.repeat(left[1:], np.diff(left)) - np.arange(n)  # bytes to the text's end
    inside = ~BLANK[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1] | border[1:n]
    start = np.flatnonzero(first)
    stop = inside.copy()
    stop[:-1] &= ~inside[1:] | border[1:n]
    end = np.flatnonzero(stop) + 1
    p, inv = _powers(n + 1)
    s = np.zeros(n + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * p[:-1], out=s[1:])
    word = mix((s[end] - s[start]) * inv[start] + np.uint64(99))
    out[0, start] = (word % np.uint64(BUCKETS)).astype(np.int32)
    if len(word) > 1:
        pair = np.where(word[1:] == word[:-1], np.uint64(7), mix(word[:-1] * _P + word[1:]))
        near = room[start[:-1]] - room[start[1:]] == np.diff(start)  # both in one text
        out[1, start[1:]] = np.where(near, (pair % np.uint64(BUCKETS)).astype(np.int32), -1)
    wide = raw.astype(np.uint32)
    for k, g in enumerate(GRAMS, 2):
        m = n - g + 1
        if m <= 0:
            continue
        h = np.full(m, np.uint32(g * 0x9E3779B1 & 0xFFFFFFFF), np.uint32)
        for q in range(g):
            h = (h ^ wide[q : q + m]) * np.uint32(0x01000193)
            h ^= h >> np.uint32(13)
        h *= np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(16)
        out[k, :m] = np.where(room[:m] >= g, (h % np.uint32(BUCKETS)).astype(np.int32), -1)
    return out


def document_counts(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct buckets and their shares for each text."""
    raw, offs = buffers(texts)
    got = []
    for i in range(len(offs) - 1):
        part = raw[offs[i] : offs[i + 1]]
        f = _features(part, np.array([0, len(part)]))
        f = f[f >= 0]
        ids, n = np.unique(f, return_counts=True)
        got.append((ids, (n / (PAD + n.sum())).astype(np.float64)))
    return got


def train(texts: pa.Array, labels: np.ndarray, seed: int = 7) -> np.ndarray:
    """Folded model: BUCKETS numbers and a bias (last).  No rows: a score of one half for all."""
    docs = document_counts(texts)
    rng = np.random.default_rng(seed)
    emb = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM))
    out = np.zeros((DIM, 2))
    bias = np.zeros(2)
    steps, done = max(1, EPOCHS * len(docs)), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(docs)):
            rate = RATE * (1 - done / steps)
            done += 1
            ids, share = docs[i]
            hidden = share @ emb[ids]
            z = hidden @ out + bias
            e = np.exp(z - z.max())
            grad = e / e.sum()
            grad[int(labels[i])] -= 1
            back = out @ grad
            out -= rate * np.outer(hidden, grad)
            bias -= rate * grad
            emb[ids] -= rate * len(ids) ** 0.5 * share[:, None] * back
    return np.append(emb @ (out[:, 1] - out[:, 0]), bias[1] - bias[0])


def score_batch(texts: pa.Array, model: np.ndarray) -> np.ndarray:
    """P(label 1) of each text."""
    raw, offs = buffers(texts)
    table, bias = np.append(model[:-1], 0.0), model[-1]  # index -1: no feature
    out = np.empty(len(offs) - 1)
    for i, j in runs(offs):
        part, own = raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        if len(part) > 4 << 20:  # one long text, in pieces that overlap by the longest n-gram
            out[i] = _long(part, table)
            continue
        f = _features(part, own)
        value, count = table[f].sum(axis=0), (f >= 0).sum(axis=0)
        full = np.flatnonzero(np.diff(own))
        out[i:j] = 0.0
        if len(full):
            out[i + full] = np.add.reduceat(value, own[full]) / (PAD + np.add.reduceat(count, own[full]))
    return 1 / (1 + np.exp(-np.clip(out + bias, -500, 500)))


def _long(part: np.ndarray, table: np.ndarray, step: int = 1 << 20) -> float:
    """Mean over the features of one text, in pieces that end at blanks.

    A piece is read from the word before it (for the first pair) to the end of the n-grams that
    begin in it; only features that begin in it count.
    """
    total, n, a = 0.0, 0, 0
    while a < len(part):
        b = min(len(part), a + step)
        while b < len(part) and not BLANK[part[b - 1]]:
            b += 1
        back = a
        while back and BLANK[part[back - 1]]:
            back -= 1
        while back and not BLANK[part[back - 1]]:
            back -= 1
        end = min(len(part), b + max(GRAMS) - 1)
        f = _features(part[back:end], np.array([0, end - back]))[:, a - back : b - back]
        total += table[f].sum()
        n += int((f >= 0).sum())
        a = b
    return total / (PAD + n)


def fold_of(col: str = "doc_id") -> F.Column:
    """crc32 of the id as text, modulo ``FOLDS``; a null id: 0."""
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")), F.lit(0)) % FOLDS


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES) -> np.ndarray:
    """The model from at most ``rows`` labelled rows and ``size`` bytes of text.

    The sample is the labelled documents outside the held-out fold in the order of a hash of their id;
    of two labels for one id the larger counts, of two texts the one with the smaller hash.  Texts over
    an eighth of ``size`` come after the others, and those over ``size`` are left out, so that a long
    text shuts out none but long ones.  Null labels, ids and texts are left out.  One task trains, so
    neither texts nor counts come to the driver, only the model (BUCKETS numbers).
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("__g_id"), "quality").where("__g_id IS NOT NULL AND quality IS NOT NULL")
    marks = marks.where(fold_of("__g_id") != HELD_OUT).groupBy("__g_id").agg(F.max("quality").cast("int").alias("_y"))
    marks = marks.withColumn("_o", F.xxhash64("__g_id", F.lit(3)))
    text = F.col("text").cast("string")
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("_n"))
    src = src.where(F.col("_n") <= size)
    marks = marks.join(src.select(F.col("doc_id").alias("__g_id")), "__g_id", "left_semi").orderBy("_o", "__g_id").limit(rows)
    got = src.join(F.broadcast(marks), F.col("doc_id") == F.col("__g_id"))  # broadcast: ``rows`` rows at most
    own = F.min_by(F.struct("text", "_n", "_y", "_o"), F.struct(F.xxhash64("text"), "_n"))
    got = got.groupBy("doc_id").agg(own.alias("r")).select("doc_id", "r.*")
    so_far = F.sum("_n").over(Window.orderBy(F.col("_n") > size // 8, "_o", "doc_id"))
    got = got.withColumn("_b", so_far).where(F.col("_b") <= size)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("doc_id")
        model = train(table["text"].combine_chunks(), np.clip(table["_y"].to_numpy(), 0, 1))
        return pa.table({"model": pa.array([model.tobytes()], pa.binary())})

    made = got.select(F.lit(0).alias("_one"), "doc_id", "text", "_y").groupBy("_one").applyInArrow(run, "model binary").collect()
    return np.frombuffer(bytes(made[0]["model"])).copy() if made else np.zeros(BUCKETS + 1)


def score(docs: DataFrame, model: np.ndarray) -> DataFrame:
    """doc_id, text_hash, held_out, score, predicted for every row; empty or null texts get the bias."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = pa.array(score_batch(batch.column(2), shared.value))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), scores], names=["doc_id", "text_hash", "score"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))
    out = src.mapInArrow(run, "doc_id long, text_hash long, score double")
    predicted = (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    return out.select("doc_id", "text_hash", (fold_of() == HELD_OUT).alias("held_out"), "score", predicted)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` that the classifier does not reject; all columns as they were, one pass, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(score_batch(batch.column(text), shared.value) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
