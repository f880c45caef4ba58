"""Spelling variants of words, by Levenshtein automata run over trie shards.

1. The words of the corpus are counted.
2. In code-point order they are cut into shards of ``SHARD`` words, and each shard becomes a compact
   trie: edges sorted by (node, character), so that a child is found by binary search and the
   children of a node are one slice.
3. Shards are broadcast in rounds of at most ``ROUND_BYTES``.  Every task runs the distance-one
   automata of its words over every shard of the round, depth first: a stack holds blocks of states
   (word, place in it, trie node, whether the error is spent), and the deepest block comes first.
   At an unspent state a character may match, be replaced, be inserted or be deleted; at a spent
   one it must match.  A spent state at the end of its word, on a node that ends a word, accepts.
4. Each task reduces the accepted neighbours of a word to their number and the best form; rounds are
   added up by word.  Pairs are never emitted.
5. A form has at least twice its word's count, so ways along forms are short and have no cycle; the
   last word of each is found by doubling steps.

A word meets a shard at the root at least, so the steps grow with words times shards; all but the
shards that share its first letters end at once.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.rank import ranked
from ..operators.skew import hot_keys, salted_join
from ..scratch import drop, materialize

RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = {ord(u): ord(v) for u, v in zip(UPPER, LOWER, strict=True)}
FLUSH = 1 << 18  # distinct words that a task holds before it passes their counts on
SHARD = 1 << 16  # words of a shard
ROUND_BYTES = 32 << 20  # bytes of the shards that are broadcast together
LETTER_BITS = 21  # of a code point
BLOCK = 4096  # words whose automata run together
WORDS_A_TASK = 20_000


def corpus_words(docs: DataFrame, drop_every: int = 97, least_length: int = 5, least_count: int = 3, run: str = RUN) -> DataFrame:
    """word, n of the words of whole texts, A-Z in lower case.

    Where ``drop_every`` divides the CRC-32 of ``<doc_id>:<word>``, the word loses one code point, the
    CRC modulo its length (a reproducible misspelling; 0: none).  A null id reads ``null``, a null
    text has no words.
    """
    pattern = re.compile(run)

    def told(seen: Counter[str]) -> pa.RecordBatch:
        cols = [pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())]
        return pa.RecordBatch.from_arrays(cols, names=["word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ahead = zlib.crc32(f"{'null' if doc_id is None else doc_id}:".encode())
                own = Counter(pattern.findall((text.as_py() or "").translate(_FOLD)))
                for word, n in own.items():
                    if len(word) < least_length:  # a deletion makes it no longer
                        continue
                    if drop_every:
                        h = zlib.crc32(word.encode(), ahead)
                        if h % drop_every == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < least_length:
                                continue
                    seen[word] += n
                if len(seen) > FLUSH:
                    yield told(seen)
                    seen = Counter()
        yield told(seen)

    own = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


# ---- a trie shard


def _letters(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points one word after the other, each word followed by -1; where each begins; lengths."""
    size = np.array([len(w) for w in words], np.int64)
    begin = np.cumsum(size + 1) - size - 1
    flat = np.full(int((size + 1).sum()), -1, np.int64)
    letter = np.ones(len(flat), bool)
    letter[begin + size] = False
    flat[letter] = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    return flat, begin, size


def _common(flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """How many first letters each word shares with the word before it."""
    out = np.zeros(len(size), np.int64)
    live = np.arange(1, len(size))
    width = 8
    while len(live):
        far = np.minimum(size[live - 1], size[live]) - out[live]
        step = np.arange(min(width, int(far.max(initial=0)) + 1))
        ok = step < far[:, None]
        at = np.where(ok, out[live][:, None] + step, 0)
        same = ok & (flat[begin[live][:, None] + at] == flat[begin[live - 1][:, None] + at])
        n = np.argmin(np.pad(same, ((0, 0), (0, 1))), axis=1)
        out[live] += n
        live = live[n == len(step)]
        width *= 4  # few words share more
    return out


class Trie:
    """Trie of distinct words in code-point order, each with its count."""

    def __init__(self, words: list[str], n: np.ndarray):
        flat, begin, size = _letters(words)
        common = _common(flat, begin, size)
        fresh = size - common  # nodes that a word adds: those of depth common + 1 up to size
        word = np.repeat(np.arange(len(words)), fresh)
        depth = np.arange(len(word)) - np.repeat(np.cumsum(fresh) - fresh, fresh) + common[word]
        order = np.argsort(depth, kind="stable")  # nodes by level; 0 is the root
        node = np.empty(len(word), np.int64)
        node[order] = np.arange(1, len(word) + 1)
        first = np.cumsum(fresh) - fresh  # a word's first new node
        parent = np.concatenate([[0], node])[np.arange(len(word))]  # the node before, in the same word
        path: list[tuple[int, int]] = []  # (depth from which, word that added the nodes) along the last word
        for i, d in enumerate(common.tolist()):
            while path and path[-1][0] >= d:
                path.pop()
            if fresh[i]:
                parent[first[i]] = node[first[path[-1][1]] + d - 1 - path[-1][0]] if path else 0
                path.append((d, i))
        self.keys = ((parent << LETTER_BITS) | flat[begin[word] + depth])[order]  # child i + 1 by edge i: parent, letter
        self.first = np.searchsorted(self.keys, np.arange(len(word) + 2) << LETTER_BITS).astype(np.int32)
        self.word = np.full(len(word) + 1, -1, np.int32)
        self.word[node[first + fresh - 1]] = np.arange(len(words))
        self.n = np.asarray(n, np.int64)
        self.words = words

    @classmethod
    def load(cls, row: dict) -> Trie:
        out = cls.__new__(cls)
        for name, kind in (("keys", np.int64), ("first", np.int32), ("word", np.int32), ("n", np.int64)):
            setattr(out, name, np.frombuffer(row[name], kind))
        out.words = row["words"]
        return out

    def child(self, node: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The child by a letter, or 0."""
        want = (node << LETTER_BITS) | letter
        at = np.searchsorted(self.keys, want)
        hit = at < len(self.keys)
        hit[hit] = self.keys[at[hit]] == want[hit]
        return np.where(hit, at + 1, 0)

    def near(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(i, j): word i of ``words`` and word j of the shard differ by exactly one edit; each pair once."""
        got = [np.zeros((2, 0), np.int64)]
        for a in range(0, len(words), BLOCK):
            i, j = self._near(*_letters(words[a : a + BLOCK]))
            got.append(np.stack([i + a, j]))
        return tuple(np.concatenate(got, axis=1))

    def _near(self, flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start = np.arange(len(size))
        stack = [(start, np.zeros_like(start), np.zeros_like(start), False)]
        found = [np.zeros(0, np.int64)]
        while stack:
            q, at, node, spent = stack.pop()
            if spent:
                done = at == size[q]
                ends = self.word[node[done]]
                found.append((q[done] * len(self.words) + ends)[ends >= 0])
                q, at, node = q[~done], at[~done], node[~done]
                to = self.child(node, flat[begin[q] + at])
                live = to > 0
                if live.any():
                    stack.append((q[live], at[live] + 1, to[live], True))
                continue
            lo, n = self.first[node], self.first[node + 1] - self.first[node]
            state = np.repeat(np.arange(len(q)), n)
            edge = np.arange(len(state)) - np.repeat(np.cumsum(n) - n, n) + lo[state]
            letter = self.keys[edge] & ((1 << LETTER_BITS) - 1)
            own = flat[begin[q] + at]
            match = letter == own[state]
            other = ~match  # an insertion before the same letter is one after it
            swap = other & (at[state] < size[q[state]])
            cut = (at < size[q]) & (own != flat[begin[q] + np.minimum(at + 1, size[q])])  # of a run, the last letter
            if match.any():
                stack.append((q[state[match]], at[state[match]] + 1, edge[match].astype(np.int64) + 1, False))
            spent_q = np.concatenate([q[state[swap]], q[state[other]], q[cut]])  # replaced, inserted, deleted
            if len(spent_q):
                spent_at = np.concatenate([at[state[swap]] + 1, at[state[other]], at[cut] + 1])
                spent_node = np.concatenate([edge[swap] + 1, edge[other] + 1, node[cut]]).astype(np.int64)
                stack.append((spent_q, spent_at, spent_node, True))
        pair = np.unique(np.concatenate(found))
        return pair // max(len(self.words), 1), pair % max(len(self.words), 1)


# ---- on Spark


_SHARD = "shard long, keys binary, first binary, word binary, n binary, words array<string>"


def _build(table: pa.Table) -> pa.Table:
    table = table.sort_by("word")
    words = table["word"].to_pylist()
    t = Trie(words, table["n"].to_numpy())
    cols = {k: pa.array([getattr(t, k).tobytes()], pa.binary()) for k in ("keys", "first", "word", "n")}
    return pa.table({"shard": pa.array([table["shard"][0].as_py()], pa.int64()), **cols, "words": pa.array([words], pa.list_(pa.string()))})


def shards(words: DataFrame, size: int = SHARD) -> DataFrame:
    """One trie for each ``size`` words in code-point order; words(word, n) are distinct."""
    placed = ranked(words.select("word", "n"), "word", [F.asc("word")], "_place").withColumn("shard", F.expr(f"(_place - 1) div {size}"))
    return words.join(placed.drop("_place"), "word").select("shard", "word", "n").groupBy("shard").applyInArrow(_build, _SHARD)


def _reducer(tries):
    """Per word: the neighbours in the broadcast shards as their number and the best form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [Trie.load(row) for row in tries.value]
        for batch in batches:
            words = batch.column(0).to_pylist()
            number, best = np.zeros(len(words), np.int64), [None] * len(words)
            for t in own:
                i, j = t.near(words)
                number += np.bincount(i, minlength=len(words))
                # the largest count first, then code-point order: that of the shard
                order = np.lexsort((j, -t.n[j], i))
                head = order[np.unique(i[order], return_index=True)[1]]
                for x, y in zip(i[head].tolist(), j[head].tolist(), strict=True):
                    new = (-int(t.n[y]), t.words[y])
                    best[x] = new if best[x] is None or new < best[x] else best[x]
            hit = np.flatnonzero(number)
            cols = [
                pa.array([words[x] for x in hit], pa.string()), pa.array(number[hit], pa.int64()),
                pa.array([-best[x][0] for x in hit], pa.int64()), pa.array([best[x][1] for x in hit], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(cols, names=["word", "n_near", "best_n", "best"])

    return run


def neighbours(words: DataFrame, tries: DataFrame, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """word, n_near, best_n, best of the words with any neighbour: rounds of broadcast shards, added up.

    The driver holds the shards of one round, never more than ``round_bytes`` or one shard.
    """
    spark = words.sparkSession
    size = sum((F.octet_length(c) for c in ("keys", "first", "word", "n")), F.octet_length(F.array_join("words", "")))
    rounds, held = [[]], 0
    for shard, b in sorted((r[0], r[1]) for r in tries.select("shard", size).collect()):
        if rounds[-1] and held + b > round_bytes:
            rounds.append([])
            held = 0
        rounds[-1].append(shard)
        held += b
    done = []
    for some in rounds:
        own = tries.where(F.col("shard").between(some[0], some[-1])) if some else tries
        sent = spark.sparkContext.broadcast(own.drop("shard").toArrow().to_pylist())
        done.append(materialize(words.select("word").mapInArrow(_reducer(sent), "word string, n_near long, best_n long, best string"), "near"))
        sent.destroy()
    out = done[0]
    for one in done[1:]:
        out = out.unionByName(one)
    best = F.min(F.struct((-F.col("best_n")).alias("m"), "best")).alias("b")
    return out.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("b.m")).alias("best_n"), "b.best")


def _roots(forms: DataFrame) -> DataFrame:
    """word, root: the last word along the forms, by doubling steps; counts double with each form, so
    six rounds are enough for any way there can be."""
    up = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        far = up.select(F.col("word").alias("root"), F.col("root").alias("far"))
        new = salted_join(up, far, "root", "word", hot_keys(up, "root"), "left")
        new = materialize(new.select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")), "roots")
        drop(up)
        up = new
        if up.where("moved").isEmpty():
            return up.select("word", "root")


def variants(words: DataFrame, factor: int = 2, shard_words: int = SHARD, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """word, form, root, n, n_near, form_n of words(word, n), which are distinct and not null.

    Near words differ by exactly one inserted, deleted or replaced code point.  A word's form is its
    near word of the largest n, ties to the smaller in code-point order, if that n is at least
    ``factor`` (2 or more) times the word's own; else null, with form_n null.  root follows forms to
    the last one.  Columns other than word and n are not read; no words give no rows.
    """
    if factor < 2:
        raise ValueError("factor: 2 or more, so that counts grow along the forms")
    words = materialize(words.select("word", F.col("n").cast("long").alias("n")), "words")
    tasks = max(words.sparkSession.sparkContext.defaultParallelism, -(-words.count() // WORDS_A_TASK))
    tries = materialize(shards(words, shard_words), "tries")
    near = neighbours(words.repartition(tasks, "word"), tries, round_bytes)
    at = words.join(near, "word", "left")
    ok = F.col("best_n") >= factor * F.col("n")
    at = at.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(ok, F.col("best")).alias("form"), F.when(ok, F.col("best_n")).alias("form_n"))
    at = materialize(at, "forms")
    out = at.join(_roots(at.where("form IS NOT NULL")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: DuckDB SQL of variants(corpus_words(documents)): words that share a deletion place by place.
ORACLE_SQL = rf"""
WITH t AS (SELECT list_transform(range(0, 256), lambda n: list_reduce(range(0, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS t),
x AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS r FROM documents),
o AS (SELECT doc_id, r, count(*) AS n FROM x WHERE length(r) >= 5 GROUP BY ALL),
b AS (SELECT *, list_transform(regexp_extract_all(hex(encode(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || r)), '..'), lambda h: CAST('0x' || h AS BIGINT)) AS b FROM o),
h AS (SELECT r, n, xor(list_reduce(b, lambda c, y: xor(c >> 8, t[1 + (xor(c, y) & 255)]), 4294967295), 4294967295) AS h FROM b, t),
c AS (SELECT CASE WHEN h % 97 = 0 THEN substr(r, 1, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS word, n FROM h),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM c WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
i AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w),
v AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS d FROM i),
p AS (SELECT a.word AS a, b.word AS b FROM v a JOIN v b ON a.d = b.d AND a.i = b.i AND a.word <> b.word
      UNION SELECT v.word, w.word FROM v JOIN w ON v.d = w.word UNION SELECT w.word, v.word FROM v JOIN w ON v.d = w.word),
q AS (SELECT a AS word, count(*) AS n_near, min({{'m': -n, 'b': b}}) AS f FROM p JOIN w ON w.word = b GROUP BY a),
f AS (SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -f.m >= 2 * n THEN f.b END AS form, CASE WHEN -f.m >= 2 * n THEN -f.m END AS form_n FROM w LEFT JOIN q USING (word)),
u AS (WITH RECURSIVE u(word, root, k) AS (SELECT word, word, 0 FROM f UNION ALL SELECT u.word, f.form, k + 1 FROM u JOIN f ON f.word = u.root WHERE f.form IS NOT NULL) SELECT word, arg_max(root, k) AS root FROM u GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM f JOIN u USING (word)"""
