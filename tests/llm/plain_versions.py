"""Plain versions of the training-data operators, over all pairs and by plain Python."""

import re

import numpy as np

from gneissflow.llm import rp_forest as rp
from gneissflow.llm import spaced_seeds as ss


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def nearest(ids, vecs, k, every):
    """query id -> its k nearest ids."""
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        s = rp.exact_scores(np.broadcast_to(vecs[i], vecs.shape), vecs)
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[i]]
        out[int(ids[i])] = [int(ids[j]) for j in order[:k]]
    return out


def near_classes(rows, k, percent):
    """doc_id -> component_id over all pairs."""
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    up = {i: i for i, _ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {i: find(i) for i in up}


def leaks(docs, items):
    """(doc_id, item_id) over all pairs and all diagonals."""

    def toks(t):
        return re.findall(r"[0-9A-Za-z\x80-\U0010FFFF]+", (t or "").lower())

    out = set()
    for item, text in items:
        w = toks(text)
        least = ss.MIN_SHARE if len(w) >= ss.SPAN else (1, 1)
        for doc, t in docs if w else ():
            d = toks(t)
            for diag in range(-len(w) + 1, len(d)):
                same = [i + diag >= 0 and i + diag < len(d) and d[i + diag] == w[i] for i in range(len(w))]
                run = best = 0
                for s in same:
                    run = max(0, run + (1 if s else -ss.MISS))
                    best = max(best, run)
                if sum(same) * least[1] >= len(w) * least[0] or best >= ss.MIN_RUN:
                    out.add((doc, item))
    return out


def hilbert_index(point, order):
    """Index on the curve by rotating sub-cubes on plain ints."""
    x, n = list(point), len(point)
    for plane in range(order - 1, 0, -1):
        q, low = 1 << plane, (1 << plane) - 1
        for i in range(n):
            if x[i] & q:
                x[0] ^= low
            else:
                t = (x[0] ^ x[i]) & low
                x[0] ^= t
                x[i] ^= t
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = 0
    for plane in range(order - 1, 0, -1):
        if x[-1] & (1 << plane):
            t ^= (1 << plane) - 1
    out = 0
    for plane in range(order - 1, -1, -1):
        for v in x:
            out = out << 1 | ((v ^ t) >> plane & 1)
    return out


def base_spans(text):
    """The base spans of secrets by Python's ``re``, written from their description."""
    pats = [
        ("assign", r"(?:(?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 1, 6),
        ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24),
    ]
    found = [
        (m.start(), r, k, m.end())
        for r, (k, p, g, n) in enumerate(pats) for m in re.finditer(p, text or "", re.ASCII) if len(m.group(g)) >= n
    ]
    return [(k, a, b) for a, _, k, b in sorted(found)]


def align(a, b):
    """Matched pairs of two word lists by the definition of patience alignment, recursively."""
    if not a or not b:
        return []
    if a[0] == b[0]:
        return [(0, 0), *((i + 1, j + 1) for i, j in align(a[1:], b[1:]))]
    if a[-1] == b[-1]:
        return [*align(a[:-1], b[:-1]), (len(a) - 1, len(b) - 1)]
    pairs = [(i, b.index(w)) for i, w in enumerate(a) if a.count(w) == 1 and b.count(w) == 1]
    best = [[(i, j)] for i, j in pairs]
    for n, (_, j) in enumerate(pairs):
        before = max((best[m] for m in range(n) if pairs[m][1] < j), key=len, default=[])
        best[n] = [*before, pairs[n]]
    chain = max(best, key=len, default=[])
    if not chain:
        return []
    out, i0, j0 = [], 0, 0
    for i, j in [*chain, (len(a), len(b))]:
        out += [(i0 + x, j0 + y) for x, y in align(a[i0:i], b[j0:j])]
        if i < len(a):
            out.append((i, j))
        i0, j0 = i + 1, j + 1
    return out


def shards(rows, n_shards, order=4):
    """doc_id -> (curve, shard, slot) of rows (doc_id, text, lang, source)."""
    import zlib

    top, dims = 1 << order, []
    for c in (2, 3):
        names = [r[c] or "" for r in rows]
        dims.append([sum(x.encode() < v.encode() for x in names) * top // len(names) for v in names])
    raw = [(r[1] or "").encode() for r in rows]
    dims.append([min((len(t) + 1).bit_length() - 1, top - 1) for t in raw])
    curve = [hilbert_index(p, order) for p in zip(*dims, strict=True)]
    size, total, at = [len(t) + 1 for t in raw], sum(len(t) + 1 for t in raw), 0
    out, used = {}, [0] * n_shards
    for i in sorted(range(len(rows)), key=lambda i: (curve[i], zlib.crc32(raw[i]), rows[i][0])):
        shard = min(at * n_shards // total, n_shards - 1)
        out[rows[i][0]] = curve[i], shard, used[shard]
        used[shard] += 1
        at += size[i]
    return out


def markov_spans(text, base, table, classes, alphabet, candidate, least, threshold):
    """Model spans of a text: whole runs, or the best disjoint stretches between joints, by trying all."""
    code = lambda c: alphabet.find(c) if c in alphabet else classes - 1
    ratio = lambda s: [table[code(x) * classes + code(y)] for x, y in zip(s, s[1:], strict=False)]
    out = []
    for m in re.finditer(candidate, text or ""):
        s = m.group()
        r = ratio(s)
        if sum(r) / len(r) >= threshold:
            out.append((m.start(), m.end()))
            continue
        if not re.search("[/_=-]", s):
            continue
        cuts_a = [0, *(i + 1 for i, c in enumerate(s) if c in "/_=-")]
        cuts_b = [*(i for i, c in enumerate(s) if c in "/_=-"), len(s)]
        gain = np.concatenate([[0.0], np.cumsum(np.array(r) - threshold)])
        best = [(0.0, [])] * (len(s) + 1)  # of the stretches that end up to here
        for b in range(1, len(s) + 1):
            best[b] = best[b - 1]
            for a in cuts_a if b in cuts_b else ():
                if b - a >= least and (own := gain[b - 1] - gain[a]) + best[a][0] > best[b][0] + 1e-12:
                    best[b] = own + best[a][0], [*best[a][1], (a, b)]
        out += [(m.start() + a, m.start() + b) for a, b in best[-1][1]]
    return [(a, b) for a, b in out if all(b <= x or a >= y for _, x, y in base)]
