"""Secrets by patterns and by character Markov models, with built-in Spark functions only.

Two first-order models of character pairs, one of random strings and one of ordinary identifiers,
are counted from labelled samples.  A run of token characters is a secret if the log-likelihood
ratio of the two models, per pair, passes a threshold.  In a run that does not pass, the stretches
between two of the characters ``/ _ - =`` (or the run's ends) that pass are secrets, so a name or
path joined to a random string does not hide it.  Spans of the fixed patterns come first and
always stay; a model span that touches one of them is left out.

Positions are code points.  They are found without loops over characters: ``split`` at a pattern
gives the pieces between its matches, whose lengths add up to the matches' places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (kind, pattern, capture group whose length counts, least length); fixed values.
BASE = [
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),  # the same runs as [0-9a-f]+ of 24 and more
]
#: Characters of the models; the last class is any other.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-="
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
LEAST = 20  # characters of a stretch
CLASSES = len(ALPHABET) + 1
JOINTS = ALPHABET.index("/")  # class of the first of / _ - =, the last ones of the alphabet
LLR_PER_PAIR = 0.7
SAMPLES = 4000
BLOCKS = (1 << 16, 1 << 9)  # items of the outer and the inner blocks of a fold
#: Words of the ordinary sample (fixed values).
WORDS = """
get set user name file path list item value index count total size page view model data table column row key map node
edge graph text line word string number date time hour day month year start end first last next prev open close read
write load save find search sort filter group join merge split parse format print log error warning info debug test
check valid default config option param result response request client server session login admin account order invoice
price customer product address phone email country city street
""".split()


def _random_samples(spark: SparkSession, n: int) -> DataFrame:
    """Seeded random strings: hexadecimal, base 64, and capital letters with digits."""
    h = F.sha2(F.concat(F.lit("sample"), F.col("id").cast("string")), 256)
    b64 = F.base64(F.unhex(F.concat(h, F.sha2(h, 256))))
    caps = F.upper(F.regexp_replace(b64, "[^A-Za-z0-9]", ""))
    kinds = F.array(F.substring(h, 1, 40), b64, caps, F.regexp_replace(b64, "[+/=]", ""))
    text = F.element_at(kinds, (F.col("id") % 4 + 1).cast("int"))
    return spark.range(n).select(text.alias("text"), F.lit(1).alias("label"))


def _ordinary_samples(spark: SparkSession, n: int) -> DataFrame:
    """Identifiers put together from common words: snake, kebab, camel, capitals, plain, numbered."""
    words = F.lit(WORDS)
    pick = lambda k: F.get(words, F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(WORDS))).cast("int"))
    a, b, c, d = (pick(k) for k in range(4))
    kinds = [
        F.concat_ws("_", a, b, c, d), F.concat_ws("-", a, b, c, d), F.concat(a, F.initcap(b), F.initcap(c), F.initcap(d)),
        F.upper(F.concat_ws("_", a, b, c)), F.concat(a, b, c, d), F.concat_ws("/", a, b, c, d),
        F.concat(F.initcap(a), F.initcap(b), F.lit("_"), (F.col("id") % 3000).cast("string")),
    ]
    text = F.element_at(F.array(*kinds), (F.col("id") % len(kinds) + 1).cast("int"))
    return spark.range(n).select(text.alias("text"), F.lit(0).alias("label"))


def labelled_samples(spark: SparkSession, n: int = SAMPLES) -> DataFrame:
    """text, label (1: random): ``n`` strings of each class, the same in every run."""
    return _random_samples(spark, n).union(_ordinary_samples(spark, n))


def _classes(text: Column) -> Column:
    """Class of each character; an empty text gives one -1.  ``split`` at nothing cuts a text into its
    characters in one pass."""
    place = lambda c: F.coalesce(F.nullif(F.instr(F.lit(ALPHABET), c), F.lit(0)), F.lit(CLASSES)) - 1
    return F.transform(F.split(text, ""), lambda c: F.when(F.length(c) == 0, F.lit(-1)).otherwise(place(c)))


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratio of each pair of classes: CLASSES * CLASSES numbers, add-one smoothed.

    Counts come from one aggregate over all samples; a table of CLASSES squared rows at most reaches
    the driver.
    """
    codes = samples.where("text IS NOT NULL AND label IS NOT NULL").select("label", _classes(F.col("text")).alias("c"))
    codes, n = codes.where(F.size("c") > 1), F.size("c") - 1
    pair = F.zip_with(F.slice("c", F.lit(1), n), F.slice("c", F.lit(2), n), lambda x, y: x * CLASSES + y)
    random = F.when(F.col("label") == 1, 1).otherwise(0)
    counted = codes.select("label", F.explode(pair).alias("p")).groupBy("p").agg(F.sum(random).alias("n1"), F.sum(1 - random).alias("n0"))
    got = counted.collect()
    return ratios({r["p"]: (r["n0"], r["n1"]) for r in got})


def ratios(counts: dict[int, tuple[int, int]]) -> list[float]:
    from math import log

    table = [counts.get(p, (0, 0)) for p in range(CLASSES * CLASSES)]
    out = []
    for x in range(CLASSES):
        row = table[x * CLASSES : (x + 1) * CLASSES]
        t0, t1 = (sum(r[k] for r in row) + CLASSES for k in (0, 1))
        out += [log((b + 1) / t1) - log((a + 1) / t0) for a, b in row]
    return out


def ratio_table(table: list[float]) -> Column:
    """The trained numbers as one literal: a JSON text that Spark folds into an array once."""
    return F.from_json(F.lit("[" + ",".join(f"{x:.9f}" for x in table) + "]"), "array<double>")


def llr_per_pair(text: Column, table: Column) -> Column:
    """Mean log-likelihood ratio over the pairs of a string; null for fewer than two characters."""
    state = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum"))

    def step(s: Column, c: Column) -> Column:
        own = F.when(s["last"] < 0, 0.0).otherwise(F.get(table, s["last"] * CLASSES + c))
        return F.struct(c.alias("last"), (s["sum"] + own).alias("sum"))

    return F.aggregate(_classes(text), state, step, lambda s: s["sum"] / F.nullif(F.length(text) - 1, F.lit(0)))


def _fold(items: Column, fields: dict[str, Column], entry: str, step, done) -> Column:
    """``done(state)`` after a fold over an array that also lists entries in ``state["out"]``.

    step(s, x) gives the new fields, whether to list an entry, and the entry.  Spark copies the state
    of a fold at each step, so a list in it would make the fold quadratic: items are folded in blocks,
    and blocks in blocks, each with a list of its own that is joined on at the block's end.
    """
    none = F.array().cast(f"array<{entry}>")
    state = lambda get, out: F.struct(*[get(n).alias(n) for n in fields], out.alias("out"))

    def one(s: Column, x: Column) -> Column:
        new, more, e = step(s, x)
        return state(new.__getitem__, F.when(more, F.concat(s["out"], F.array(e.cast(entry)))).otherwise(s["out"]))

    def over(items: Column, start: Column, sizes: tuple[int, ...], done) -> Column:
        if not sizes:
            return F.aggregate(items, start, one, done)

        def blocks(own: Column) -> Column:
            firsts = F.sequence(F.lit(1), F.greatest(F.size(own), F.lit(1)), F.lit(sizes[0]))

            def block(s: Column, i: Column) -> Column:
                joined = lambda t: state(t.__getitem__, F.concat(s["out"], t["out"]))
                return over(F.slice(own, i, F.lit(sizes[0])), state(s.__getitem__, none), sizes[1:], joined)

            return F.aggregate(firsts, start, block, done)

        return F.element_at(F.transform(F.array(items), blocks), 1)  # binds the items: they are made once

    return over(items, state(fields.__getitem__, none), BLOCKS, done)


def stretches(text: Column, table: Column, threshold: float) -> Column:
    """Array of (a, b): the disjoint stretches of ``LEAST`` characters or more, each between joints or
    ends of ``text``, with the largest sum of the pairs' ratios less ``threshold``; each passes it.

    One fold over the characters.  ``w`` is the sum so far, ``wait`` has the starts nearer than
    ``LEAST``, ``top`` the best start of the others, ``total`` the best choice that ends before here.  A
    choice is its last stretch and the place of the choice before it in the list, which is read once
    at the end; so a step costs the same wherever in the text it is.
    """
    start, entry, pair = "struct<v:double,a:int,prev:int>", "struct<a:int,b:int,prev:int>", "struct<a:int,b:int>"
    joint = lambda c: F.coalesce(c, F.lit(JOINTS)).between(JOINTS, CLASSES - 2)
    codes = _classes(text)
    before = F.concat(F.array(F.lit(None).cast("int")), F.slice(codes, F.lit(1), F.length(text) - 1))
    seen = F.zip_with(codes, before, lambda c, p: F.struct(c.alias("c"), p.alias("p")))
    score = lambda x: F.when(x["p"].isNull(), 0.0).otherwise(F.get(table, x["p"] * CLASSES + x["c"]) - threshold)
    after = F.slice(codes, F.lit(2), F.length(text))
    steps = F.zip_with(seen, after, lambda x, d: F.struct(score(x).alias("s"), joint(x["p"]).alias("from"), joint(d).alias("to")))
    fields = {
        "k": F.lit(0), "w": F.lit(0.0), "wait": F.array().cast(f"array<{start}>"), "top": F.lit(None).cast(start),
        "total": F.lit(0.0), "last": F.lit(-1), "n": F.lit(0),
    }

    def step(s: Column, x: Column):
        w = s["w"] + x["s"]
        here = F.struct((s["total"] - w).alias("v"), s["k"].alias("a"), s["last"].alias("prev")).cast(start)
        wait = F.when(x["from"], F.concat(s["wait"], F.array(here))).otherwise(s["wait"])
        first = F.get(s["wait"], F.lit(0))
        far = s["k"] - first["a"] + 1 >= LEAST
        top = F.when(far & (s["top"].isNull() | (first["v"] > s["top"]["v"])), first).otherwise(s["top"])
        wait = F.when(far, F.slice(wait, F.lit(2), F.lit(LEAST))).otherwise(wait)
        more = x["to"] & (top["v"] + w > s["total"])
        kept = lambda new, name: F.when(more, new).otherwise(s[name])
        new = {"k": s["k"] + 1, "w": w, "wait": wait, "top": top, "total": kept(top["v"] + w, "total"), "last": kept(s["n"], "last"), "n": kept(s["n"] + 1, "n")}
        return new, more, F.struct(top["a"].alias("a"), (s["k"] + 1).alias("b"), top["prev"].alias("prev"))

    def chain(s: Column) -> Column:
        """The stretches of the best choice, back from its last one."""

        def back(t: Column, e: Column):
            hit = t["i"] == t["want"]
            return {"want": F.when(hit, e["prev"]).otherwise(t["want"]), "i": t["i"] - 1}, hit, F.struct(e["a"].alias("a"), e["b"].alias("b"))

        return _fold(F.reverse(s["out"]), {"want": s["last"], "i": s["n"] - 1}, pair, back, lambda t: F.reverse(t["out"]))

    return _fold(steps, fields, entry, step, chain)


SPAN = "struct<start:int,end:int,kind:string,match:string>"


def spans(text: Column, kind: str, pattern: str, group: int = 0, least: int = 1) -> Column:
    """Array of (start, end, kind, match) of the leftmost non-overlapping matches, failing ones dropped."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    gaps = F.split(text, pattern, -1)
    steps = F.arrays_zip(found.alias("m"), parts.alias("g"), F.slice(gaps, F.lit(1), F.size(found)).alias("p"))

    def step(s: Column, x: Column):
        a = s["at"] + F.length(x["p"])
        b = a + F.length(x["m"])
        return {"at": b}, F.length(x["g"]) >= least, F.struct(a.alias("start"), b.alias("end"), F.lit(kind).alias("kind"), x["m"].alias("match"))

    made = _fold(steps, {"at": F.lit(0)}, SPAN, step, lambda s: s["out"])
    return F.when(text.rlike(pattern), made).otherwise(F.array().cast(f"array<{SPAN}>"))


def _apart(likely: Column, base: Column) -> Column:
    """Those of ``likely`` that touch no span of ``base``; both in the order of their starts.

    Two folds over both together: forwards with the furthest end of a base span so far, backwards with
    the nearest start of one to come.
    """

    def merged(arr: Column) -> Column:
        keyed = lambda a, own: F.transform(a, lambda s: F.struct(s["start"].alias("a"), F.lit(own).alias("own"), s.alias("s")))
        return F.array_sort(F.concat(keyed(base, 0), keyed(arr, 1)))

    def free(arr: Column, limit: int, meets, at, turn) -> Column:
        def step(s: Column, x: Column):
            now = F.when(x["own"] == 0, at(s["at"], x["s"])).otherwise(s["at"])
            return {"at": now}, (x["own"] == 1) & ~meets(s["at"], x["s"]), x["s"]

        return _fold(turn(merged(arr)), {"at": F.lit(limit)}, SPAN, step, lambda s: turn(s["out"]))

    ahead = free(likely, -1, lambda end, s: end > s["start"], lambda end, s: F.greatest(end, s["end"]), lambda a: a)
    return free(ahead, (1 << 31) - 1, lambda start, s: start < s["end"], lambda start, s: F.least(start, s["start"]), F.reverse)


def find_secrets(docs: DataFrame, table: list[float] | None = None, threshold: float = LLR_PER_PAIR, candidate: str = CANDIDATE) -> DataFrame:
    """``docs`` with base_spans and spans: arrays of (start, end, kind, match), in order.

    Kinds: those of ``BASE``, and ``markov`` for runs of ``candidate`` characters, or else their
    ``stretches``, that the models call random and that touch no base span.  Null and empty texts
    have empty arrays.  Columns of ``docs`` with the two new names are replaced; rows and other
    columns stay as they are, repeated rows too; nothing is shuffled.
    """
    table = train(labelled_samples(docs.sparkSession)) if table is None else table
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.drop("base_spans", "spans")
    found = {f"__g_s{i}": spans(text, k, p, g, n) for i, (k, p, g, n) in enumerate(BASE)}
    out = out.withColumns(found | {"__g_m": spans(text, "markov", candidate)})
    rank = {k: i for i, (k, *_) in enumerate(BASE)} | {"markov": len(BASE)}
    ranks = F.create_map(*[y for k, i in rank.items() for y in (F.lit(k), F.lit(i))])
    kind_rank = lambda s: F.element_at(ranks, s["kind"])

    def ordered(arr: Column) -> Column:
        keyed = F.transform(arr, lambda s: F.struct(s["start"].alias("a"), kind_rank(s).alias("r"), s.alias("s")))
        return F.transform(F.array_sort(keyed), lambda x: x["s"])

    base = F.concat(*[F.col(f"__g_s{i}") for i in range(len(BASE))])
    out = out.withColumn("base_spans", F.when(F.size(base) > 0, ordered(base)).otherwise(base)).drop(*found)
    ratio = ratio_table(table)
    raw = F.transform("__g_m", lambda m: F.struct(m.alias("m"), m["match"].cast("binary").alias("bytes")))  # ASCII: a place is a byte

    def passing(x: Column) -> Column:
        m = x["m"]

        def part(p: Column) -> Column:
            a, b, own = m["start"] + p["a"], m["start"] + p["b"], F.substring(x["bytes"], p["a"] + 1, p["b"] - p["a"]).cast("string")
            return F.struct(a.alias("start"), b.alias("end"), m["kind"].alias("kind"), own.alias("match"))

        parts = F.transform(stretches(m["match"], ratio, threshold), part)
        parts = F.when(m["match"].rlike("[/_=-]"), parts).otherwise(F.array().cast(f"array<{SPAN}>"))
        return F.when(llr_per_pair(m["match"], ratio) >= threshold, F.array(m)).otherwise(parts.cast(f"array<{SPAN}>"))

    likely = F.flatten(F.transform(raw, passing))
    out = out.withColumn("__g_x", F.when(F.size("__g_m") > 0, likely).otherwise(F.col("__g_m")))
    clear = F.when((F.size("__g_x") > 0) & (F.size("base_spans") > 0), _apart(F.col("__g_x"), F.col("base_spans"))).otherwise(F.col("__g_x"))
    out = out.withColumn("__g_x", clear)
    both = F.when(F.size("__g_x") > 0, ordered(F.concat("base_spans", "__g_x"))).otherwise(F.col("base_spans"))
    return out.withColumn("spans", both).drop("__g_m", "__g_x")


def told(arr: str) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(F.col(arr), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
