"""Many path rules as an index: paths meet the rules they fit by equality, not one by one.

A rule is a glob as in ``functions.paths.denied``: ``**`` is any text, ``*`` any text without a slash; one with a
slash fits the whole path, one without any segment; ASCII case is ignored.  Most rules are one of five
simple forms, and each form is a key that a path can list itself: its segments, their first and last
characters in the lengths that occur in the rules, the folders above it, and itself.  Only other
rules, the residue, are tried as a pattern.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import denied
from ..scratch import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _plain(c: str | Column) -> Column:
    """Slashes turned, ASCII letters small."""
    return F.translate(F.replace(F.col(c) if isinstance(c, str) else c, F.lit("\\"), F.lit("/")), UPPER, LOWER)


def rule_index(rules: DataFrame) -> DataFrame:
    """form, key, size, pattern of rules(pattern): forms segment, suffix, prefix, path, below and residue; nulls are no rules."""
    p = F.col("p")
    stars = F.length("p") - F.length(F.replace(p, F.lit("*")))
    flat, last = ~p.contains("/"), F.substring("p", 1, F.length("p") - 1)
    form = (
        F.when(flat & (stars == 0), "segment").when(flat & (stars == 1) & p.startswith("*"), "suffix").when(flat & (stars == 1) & p.endswith("*"), "prefix")
        .when(stars == 0, "path").when((stars == 2) & p.endswith("/**"), "below").otherwise("residue")
    )
    key = F.when(form == "suffix", F.substring(p, F.lit(2), F.length("p"))).when(form == "prefix", last)
    key = key.when(form == "below", F.substring(p, F.lit(1), F.length("p") - 2)).otherwise(p)
    own = rules.where("pattern IS NOT NULL").select("pattern", _plain("pattern").alias("p")).select(form.alias("form"), key.alias("key"), "pattern")
    own = own.withColumn("pattern", F.when(F.col("form") == "residue", F.col("pattern")))
    return own.distinct().withColumn("size", F.length("key"))


def _ends(parts: Column, last: bool, lengths: list[int]) -> Column:
    """The first or last characters of each part in each length it has."""
    known = F.array(*[F.lit(n) for n in lengths])

    def of(part: Column) -> Column:
        cut = lambda n: F.substring(part, F.length(part) - n + 1 if last else F.lit(1), n)
        return F.transform(F.filter(known, lambda n: n <= F.length(part)), cut)

    return F.flatten(F.transform(parts, of))


def denied_by(paths: DataFrame, index: DataFrame) -> DataFrame:
    """path, denied: the distinct paths of paths(path), and whether any rule of the index fits; a null path none.

    Each path lists its keys once, so the work grows with paths and rules, not with their product.
    The lengths of prefixes and suffixes and the residue reach the driver: the residue is a configured
    list of patterns, the lengths are no more than the longest rule.
    """
    index = materialize(index, "rules")
    own = materialize(paths.select("path").distinct(), "paths")
    sizes: dict[str, list[int]] = {"suffix": [], "prefix": []}
    for r in index.where(F.col("form").isin(*sizes)).select("form", "size").distinct().collect():
        sizes[r["form"]].append(r["size"])
    p = _plain("path")
    parts = F.array_distinct(F.split("p", "/"))
    keyed = lambda form, arr: F.transform(arr, lambda k: F.struct(F.lit(form).alias("form"), k.alias("key")))
    above = F.transform(F.sequence(F.lit(1), F.size(F.split("p", "/")) - 1), lambda i: F.concat(F.array_join(F.slice(F.split("p", "/"), F.lit(1), i), "/"), F.lit("/")))
    lists = [
        keyed("segment", parts), keyed("path", F.array("p")),
        F.when(F.col("p").contains("/"), keyed("below", above)).otherwise(F.array().cast("array<struct<form:string,key:string>>")),
    ]
    for form, lengths in sizes.items():
        if lengths:
            lists.append(keyed(form, _ends(parts, form == "suffix", sorted(lengths))))
    keys = own.where("path IS NOT NULL").select("path", p.alias("p")).select("path", F.explode(F.concat(*lists)).alias("k")).select("path", "k.form", "k.key")
    hit = keys.join(index.where("form <> 'residue'").select("form", "key"), ["form", "key"], "left_semi").select("path").distinct()
    out = own.join(hit.withColumn("_hit", F.lit(True)), "path", "left").withColumn("denied", F.coalesce("_hit", F.lit(False))).drop("_hit")
    rest = sorted(r["pattern"] for r in index.where("form = 'residue'").select("pattern").distinct().collect())
    return out.withColumn("denied", F.col("denied") | F.coalesce(denied("path", rest), F.lit(False))) if rest else out
