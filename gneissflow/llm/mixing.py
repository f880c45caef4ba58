"""Hierarchical token budgets over a domain - language - source tree.

A budget enters at the root and is split among siblings by weight.  A node can take no more than
its subtree holds (tokens times ``max_epochs``); what it cannot take goes to its siblings by their
weights, and only what all of them together cannot take stays with the ancestor's siblings: as a
node's capacity is the sum of its children's, filling from the top does exactly that.  Each leaf
then takes whole epochs and a token prefix of one more epoch in a seeded order.

All arithmetic is on whole numbers, so the result does not depend on the order of any sum.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import materialize

BUCKET_HEX = 3  # a leaf's epoch is cut into 16**3 ranges of the seeded order


@dataclass
class Level:
    """One level of the tree: its name, its column, whole-number weights, the weight of others."""

    name: str
    column: Column
    weights: dict[str, int] = field(default_factory=dict)
    other: int = 1


DOMAIN_SQL = "CASE pmod(try_cast(regexp_extract(source, '([0-9]+)$', 1) AS int), 4) WHEN 0 THEN 'web' WHEN 1 THEN 'books' WHEN 2 THEN 'code' WHEN 3 THEN 'talk' ELSE 'rest' END"
DOMAIN_WEIGHTS = {"web": 4, "books": 3, "code": 2, "talk": 1}
LANG_WEIGHTS = {"en": 5, "de": 2, "fr": 2, "es": 1}


def default_levels() -> list[Level]:
    return [
        Level("mix_domain", F.expr(DOMAIN_SQL), DOMAIN_WEIGHTS),
        Level("mix_lang", F.coalesce(F.col("lang"), F.lit("none")), LANG_WEIGHTS),
        Level("mix_source", F.coalesce(F.col("source"), F.lit("none"))),
    ]


def token_count(col: str = "text") -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+``; null: 0."""
    return F.coalesce(F.regexp_count(F.col(col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _weight(level: Level) -> Column:
    w = F.lit(level.other)
    for name, value in level.weights.items():
        w = F.when(F.col(level.name) == name, value).otherwise(w)
    return w.cast("long")


def _fill(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Share ``budget`` (of the parent) among siblings by weight and capacity: adds ``given``.

    All sums run over growing frames or whole parents, so the work grows with the siblings; products
    are decimals of 38 digits.
    """
    both = Window.partitionBy(*parent)
    before = both.orderBy("_ratio", name).rowsBetween(Window.unboundedPreceding, -1)
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    nodes = nodes.where("weight > 0").withColumn("_ratio", F.col("cap").cast("double") / F.col("weight"))
    nodes = nodes.withColumns({
        "_taken": F.coalesce(F.sum("cap").over(before), F.lit(0)),
        "_w": F.sum("weight").over(both) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
    })
    nodes = nodes.withColumn("_left", F.col("budget") - F.col("_taken"))
    nodes = nodes.withColumn("_full", wide("cap") * wide("_w") <= wide("_left") * wide("weight"))
    nodes = nodes.withColumn("_first", F.min(F.when(~F.col("_full"), F.struct("_ratio", F.col(name).alias("n"), "_taken", "_w"))).over(both))
    part = F.expr("CAST((CAST(budget - _first._taken AS decimal(19,0)) * CAST(weight AS decimal(19,0))) div CAST(_first._w AS decimal(19,0)) AS bigint)")
    given = F.when(F.col("_full"), F.col("cap")).otherwise(F.least(part, "cap"))
    return nodes.withColumn("given", given).drop("_ratio", "_taken", "_w", "_left", "_full", "_first")


def leaf_budgets(leaves: DataFrame, levels: list[Level], budget: int | None, share: tuple[int, int], max_epochs: int) -> DataFrame:
    """leaf columns, tokens, docs, given: one row for each leaf.

    ``leaves`` has one row for each leaf, never one for each document; it is shared out by windows
    over siblings.  Budget: ``budget`` tokens, or share[0]/share[1] of all tokens.
    """
    names = [x.name for x in levels]
    caps = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    for i, level in reversed(list(enumerate(levels))):
        caps = caps.withColumn(f"_w{i}", _weight(level))
    live = caps.where(" AND ".join(f"_w{i} > 0" for i in range(len(levels)))) if levels else caps
    total = F.lit(budget).cast("long") if budget is not None else F.expr(f"(sum(tokens) OVER () * {share[0]}) div {share[1]}")
    live = live.withColumn("budget", total.cast("long"))
    for i, name in enumerate(names):
        node = live.groupBy(*names[: i + 1]).agg(F.sum("cap").alias("cap"), F.first(f"_w{i}").alias("weight"), F.first("budget").alias("budget"))
        node = _fill(node, names[:i], name).select(*names[: i + 1], F.col("given").alias("budget"))
        live = live.drop("budget").join(node, names[: i + 1])
    return live.select(*names, "tokens", "docs", F.col("budget").alias("given"))


def mix(docs: DataFrame, levels: list[Level] | None = None, budget: int | None = None, share: tuple[int, int] = (1, 2), max_epochs: int = 4, seed: int = 17) -> DataFrame:
    """One row for each document and epoch it is taken in.

    doc_id, text_hash, the level columns, n_tokens, epoch (from 0), start (tokens of the leaf's epoch
    before it) and take (tokens taken of it: all but for the last document of a leaf's prefix).
    Null lang or source: ``none``; null text: no tokens.  A document without tokens is taken where
    its place in the order lies before the end of the prefix.  Repeated rows are taken separately,
    in one order.  An empty table, or a budget of 0, gives no rows.  Leaves of weight 0 give none.
    """
    levels = default_levels() if levels is None else levels
    names = [x.name for x in levels]
    digest = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("_md5")
    meta = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), digest, token_count().alias("n_tokens"),
        *[x.column.alias(x.name) for x in levels],
    )
    meta = materialize(meta, "meta")
    leaves = materialize(meta.groupBy(*names).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")), "leaves")
    plan = leaf_budgets(leaves, levels, budget, share, max_epochs).where("given > 0")
    plan = materialize(plan.selectExpr(*names, "given div tokens AS _epochs", "given % tokens AS _rest"), "plan")
    at = meta.join(plan, names)
    whole = at.where("_epochs > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), (F.col("_epochs") - 1).cast("int"))))
    last = at.where("_rest > 0").withColumn("epoch", F.col("_epochs").cast("int"))

    def ordered(x: DataFrame) -> DataFrame:
        parts = [F.lit(str(seed)), F.col("epoch").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("_md5")]
        u = F.md5(F.concat_ws(":", *parts).cast("binary"))
        return x.withColumn("_u", u).withColumn("_bucket", F.substring("_u", 1, BUCKET_HEX))

    rows = ordered(whole.withColumn("_rest", F.lit(None).cast("long")).unionByName(last))
    hist = rows.groupBy(*names, "epoch", "_bucket").agg(F.sum("n_tokens").alias("_sum"))
    ahead = Window.partitionBy(*names, "epoch").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    hist = hist.withColumn("_base", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)))
    rows = rows.join(hist, [*names, "epoch", "_bucket"]).where("_rest IS NULL OR _base < _rest")
    inside = Window.partitionBy(*names, "epoch", "_bucket").orderBy("_u", "doc_id", "_md5").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.col("_base") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).where("_rest IS NULL OR start < _rest")
    take = F.when(F.col("_rest").isNull(), F.col("n_tokens")).otherwise(F.least("n_tokens", F.col("_rest") - F.col("start")))
    return rows.select("doc_id", "text_hash", *names, "n_tokens", "epoch", "start", take.alias("take"))


def select_documents(docs: DataFrame, share: tuple[int, int] = (4, 5), levels: list[Level] | None = None, seed: int = 17) -> DataFrame:
    """``docs`` cut to the mixture, in one epoch and by whole documents.

    The document in which a leaf's token prefix ends stays whole, so a leaf exceeds its budget by less
    than one document and none that was given tokens is left empty.  Repeated rows (same id and text)
    stay or go together.
    """
    taken = mix(docs, levels, None, share, 1, seed).select(F.col("doc_id").alias("__g_id"), F.col("text_hash").alias("__g_th")).distinct()
    same = F.col("__g_id").eqNullSafe(F.col("doc_id").cast("long")) & (F.col("__g_th") == F.xxhash64("text"))
    return docs.join(taken, same, "left_semi")


#: DuckDB SQL of mix() with its defaults over ``documents``.
ORACLE_SQL = r"""
WITH meta AS (
  SELECT doc_id, md5(coalesce(text, '')) AS m,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS n_tokens,
         CASE TRY_CAST(nullif(regexp_extract(source, '([0-9]+)$', 1), '') AS INT) % 4
           WHEN 0 THEN 'web' WHEN 1 THEN 'books' WHEN 2 THEN 'code' WHEN 3 THEN 'talk' ELSE 'rest' END AS mix_domain,
         coalesce(lang, 'none') AS mix_lang, coalesce(source, 'none') AS mix_source
  FROM documents),
leaves AS (SELECT mix_domain, mix_lang, mix_source, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM meta GROUP BY ALL),
root AS (SELECT CAST(sum(tokens) AS BIGINT) // 2 AS b FROM leaves),
d0 AS (SELECT mix_domain, CAST(sum(tokens) * 4 AS BIGINT) AS cap, max(b) AS budget,
       CASE mix_domain WHEN 'web' THEN 4 WHEN 'books' THEN 3 WHEN 'code' THEN 2 ELSE 1 END AS weight
       FROM leaves, root GROUP BY mix_domain),
d1 AS (SELECT *, coalesce(sum(cap) OVER a, 0) AS taken, sum(weight) OVER r AS w FROM d0
  WINDOW a AS (ORDER BY cap::DOUBLE / weight, mix_domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         r AS (ORDER BY cap::DOUBLE / weight, mix_domain ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
d2 AS (SELECT *, cap * w <= (budget - taken) * weight AS f FROM d1),
d3 AS (SELECT *, min(CASE WHEN NOT f THEN {'r': cap::DOUBLE / weight, 'n': mix_domain, 't': taken, 'w': w} END) OVER () AS fi FROM d2),
dom AS (SELECT mix_domain, CASE WHEN f THEN cap ELSE least(((budget - fi.t) * weight) // fi.w, cap) END AS b FROM d3),
l0 AS (SELECT mix_domain, mix_lang, CAST(sum(tokens) * 4 AS BIGINT) AS cap, max(b) AS budget,
       CASE mix_lang WHEN 'en' THEN 5 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 ELSE 1 END AS weight
       FROM leaves JOIN dom USING (mix_domain) GROUP BY ALL),
l1 AS (SELECT *, coalesce(sum(cap) OVER a, 0) AS taken, sum(weight) OVER r AS w FROM l0
  WINDOW a AS (PARTITION BY mix_domain ORDER BY cap::DOUBLE / weight, mix_lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         r AS (PARTITION BY mix_domain ORDER BY cap::DOUBLE / weight, mix_lang ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
l2 AS (SELECT *, cap * w <= (budget - taken) * weight AS f FROM l1),
l3 AS (SELECT *, min(CASE WHEN NOT f THEN {'r': cap::DOUBLE / weight, 'n': mix_lang, 't': taken, 'w': w} END) OVER (PARTITION BY mix_domain) AS fi FROM l2),
lan AS (SELECT mix_domain, mix_lang, CASE WHEN f THEN cap ELSE least(((budget - fi.t) * weight) // fi.w, cap) END AS b FROM l3),
s0 AS (SELECT mix_domain, mix_lang, mix_source, tokens, tokens * 4 AS cap, b AS budget, 1 AS weight
       FROM leaves JOIN lan USING (mix_domain, mix_lang)),
s1 AS (SELECT *, coalesce(sum(cap) OVER a, 0) AS taken, sum(weight) OVER r AS w FROM s0
  WINDOW a AS (PARTITION BY mix_domain, mix_lang ORDER BY cap::DOUBLE / weight, mix_source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         r AS (PARTITION BY mix_domain, mix_lang ORDER BY cap::DOUBLE / weight, mix_source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
s2 AS (SELECT *, cap * w <= (budget - taken) * weight AS f FROM s1),
s3 AS (SELECT *, min(CASE WHEN NOT f THEN {'r': cap::DOUBLE / weight, 'n': mix_source, 't': taken, 'w': w} END) OVER (PARTITION BY mix_domain, mix_lang) AS fi FROM s2),
src AS (SELECT mix_domain, mix_lang, mix_source, tokens, CASE WHEN f THEN cap ELSE least(((budget - fi.t) * weight) // fi.w, cap) END AS given FROM s3),
plan AS (SELECT *, CAST(given // tokens AS BIGINT) AS eps, CAST(given % tokens AS BIGINT) AS rest FROM src WHERE given > 0),
taken AS (
  SELECT meta.*, CAST(u.e AS INT) AS epoch, CASE WHEN u.e = eps THEN rest END AS rest
  FROM meta JOIN plan USING (mix_domain, mix_lang, mix_source), range(0, 5) AS u(e)
  WHERE u.e < eps OR (u.e = eps AND rest > 0)),
run AS (
  SELECT *, CAST(coalesce(sum(n_tokens) OVER (PARTITION BY mix_domain, mix_lang, mix_source, epoch
    ORDER BY md5('17:' || epoch || ':' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || m), doc_id, m
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM taken)
SELECT doc_id, mix_domain, mix_lang, mix_source, n_tokens, epoch, start,
       CAST(CASE WHEN rest IS NULL THEN n_tokens ELSE least(n_tokens, rest - start) END AS BIGINT) AS take
FROM run WHERE rest IS NULL OR start < rest
"""
