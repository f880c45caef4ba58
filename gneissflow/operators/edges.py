"""The code graph from fact tables.

Tables that grow with the input are joined by merging: the size of a packed file says little of what sending it
whole to every task would cost.

files(path, language), symbols(path, pos, kind, name, qualified_name, exported, heritage...),
imports(path, pos, imported_name, module_specifier), calls(path, pos, caller_qualified_name,
callee_text, receiver).  ``pos`` is the order within a file; "first" means the smallest.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..scratch import materialize
from ..session import dealt

EDGE = ["kind", "src", "dst", "confidence", "tier"]


@dataclass
class CodeGraph:
    nodes: DataFrame  # id, kind
    edges: DataFrame  # kind, src, dst, confidence, tier
    unresolved: DataFrame  # caller, count


def file_id(path: Column) -> Column:
    return F.concat(F.lit("file:"), path)


def sym_id(name: Column) -> Column:
    return F.concat(F.lit("sym:"), name)


def first_wins(edges: DataFrame, order: str = "ord") -> DataFrame:
    """One edge for each (kind, src, dst): the one that was found first."""
    best = F.min_by(F.struct("confidence", "tier"), order)
    return edges.groupBy("kind", "src", "dst").agg(best.alias("_b")).select("kind", "src", "dst", "_b.confidence", "_b.tier")


def first_of(df: DataFrame, keys: list[str], order: str, value: str | list[str]) -> DataFrame:
    values = [value] if isinstance(value, str) else value
    return df.groupBy(*keys).agg(F.min_by(F.struct(*values), order).alias("_f")).select(*keys, *[F.col(f"_f.{v}").alias(v) for v in values])


def resolve_first(requests: DataFrame, keys: list[str], candidates: str, eligible: DataFrame, as_: str = "target") -> DataFrame:
    """Priority look-up: the first entry of an array that is among ``eligible.path``."""
    tried = requests.select(*keys, F.posexplode(candidates).alias("_pos", "path"))
    return tried.join(eligible.select("path").distinct().hint("merge"), "path").groupBy(*keys).agg(F.min_by("path", "_pos").alias(as_))


def resolve_imports(imports: DataFrame, eligible: DataFrame) -> DataFrame:
    """path, module_specifier, external, target for each distinct import of a file."""
    asked = imports.select("path", "module_specifier").distinct().withColumn("_c", P.import_candidates("path", "module_specifier"))
    asked = asked.withColumn("external", F.col("_c").isNull())
    hit = resolve_first(asked.withColumnRenamed("path", "source"), ["source", "module_specifier"], "_c", eligible).withColumnRenamed("source", "path")
    return asked.drop("_c").join(hit.hint("merge"), ["path", "module_specifier"], "left")


def build_graph(files: DataFrame, symbols: DataFrame, imports: DataFrame, calls: DataFrame, eligible: DataFrame | None = None, tasks: int | None = None) -> CodeGraph:
    """Nodes, edges and the census of unresolved calls; ``tasks``: what the calls are dealt out over (None: left to Spark)."""
    eligible = files if eligible is None else eligible
    f, s = F.col("path"), F.col("qualified_name")
    nodes = files.select(file_id(f).alias("id"), F.lit("file").alias("kind")).union(symbols.select(sym_id(s), F.lit("symbol"))).distinct()
    sure = [F.lit(1.0).alias("confidence"), F.lit("extracted").alias("tier"), F.lit(0).alias("ord")]
    contains = symbols.select(F.lit("CONTAINS").alias("kind"), file_id(f).alias("src"), sym_id(s).alias("dst"), *sure)

    found = materialize(resolve_imports(imports, eligible), "resolved")
    inner = found.where("target IS NOT NULL").join(files.select(F.col("path").alias("target")).hint("merge"), "target", "left_semi")
    imported = inner.select(F.lit("IMPORTS").alias("kind"), file_id(f).alias("src"), file_id(F.col("target")).alias("dst"), *sure)

    # names: first symbol of a name in a file, first exported one, and what an imported name leads to
    here = first_of(symbols, ["path", "name"], "pos", "qualified_name")
    public = first_of(symbols.where("exported"), ["path", "name"], "pos", "qualified_name")
    named = first_of(imports.where("imported_name IS NOT NULL"), ["path", "imported_name"], "pos", "module_specifier")
    scope = named.join(inner.hint("merge"), ["path", "module_specifier"]).select("path", F.col("imported_name").alias("name"), "target")
    through = scope.join(public.select(F.col("path").alias("target"), "name", "qualified_name").hint("merge"), ["target", "name"])
    through = materialize(through.select("path", "name", "target", "qualified_name"), "through")

    lines = []
    for kind, part in (("INHERITS", "extends"), ("IMPLEMENTS", "implements")):
        base = symbols.select("path", F.col("qualified_name").alias("own"), F.explode(f"heritage.{part}").alias("name"))
        near = base.join(here.hint("merge"), ["path", "name"], "left").withColumnRenamed("qualified_name", "a")
        both = near.join(through.select("path", "name", F.col("qualified_name").alias("b")).hint("merge"), ["path", "name"], "left")
        local = F.col("a").isNotNull()
        lines.append(both.where("a IS NOT NULL OR b IS NOT NULL").select(
            F.lit(kind).alias("kind"), sym_id(F.col("own")).alias("src"), sym_id(F.coalesce("a", "b")).alias("dst"),
            F.when(local, 0.95).otherwise(0.9).alias("confidence"), F.lit("extracted").alias("tier"), F.when(local, 0).otherwise(1).alias("ord"),
        ))

    text, caller = F.col("callee_text"), F.col("caller_qualified_name")
    parts = F.split(text, r"\.")
    cls = F.split(F.element_at(F.split(caller, "#"), 2), r"\.")
    in_class = (F.col("receiver") == "this") & caller.contains("#") & (F.size(cls) >= 2)
    c = calls.select(
        "path", "pos", "receiver", F.when(caller != "", sym_id(caller)).otherwise(file_id(f)).alias("src"),
        F.when(caller != "", caller).otherwise(file_id(f)).alias("who"),
        F.when(F.col("receiver") == "identifier", text).when(F.col("receiver") == "property", parts[0]).alias("name"),
        F.when(F.col("receiver") == "property", F.coalesce(F.get(parts, F.lit(1)), F.lit(""))).alias("prop"),
        F.when(in_class, F.concat(f, F.lit("#"), cls[0], F.lit("."), F.element_at(parts, -1))).alias("sibling"),
        F.regexp_replace(F.when(F.col("receiver") == "property", parts[0]).otherwise(text), r"^\s+|\s+$", "").alias("base"),
    )
    own = symbols.select("path", F.col("qualified_name").alias("sibling")).distinct().withColumn("to_sibling", F.col("sibling"))
    member = public.select(F.col("path").alias("via_file"), F.col("name").alias("prop"), F.col("qualified_name").alias("to_member"))
    led = through.select("path", "name", F.col("qualified_name").alias("to_import"), F.col("target").alias("via_file"))

    # edges: each kind of receiver meets only what it may lead to, and calls that lead nowhere drop out before any join
    to, sure_of = F.col("to"), F.col("confidence")
    names = here.withColumnRenamed("qualified_name", "h").join(led.hint("merge"), ["path", "name"], "full")
    names = names.select("path", "name", F.coalesce("h", "to_import").alias("to"), F.when(F.col("h").isNotNull(), 0.95).otherwise(0.9).alias("confidence"))
    meet = lambda a, b, *keys: dealt(a, tasks, *keys).join(dealt(b, tasks, *keys).hint("merge"), list(keys))
    plain = meet(c.where("receiver = 'identifier' AND name IS NOT NULL").select("path", "name", "pos", "src"), names, "path", "name")
    owned = c.where("receiver = 'property' AND name IS NOT NULL AND prop IS NOT NULL").select("path", "name", "prop", "pos", "src")
    owned = meet(owned, led.select("path", "name", "via_file"), "path", "name").select("via_file", "prop", "pos", "src")
    owned = meet(owned, member, "via_file", "prop").select("src", F.col("to_member").alias("to"), F.lit(0.9).alias("confidence"), "pos")
    inside = meet(c.where("sibling IS NOT NULL").select("path", "sibling", "pos", "src"), own, "path", "sibling")
    inside = inside.select("src", F.col("to_sibling").alias("to"), F.lit(0.95).alias("confidence"), "pos")
    called = plain.select("src", to, sure_of, "pos").unionByName(owned).unionByName(inside)
    called = called.select(F.lit("CALLS").alias("kind"), "src", sym_id(to).alias("dst"), sure_of, F.lit("extracted").alias("tier"), F.col("pos").alias("ord"))

    # calls that lead nowhere; both sides are dealt out, as Spark would else deal out the calls anew by its own number
    to_here = dealt(here.withColumnRenamed("qualified_name", "to_here"), tasks, "path", "name")
    c = dealt(c, tasks, "path", "name").join(to_here.hint("merge"), ["path", "name"], "left")
    c = c.join(dealt(led, tasks, "path", "name").hint("merge"), ["path", "name"], "left")
    # most calls have no property: their null keys, which match nothing, are dealt out too
    none = F.col("via_file").isNull() | F.col("prop").isNull()
    c = c.withColumn("_salt", F.when(none, F.pmod(F.xxhash64("path", "pos"), 4096) + 1).otherwise(0).cast("int"))
    c = dealt(c, tasks, "via_file", "prop", "_salt")
    zero = F.pmod(F.hash("via_file"), F.lit(1))  # a constant would fall out of the keys, and all null keys meet in one task
    member = dealt(member.withColumn("_salt", zero), tasks, "via_file", "prop", "_salt")
    c = c.join(member.hint("merge"), ["via_file", "prop", "_salt"], "left").drop("_salt")
    c = dealt(c, tasks, "path", "sibling").join(dealt(own, tasks, "path", "sibling").hint("merge"), ["path", "sibling"], "left")
    ident, prop = F.col("receiver") == "identifier", F.col("receiver") == "property"
    to = F.when(ident, F.coalesce("to_here", "to_import")).when(prop, F.col("to_member")).otherwise(F.col("to_sibling"))
    c = c.withColumn("to", to)
    outside = imports.join(found.where("external").hint("merge"), ["path", "module_specifier"], "left_semi")
    outside = outside.where("imported_name IS NOT NULL AND imported_name <> ''").select("path", F.col("imported_name").alias("base")).distinct()
    open_ = dealt(c.where("to IS NULL").select("path", "base", "who"), tasks, "path", "base").join(dealt(outside, tasks, "path", "base").hint("merge"), ["path", "base"], "left_anti")
    unresolved = open_.groupBy(F.col("who").alias("caller")).agg(F.count(F.lit(1)).alias("count"))

    edges = contains.unionByName(imported)
    for x in (*lines, called):
        edges = edges.unionByName(x)
    edges = first_wins(dealt(edges, tasks, "src", "dst"))
    return CodeGraph(nodes, edges.unionByName(tested_by(files, edges)), unresolved)


def tested_by(files: DataFrame, edges: DataFrame) -> DataFrame:
    """From test file to tested file: by imports, and by name for tests that import nothing tested."""
    path = lambda c: F.substring(c, 6, 1 << 20)

    def edge(df: DataFrame, dst, confidence: float) -> DataFrame:
        return df.select(F.lit("TESTED_BY").alias("kind"), "src", dst, F.lit(confidence).alias("confidence"), F.lit("inferred").alias("tier"))

    imports = edges.where(F.col("kind") == "IMPORTS").where(P.is_test(path("src")) & ~P.is_test(path("dst")))
    by_import = edge(imports, F.col("dst"), 0.8)
    rest = files.where(P.is_test("path")).select(F.col("path").alias("source"), file_id(F.col("path")).alias("src"), P.test_subjects("path").alias("_c"))
    rest = rest.join(by_import.select("src").distinct().hint("merge"), "src", "left_anti")
    by_name = edge(resolve_first(rest, ["src"], "_c", files), file_id(F.col("target")).alias("dst"), 0.7)
    return by_import.unionByName(by_name)
