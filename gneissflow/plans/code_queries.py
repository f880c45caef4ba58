"""Registered queries that build a code graph from fact tables and ask it.

The fact tables are a reading of the Parquet test tables: twenty parts are the symbols of a file, parts
of some size import by name, and every line of an order is a call.  The readings are SQL expressions
that both engines share; everything behind them is done by the operators here and by plain SQL there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as T
from ..operators import edges as E
from ..operators import graph as G
from ..operators import history, rank
from ..operators import risk as R
from ..operators import sections as V
from ..scratch import materialize
from ..session import dealt, spread, tasks_for
from .registry import query, table

FILE = "CAST(floor(k / 20) AS BIGINT)"
NAME = "CASE p_name WHEN 'red widget' THEN 'toString' WHEN 'blue bolt' THEN 'authToken' ELSE replace(p_name, ' ', '_') END"
QUALIFIED = "concat(path, '#', CASE WHEN k % 5 = 4 THEN 'C.' ELSE '' END, name)"
KIND = "CASE WHEN k % 5 = 4 THEN 'method' WHEN sz < 10 THEN 'interface' WHEN sz < 20 THEN 'class' ELSE 'function' END"
IMPORTED = "sz >= 25"
SPECIFIER = """CASE WHEN sz = 50 OR f % 20 = 19 THEN 'lodash' ELSE concat(CASE WHEN f % 10 = 7 THEN '../../' ELSE '../' END,
  CASE k % 3 WHEN 0 THEN regexp_replace(aim, '(/index)?[.][a-z]+$', '') WHEN 1 THEN aim ELSE regexp_replace(aim, 'ts$', 'js') END) END"""
CALLEE = """CASE l_linenumber % 4 WHEN 0 THEN called WHEN 1 THEN concat(called, '.small_ring') WHEN 2 THEN concat('this.', called) ELSE 'x()' END"""
RECEIVER = "CASE l_linenumber % 4 WHEN 0 THEN 'identifier' WHEN 1 THEN 'property' WHEN 2 THEN 'this' ELSE 'unresolved' END"


def path_of(f: str) -> str:
    """Path of a file by its number."""
    return f"""CASE ({f}) % 10 WHEN 9 THEN concat('test/m', ({f}) - 1, '.test.ts') WHEN 8 THEN concat('src/m', {f}, '.js')
  WHEN 7 THEN concat('src/d', {f}, '/index.ts') WHEN 0 THEN concat('scripts/m', {f}, '.mts') ELSE concat('src/m', {f}, '.ts') END"""


class Reading:
    """The fact tables of a folder; the parts are read once and written, as all tables derive from them."""

    def __init__(self, spark: SparkSession, d: str):
        p = table(spark, d, "part").selectExpr("p_partkey AS k", f"{NAME} AS name", "p_size AS sz").selectExpr("*", f"{FILE} AS f")
        p = p.selectExpr("*", f"{path_of('f')} AS path")
        self.parts = materialize(spread(p).selectExpr("*", f"{QUALIFIED} AS q", f"{KIND} AS kind"), "parts")
        self.lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
        self.files = self.parts.select("path").distinct().withColumn("language", P.language("path"))
        base = lambda odd, name: f"CASE WHEN kind = 'class' AND sz % 2 = {odd} THEN array('{name}') ELSE array() END"
        heritage = f"named_struct('extends', {base(0, 'small_ring')}, 'implements', {base(1, 'toString')}) AS heritage"
        self.symbols = self.parts.selectExpr(
            "path", "k % 20 AS pos", "kind", "name", "q AS qualified_name", "sz > 12 AS exported", "startswith(path, 'test/') AS is_test",
            heritage, "concat(kind, ' ', name) AS signature", "'' AS jsdoc",
        )
        aims = self.parts.where(IMPORTED).selectExpr("*", f"{path_of('f + 1 + k % 7')} AS aim")
        self.imports = aims.selectExpr("path", "k % 20 AS pos", "name AS imported_name", f"{SPECIFIER} AS module_specifier")
        tasks = tasks_for(spark, self.lines.count())
        # fewer than Spark deals out by itself are left to it: it would deal out so many anyway, and not merge small ones
        self.tasks = tasks if tasks >= int(spark.conf.get("spark.sql.shuffle.partitions")) else None
        both = dealt(self.lines, self.tasks, "l_partkey").join(self.parts.select(F.col("k").alias("l_partkey"), "path", "q").hint("merge"), "l_partkey")
        called = self.parts.select(F.col("k").alias("l_suppkey"), F.col("name").alias("called"))
        both = dealt(both, self.tasks, "l_suppkey").join(called.hint("merge"), "l_suppkey")
        self.calls = both.selectExpr(
            "path", "l_orderkey * 10 + l_linenumber AS pos", "CASE WHEN l_quantity < 5 THEN '' ELSE q END AS caller_qualified_name",
            f"{CALLEE} AS callee_text", f"{RECEIVER} AS receiver",
        )

    def graph(self) -> E.CodeGraph:
        return E.build_graph(self.files, self.symbols, self.imports, self.calls, tasks=self.tasks)


CODE_SQL = rf"""
WITH p0 AS (SELECT p_partkey AS k, {NAME} AS name, p_size AS sz FROM part), p1 AS (SELECT *, {FILE} AS f FROM p0),
p2 AS (SELECT *, {path_of('f')} AS path FROM p1), sy AS (SELECT *, {QUALIFIED} AS q, {KIND} AS kind, k % 20 AS pos, sz > 12 AS exported FROM p2),
fi AS (SELECT DISTINCT path FROM sy),
im AS (SELECT path, pos, name, {SPECIFIER} AS spec FROM (SELECT *, {path_of('f + 1 + k % 7')} AS aim FROM sy WHERE {IMPORTED})),
ca AS (SELECT path, l_orderkey * 10 + l_linenumber AS pos, CASE WHEN l_quantity < 5 THEN '' ELSE q END AS caller, called, {CALLEE} AS txt, {RECEIVER} AS receiver
  FROM lineitem JOIN sy ON k = l_partkey JOIN (SELECT k AS k2, name AS called FROM sy) ON k2 = l_suppkey),
sp AS (SELECT DISTINCT path, spec, regexp_replace(spec, '^([.][.]/)+', '') AS t FROM im),
ex(e) AS (VALUES (['.ts', '.tsx', '.mts', '.cts', '.js', '.jsx', '.mjs', '.cjs'])),
pr AS (SELECT path, spec, [t, CASE WHEN t LIKE '%.mjs' THEN t[:-4] || 'mts' WHEN t LIKE '%.cjs' THEN t[:-4] || 'cts' WHEN t LIKE '%.jsx' THEN t[:-4] || 'tsx' WHEN t LIKE '%.js' THEN t[:-3] || 'ts' END]
  || list_transform(e, lambda x: t || x) || list_transform(e, lambda x: t || '/index' || x) AS c FROM sp, ex WHERE starts_with(spec, '.')),
rs AS (SELECT pr.path, spec, fi.path AS target FROM (SELECT path, spec, unnest(c) AS one, generate_subscripts(c, 1) AS o FROM pr) pr JOIN fi ON fi.path = one
  QUALIFY row_number() OVER (PARTITION BY pr.path, spec ORDER BY o) = 1),
here AS (SELECT path, name, arg_min(q, pos) AS q FROM sy GROUP BY 1, 2),
pub AS (SELECT path, name, arg_min(q, pos) AS q FROM sy WHERE exported GROUP BY 1, 2),
sc AS (SELECT path, name, target FROM (SELECT path, name, arg_min(spec, pos) AS spec FROM im GROUP BY 1, 2) JOIN rs USING (path, spec)),
th AS (SELECT sc.path, sc.name, target, q FROM sc JOIN pub ON pub.path = target AND pub.name = sc.name),
he AS (SELECT CASE sz % 2 WHEN 0 THEN 'INHERITS' ELSE 'IMPLEMENTS' END AS kind, q AS own, path, CASE sz % 2 WHEN 0 THEN 'small_ring' ELSE 'toString' END AS name FROM sy WHERE kind = 'class'),
hl AS (SELECT kind, own, coalesce(here.q, th.q) AS dst, CASE WHEN here.q IS NULL THEN 0.9 ELSE 0.95 END AS conf
  FROM he LEFT JOIN here USING (path, name) LEFT JOIN th ON th.path = he.path AND th.name = he.name WHERE coalesce(here.q, th.q) IS NOT NULL),
cl AS (SELECT ca.path, ca.pos, receiver, txt, called, CASE WHEN caller = '' THEN 'file:' || ca.path ELSE caller END AS who,
    CASE receiver WHEN 'identifier' THEN coalesce(here.q, th.q) WHEN 'property' THEN pub.q WHEN 'this' THEN sib.q END AS dst,
    CASE WHEN (receiver = 'identifier' AND here.q IS NOT NULL) OR receiver = 'this' THEN 0.95 ELSE 0.9 END AS conf
  FROM ca LEFT JOIN here ON here.path = ca.path AND here.name = called LEFT JOIN th ON th.path = ca.path AND th.name = called
  LEFT JOIN pub ON pub.path = th.target AND pub.name = 'small_ring'
  LEFT JOIN (SELECT DISTINCT path, q FROM sy) sib ON sib.path = ca.path AND contains(caller, '#C.') AND sib.q = ca.path || '#C.' || called),
e0 AS (SELECT DISTINCT 'CONTAINS' AS kind, 'file:' || path AS src, 'sym:' || q AS dst, 1.0 AS conf FROM sy UNION SELECT 'IMPORTS', 'file:' || path, 'file:' || target, 1.0 FROM rs
  UNION SELECT kind, 'sym:' || own, 'sym:' || dst, conf FROM hl
  UNION SELECT 'CALLS', src, dst, arg_min(conf, pos) FROM (SELECT CASE WHEN starts_with(who, 'file:') THEN who ELSE 'sym:' || who END AS src, 'sym:' || dst AS dst, conf, pos FROM cl WHERE dst IS NOT NULL) GROUP BY 2, 3),
tb AS (SELECT src, dst, 0.8 AS conf FROM e0 WHERE kind = 'IMPORTS' AND src LIKE 'file:test/%' AND dst NOT LIKE 'file:test/%'),
tn AS (SELECT 'file:' || path AS src, 'file:src/' || regexp_extract(path, 'm[0-9]+') || '.js' AS dst, 0.7 AS conf FROM fi
  WHERE path LIKE 'test/%' AND 'file:' || path NOT IN (SELECT src FROM tb) AND 'src/' || regexp_extract(path, 'm[0-9]+') || '.js' IN (SELECT path FROM fi)),
ed AS (SELECT kind, src, dst, CAST(conf AS DOUBLE) AS confidence, 'extracted' AS tier FROM e0 UNION ALL SELECT 'TESTED_BY', src, dst, CAST(conf AS DOUBLE), 'inferred' FROM (SELECT * FROM tb UNION ALL SELECT * FROM tn)),
gd AS (SELECT dst[5:] AS q, count(*) AS n, bool_or(src LIKE 'sym:%' AND split_part(src[5:], '#', 1) <> split_part(dst[5:], '#', 1)) AS far FROM ed
  WHERE kind = 'CALLS' AND split_part(split_part(dst, '#', 2), '.', -1) <> 'toString' GROUP BY 1),
god AS (SELECT q, n FROM gd WHERE far OR q IN (SELECT q FROM sy WHERE exported))
"""


@query(CODE_SQL + "SELECT * FROM ed")
def code_edges(spark: SparkSession, d: str) -> DataFrame:
    """Every edge: containment, imports, calls, heritage, tests."""
    r = Reading(spark, d)
    return r.graph().edges


@query(CODE_SQL + "SELECT 'file:' || path AS id, 'file' AS kind FROM fi UNION SELECT 'sym:' || q, 'symbol' FROM sy")
def code_nodes(spark: SparkSession, d: str) -> DataFrame:
    r = Reading(spark, d)
    return r.graph().nodes


@query(CODE_SQL + """, out AS (SELECT path, name FROM im WHERE spec = 'lodash')
SELECT who AS caller, CAST(count(*) AS BIGINT) AS n FROM cl WHERE dst IS NULL AND NOT EXISTS (SELECT 1 FROM out WHERE out.path = cl.path AND out.name = CASE receiver WHEN 'property' THEN called ELSE txt END)
GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50""")
def unresolved_census(spark: SparkSession, d: str) -> DataFrame:
    """The 50 callers with most calls that lead nowhere, without those of external names."""
    r = Reading(spark, d)
    found = r.graph().unresolved.select("caller", F.col("count").alias("n"))
    return found.orderBy(F.desc("n"), T.utf16_key("caller")).limit(50)


@query(CODE_SQL + "SELECT path, spec AS module_specifier, NOT starts_with(spec, '.') AS external, target FROM (SELECT DISTINCT path, spec FROM im) LEFT JOIN rs USING (path, spec)")
def resolved_imports(spark: SparkSession, d: str) -> DataFrame:
    r = Reading(spark, d)
    return E.resolve_imports(r.imports, r.files)


@query(CODE_SQL + "SELECT path, spec AS module_specifier, array_to_string(list_filter(c, lambda x: x IS NOT NULL), ' ') AS candidates FROM pr")
def import_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The paths an import may mean, first choice first."""
    r = Reading(spark, d)
    asked = r.imports.select("path", "module_specifier").distinct()
    asked = asked.withColumn("c", P.import_candidates("path", "module_specifier")).where("c IS NOT NULL")
    return asked.select("path", "module_specifier", F.array_join("c", " ").alias("candidates"))


@query(CODE_SQL + """, x AS (SELECT src AS a, dst AS b, 1.0 AS w FROM ed WHERE kind = 'CALLS' AND src LIKE 'sym:%'
  UNION ALL SELECT s.dst, t.dst, 0.5 FROM ed i JOIN ed s ON s.src = i.src AND s.kind = 'CONTAINS' JOIN ed t ON t.src = i.dst AND t.kind = 'CONTAINS' WHERE i.kind = 'IMPORTS')
SELECT least(a, b) AS a, greatest(a, b) AS b, CAST(max(w) AS DOUBLE) AS weight FROM x WHERE a <> b GROUP BY 1, 2""")
def symbol_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Links between symbols: calls, and imports between their files."""
    r = Reading(spark, d)
    return G.symbol_pairs(r.graph().edges)


@query(CODE_SQL + "SELECT q AS qualified_name, CAST(n AS BIGINT) AS score FROM god")
def code_hubs(spark: SparkSession, d: str) -> DataFrame:
    """Hubs without noise names (``toString``) that are exported or called from another file."""
    r = Reading(spark, d)
    return G.god_symbols(r.graph().edges, r.symbols)


@query(CODE_SQL + """SELECT DISTINCT q AS qualified_name, CAST(0.6 AS DOUBLE) AS confidence FROM sy
WHERE exported AND path NOT LIKE 'test/%' AND path NOT LIKE '%/index.ts' AND kind <> 'interface' AND 'sym:' || q NOT IN (SELECT dst FROM ed WHERE kind = 'CALLS') ORDER BY 1 LIMIT 50""")
def dead_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Exported values that nothing calls, of all calls of the line table; the 50 first by name."""
    r = Reading(spark, d)
    once = r.symbols.where(~F.col("kind").isin(G.TYPE_ONLY)).where("exported").dropDuplicates(["qualified_name"])
    return G.dead_code(r.graph().edges, once)


@query(CODE_SQL + "SELECT path FROM fi WHERE path NOT LIKE 'scripts/%' AND 'file:' || path NOT IN (SELECT dst FROM ed WHERE kind = 'TESTED_BY')")
def code_test_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Files that no test covers; scripts are left out."""
    r = Reading(spark, d)
    return G.test_gaps(r.graph().edges, r.symbols)


@query(CODE_SQL + """SELECT CAST(count(*) FILTER (src NOT IN (SELECT 'file:' || path FROM fi UNION SELECT 'sym:' || q FROM sy WHERE pos < 15)) AS BIGINT) AS missing_sources,
  CAST(count(*) FILTER (dst NOT IN (SELECT 'file:' || path FROM fi UNION SELECT 'sym:' || q FROM sy WHERE pos < 15)) AS BIGINT) AS missing_targets FROM ed""")
def code_integrity(spark: SparkSession, d: str) -> DataFrame:
    """Edge ends that are missing once the last five symbols of each file are taken away."""
    r = Reading(spark, d)
    some = E.build_graph(r.files, r.symbols.where("pos < 15"), r.imports, r.calls.where("false")).nodes
    return G.integrity(some, r.graph().edges)


@query(CODE_SQL + """SELECT CASE WHEN ends_with(path, '.js') THEN 'javascript' ELSE 'typescript' END AS language, CAST(count(DISTINCT path) AS BIGINT) AS files,
  CAST(count(DISTINCT split_part(path, '/', 1)) AS BIGINT) AS dirs, CAST(count(*) AS BIGINT) AS symbols FROM sy GROUP BY 1""")
def code_languages(spark: SparkSession, d: str) -> DataFrame:
    """Files, top directories and symbols of each language."""
    r = Reading(spark, d)
    return V.language_rows(r.files, r.symbols)


@query(CODE_SQL + """SELECT CASE WHEN path LIKE 'test/%' THEN 'test' WHEN path LIKE 'src/%/index.ts' THEN 'entry' ELSE 'other' END AS layer, string_agg('file:' || path, ' ' ORDER BY path) AS nodes FROM fi GROUP BY 1""")
def code_layers(spark: SparkSession, d: str) -> DataFrame:
    """The sorted files of each layer."""
    return V.layer_nodes(Reading(spark, d).files).withColumn("nodes", F.array_join("nodes", " "))


@query(CODE_SQL + """SELECT path, CAST(3 AS INT) AS score, CAST(row_number() OVER (ORDER BY path) AS INT) AS rank FROM fi WHERE path LIKE 'src/%/index.ts'""")
def code_entries(spark: SparkSession, d: str) -> DataFrame:
    """Entry points, best first."""
    return V.entry_ranking(Reading(spark, d).files)


@query(CODE_SQL + """, n AS (SELECT path, count(*) AS n FROM sy GROUP BY 1), top AS (SELECT * FROM n ORDER BY n DESC, path LIMIT 20)
SELECT path, q AS qualified_name, CAST(row_number() OVER (PARTITION BY path ORDER BY q, pos) AS INT) AS rank FROM sy JOIN top USING (path) WHERE kind <> 'method' QUALIFY rank <= 10""")
def code_outlines(spark: SparkSession, d: str) -> DataFrame:
    """The first ten symbols, no members, of each of the 20 fullest files."""
    r = Reading(spark, d)
    return V.outline_rows(r.files, r.symbols, 20, 10).select("path", "qualified_name", "rank")


@query(CODE_SQL + """, l AS (SELECT l_partkey, CAST(l_quantity AS BIGINT) + l_linenumber AS c FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) <= 50)),
ch AS (SELECT path, sum(c) AS c FROM l JOIN sy ON k = l_partkey GROUP BY 1),
fan AS (SELECT dst[5:] AS q, count(*) AS n, bool_or(split_part(regexp_replace(src, '^(sym|file):', ''), '/', 1) <> split_part(dst[5:], '/', 1)) AS far FROM ed WHERE kind = 'CALLS' GROUP BY 1),
one AS (SELECT DISTINCT q, name, path FROM sy), top AS (SELECT (SELECT max(c) FROM ch) AS mc, (SELECT max(n) FROM fan) AS mn)
SELECT q AS qualified_name, CAST(round(CASE WHEN 'file:' || path IN (SELECT dst FROM ed WHERE kind = 'TESTED_BY') THEN 0 ELSE 0.3 END::DOUBLE + CASE WHEN name = 'authToken' THEN 0.2 ELSE 0 END::DOUBLE
  + least(0.15::DOUBLE, coalesce(c, 0) / mc::DOUBLE * 0.15::DOUBLE) + CASE WHEN far THEN 0.15 ELSE 0 END::DOUBLE + least(0.1::DOUBLE, coalesce(n, 0) / mn::DOUBLE * 0.1::DOUBLE), 4) AS DOUBLE) AS total_risk
FROM one CROSS JOIN top LEFT JOIN ch USING (path) LEFT JOIN fan USING (q)""")
def code_risk(spark: SparkSession, d: str) -> DataFrame:
    """Risk of every symbol of the graph, with churn by the file of a part."""
    r = Reading(spark, d)
    edges = materialize(r.graph().edges, "code_edges")
    log = dealt(r.lines, r.tasks, "l_partkey").join(r.parts.select(F.col("k").alias("l_partkey"), "path").hint("merge"), "l_partkey")
    added = F.col("l_quantity").cast("long").cast("string").alias("added")
    log = log.select(F.col("l_orderkey").alias("commit_no"), added, F.col("l_linenumber").cast("string").alias("deleted"), "path")
    churn = materialize(history.churn(log), "churn")
    once = r.symbols.select("qualified_name", "name", "path").distinct()
    return R.risk(once, edges, churn, R.most(churn, edges)).select("qualified_name", "total_risk")


@query(CODE_SQL + """, sd AS (SELECT 'sym:' || q AS id FROM sy WHERE sz = 17 UNION SELECT 'file:' || path FROM sy WHERE sz = 40),
bk AS (SELECT src, dst, max(CASE kind WHEN 'CALLS' THEN 0.5 ELSE 0.4 END) AS w FROM ed WHERE kind IN ('CALLS', 'IMPORTS') GROUP BY 1, 2),
l1 AS (SELECT src AS id, max(w) AS score FROM bk JOIN sd ON dst = id WHERE src NOT IN (SELECT id FROM sd) GROUP BY 1),
l2 AS (SELECT src AS id, max(score * w) AS score FROM bk JOIN l1 ON dst = id WHERE src NOT IN (SELECT id FROM sd UNION ALL SELECT id FROM l1) GROUP BY 1),
l3 AS (SELECT src AS id, max(score * w) AS score FROM bk JOIN l2 ON dst = id WHERE src NOT IN (SELECT id FROM sd UNION ALL SELECT id FROM l1 UNION ALL SELECT id FROM l2) GROUP BY 1)
SELECT id, CAST(depth AS INT) AS depth, CAST(round(score, 6) AS DOUBLE) AS score FROM (SELECT *, 1 AS depth FROM l1 UNION ALL SELECT *, 2 FROM l2 UNION ALL SELECT *, 3 FROM l3) WHERE score >= 0.05""")
def code_impact(spark: SparkSession, d: str) -> DataFrame:
    """What depends on the symbols of size 17 and the files of those of size 40, up to three hops back."""
    r = Reading(spark, d)
    s = r.parts
    seeds = s.where("sz = 17").select(E.sym_id(F.col("q")).alias("id")).union(s.where("sz = 40").select(E.file_id(F.col("path"))))
    return G.impact(r.graph().edges, seeds).select("id", "depth", F.round("score", 6).alias("score"))


INTENT = "find the authToken of small_ring"


RANKING_SQL = CODE_SQL + """, tm(t) AS (VALUES ('find'), ('auth'), ('token'), ('small'), ('ring')),
ts AS (SELECT q, max(exported::INT + p + CASE WHEN lower(name) = 'small_ring' OR ends_with(lower(q), 'small_ring') THEN 15 ELSE 0 END) AS s FROM (
  SELECT k, q, name, exported, sum(3 * contains(lower(name), t)::INT + 2 * contains(lower(q), t)::INT + 2 * contains(lower(path), t)::INT + contains(lower(kind || ' ' || name || ' '), t)::INT) AS p FROM sy, tm GROUP BY ALL) GROUP BY 1),
chg AS (SELECT DISTINCT q FROM sy WHERE sz = 17),
nb AS (SELECT DISTINCT q FROM sy WHERE path IN (SELECT target FROM rs WHERE path IN (SELECT split_part(q, '#', 1) FROM chg))),
r1 AS (SELECT q, row_number() OVER (ORDER BY s DESC, q) AS r FROM ts), r2 AS (SELECT q, row_number() OVER (ORDER BY n DESC, q) AS r FROM god),
r3 AS (SELECT q, row_number() OVER (ORDER BY q) AS r FROM chg), r4 AS (SELECT q, row_number() OVER (ORDER BY q) AS r FROM nb)
SELECT q AS qualified_name, CAST(round(1.0::DOUBLE / (60 + r1.r) + coalesce(1.0::DOUBLE / (60 + r2.r), 0) + coalesce(1.0::DOUBLE / (60 + r3.r), 0) + coalesce(1.0::DOUBLE / (60 + r4.r), 0), 12) AS DOUBLE) AS score
FROM r1 LEFT JOIN r2 USING (q) LEFT JOIN r3 USING (q) LEFT JOIN r4 USING (q)"""


@query(RANKING_SQL)
def code_ranking(spark: SparkSession, d: str) -> DataFrame:
    """All symbols by four fused lists: words of a request, hubs, changed symbols (those of size 17), their imports."""
    r = Reading(spark, d)
    s, edges = r.symbols, materialize(r.graph().edges, "code_edges")
    changed = r.parts.where("sz = 17").select(F.col("q").alias("qualified_name")).distinct()
    found = rank.rank_symbols(s, INTENT, edges, changed, G.god_symbols(edges, s))
    return found.select("qualified_name", F.round("score", 12).alias("score"))


@query(RANKING_SQL + " ORDER BY 2 DESC, 1 LIMIT 40")
def code_top_symbols(spark: SparkSession, d: str) -> DataFrame:
    """The 40 best of the same ranking, from the heads of its lists and counted places."""
    r = Reading(spark, d)
    s, edges = r.symbols, materialize(r.graph().edges, "code_edges")
    changed = r.parts.where("sz = 17").select(F.col("q").alias("qualified_name")).distinct()
    found = rank.top_symbols(s, INTENT, edges, changed, G.god_symbols(edges, s), 40)
    return found.select("qualified_name", F.round("score", 12).alias("score"))


@query(CODE_SQL + """SELECT CAST((SELECT count(*) FROM fi) AS BIGINT) AS files, CAST((SELECT count(*) FROM sy) AS BIGINT) AS symbols, CAST((SELECT count(*) FROM ed) AS BIGINT) AS edges""")
def code_totals(spark: SparkSession, d: str) -> DataFrame:
    """Files, symbols and edges of the graph."""
    r = Reading(spark, d)
    return V.totals(r.files, r.symbols, r.graph().edges)


@query(CODE_SQL + """, g AS (SELECT kind, count(DISTINCT q) AS n FROM sy GROUP BY 1), one AS (SELECT DISTINCT kind, q, path FROM sy),
f AS (SELECT kind, path, row_number() OVER (PARTITION BY kind ORDER BY count(*) DESC, path) AS r FROM one GROUP BY 1, 2 QUALIFY r <= 5)
SELECT kind AS id, CAST(any_value(g.n) AS INT) AS members, string_agg(path, ' ' ORDER BY r) AS top_files FROM g JOIN f USING (kind) GROUP BY 1""")
def code_group_files(spark: SparkSession, d: str) -> DataFrame:
    """The five fullest files of each group of symbols; the kind of a symbol is its group."""
    r = Reading(spark, d)
    own = r.symbols.select(F.col("qualified_name").alias("member"), F.col("kind").alias("community")).distinct()
    top = V.group_files(own, r.symbols).groupBy("community").agg(F.array_sort(F.collect_list(F.struct("rank", "path"))).alias("f"))  # five
    sizes = own.groupBy("community").agg(F.count(F.lit(1)).cast("int").alias("members"))
    return sizes.join(top, "community").select(F.col("community").alias("id"), "members", F.array_join(F.col("f.path"), " ").alias("top_files"))


@query(CODE_SQL + """, g AS (SELECT DISTINCT kind, q FROM sy), fan AS (SELECT dst[5:] AS q, count(*) AS n FROM ed WHERE kind = 'CALLS' GROUP BY 1)
SELECT kind AS community, q AS member, CAST(coalesce(n, 0) AS BIGINT) AS n FROM g LEFT JOIN fan USING (q) QUALIFY row_number() OVER (PARTITION BY kind ORDER BY coalesce(n, 0) DESC, q) = 1""")
def code_group_hubs(spark: SparkSession, d: str) -> DataFrame:
    """The most-called member of each group of symbols; the kind of a symbol is its group."""
    r = Reading(spark, d)
    own = r.symbols.select(F.col("qualified_name").alias("member"), F.col("kind").alias("community")).distinct()
    return V.group_hubs(own, r.graph().edges)


@query(CODE_SQL + "SELECT path, CAST(count(*) AS BIGINT) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, path) AS INT) AS rank FROM sy GROUP BY 1 QUALIFY rank <= 5")
def code_outline_hubs(spark: SparkSession, d: str) -> DataFrame:
    """The five files with most symbols."""
    r = Reading(spark, d)
    return V.fullest_files(r.files, r.symbols, 5)


@query(CODE_SQL + """, one AS (SELECT DISTINCT kind, q FROM sy), fan AS (SELECT dst[5:] AS q, count(*) AS n FROM ed WHERE kind = 'CALLS' GROUP BY 1),
big AS (SELECT kind FROM one GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
hit AS (SELECT src[5:] AS src, dst[5:] AS dst FROM ed WHERE kind = 'CALLS' AND src LIKE 'sym:%' AND split_part(src[5:], '#', 1) <> split_part(dst[5:], '#', 1) ORDER BY 1, 2 LIMIT 1)
SELECT 1 AS ord, 'What depends on ' || q || '?' AS text, 'sym:' || q AS node_id FROM (SELECT q FROM god ORDER BY n DESC, q LIMIT 1)
UNION ALL SELECT 2, 'Why does ' || src || ' connect to ' || dst || '?', 'sym:' || src FROM hit
UNION ALL SELECT 3, 'What tests cover ' || path || '?', 'file:' || path FROM (SELECT min(path) AS path FROM fi WHERE path NOT LIKE 'scripts/%' AND 'file:' || path NOT IN (SELECT dst FROM ed WHERE kind = 'TESTED_BY')) WHERE path IS NOT NULL
UNION ALL SELECT 4, 'Is ' || q || ' still needed?', 'sym:' || q FROM (SELECT min(q) AS q FROM sy WHERE exported AND path NOT LIKE 'test/%' AND path NOT LIKE '%/index.ts' AND kind <> 'interface' AND 'sym:' || q NOT IN (SELECT dst FROM ed WHERE kind = 'CALLS')) WHERE q IS NOT NULL
UNION ALL SELECT 5, 'What is the role of community ' || kind || '?', 'sym:' || q FROM (SELECT kind, q FROM one JOIN big USING (kind) LEFT JOIN fan USING (q) ORDER BY coalesce(n, 0) DESC, q LIMIT 1)""")
def code_questions(spark: SparkSession, d: str) -> DataFrame:
    """Five questions: the top hub, a call between files, a file without tests, a dead symbol, the largest group."""
    r = Reading(spark, d)
    edges = materialize(r.graph().edges, "code_edges")
    calls = edges.where("kind = 'CALLS' AND src LIKE 'sym:%' AND dst LIKE 'sym:%'").select(G.bare("src").alias("src"), G.bare("dst").alias("dst"))
    hits = calls.where(P.file_of("src") != P.file_of("dst")).withColumn("score", F.lit(1))
    own = r.symbols.select(F.col("qualified_name").alias("member"), F.col("kind").alias("community")).distinct()
    sizes = own.groupBy("community").agg(F.count(F.lit(1)).alias("n"))
    return V.questions(G.god_symbols(edges, r.symbols), hits, edges, r.symbols, G.dead_code(edges, r.symbols), sizes, own)


@query("""
WITH RECURSIVE c AS (SELECT row_number() OVER (ORDER BY coalesce(quality, -1) DESC, doc_id) AS o, CAST(doc_id AS VARCHAR) AS id, CAST((coalesce(octet_length(encode(text)), 0) + 3) // 4 AS BIGINT) AS size
  FROM documents LEFT JOIN labels USING (doc_id)),
f(o, id, fits, rest) AS (SELECT CAST(0 AS BIGINT), CAST(NULL AS VARCHAR), false, CAST(200000 AS BIGINT) UNION ALL
  SELECT c.o, c.id, size <= rest, rest - CASE WHEN size <= rest THEN size ELSE 0 END FROM f JOIN c ON c.o = f.o + 1),
l AS (SELECT id, row_number() OVER (ORDER BY o) AS r, count(*) OVER () AS n FROM f WHERE o > 0 AND NOT fits)
SELECT id, true AS kept FROM f WHERE fits UNION ALL SELECT id, false FROM l WHERE r <= 50 UNION ALL SELECT DISTINCT '...' || (n - 50) || ' more', false FROM l WHERE n > 50""")
def evidence_pack(spark: SparkSession, d: str) -> DataFrame:
    """What a budget of 200,000 (a quarter of the bytes of a text) keeps of all documents, the good ones first,
    and what is listed as left out."""
    marks = table(spark, d, "labels").select("doc_id", "quality")
    docs = table(spark, d, "documents").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("b")).join(marks, "doc_id", "left")
    items = docs.select(F.col("doc_id").alias("id"), F.expr("CAST((b + 3) div 4 AS bigint)").alias("size"), F.lit(False).alias("clipable"), (-F.coalesce("quality", F.lit(-1))).alias("k"), "doc_id")
    return rank.packed_list(rank.greedy_pack(items, 200_000, ["k", "doc_id"]))
