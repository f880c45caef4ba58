"""From a request to one deterministic JSON report under a token budget."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import EngineError
from ..extract.facts import Facts, extract_facts
from ..functions import paths as P
from ..functions import text as T
from ..functions.tokens import with_tokens
from ..operators import edges as E
from ..operators import graph as G
from ..operators import history, overlap, rank, verify
from ..operators import risk as R
from ..operators import sections as V
from ..operators.communities import communities
from ..scratch import materialize
from ..session import ensure_worker_path
from ..sources import git as S
from . import request as Q

PROVIDER, EXTRACTOR, POLICY = "gneissflow", "token-scanner-v1", 1
#: Order in which insights go, and how many of each are shown.
DROP = ["outlines", "referenceCensus", "routes", "deadCode", "surprises", "communities", "questions", "layers", "tour", "dirImports"]
SYMBOLS, SOURCES, OMITTED, MARGIN = 500, 200, 50, 64


@dataclass
class Scan:
    eligible: DataFrame  # path
    contents: DataFrame  # path, content, size, digest, reason
    facts: Facts
    skipped: list[dict]
    denied: int
    truncated: bool
    manifest: list[dict]
    dirty: list[dict]
    statuses: list[tuple[str, str]]
    policy_digest: str
    scripts: list[str]


@dataclass
class Analysis:
    graph: E.CodeGraph
    gods: DataFrame
    groups: DataFrame
    hits: DataFrame
    dead: DataFrame
    changed: DataFrame
    churn: DataFrame
    cochange: DataFrame
    largest: DataFrame  # one row: max_churn, max_in_degree


def descriptor() -> dict:
    return {
        "provider": PROVIDER, "protocolVersion": Q.PROTOCOL, "supportedProtocolVersions": [Q.PROTOCOL], "features": ["pack"], "focusValues": Q.FOCUS,
        "estimator": T.estimator(), "limits": Q.LIMITS, "optionalRequestFields": ["changedPaths", "gitRef", "baseRef", "includePaths", "excludePaths"],
    }


def _source(spark: SparkSession, name: str, root: str, **options) -> DataFrame:
    reader = spark.read.format(name).option("root", root)
    for k, v in options.items():
        if v is not None:
            reader = reader.option(k, v)
    return reader.load()


def scan(spark: SparkSession, ws: S.Workspace, deny: list[str], include: list[str], commit: str | None = None, most: int = Q.LIMITS["maxFiles"]) -> Scan:
    """Files by policy, their contents and facts.  Contents are read once and kept."""
    ensure_worker_path(spark)
    S.register(spark)
    listed = materialize(_source(spark, "git_files", ws.root, ref=commit).withColumn("denied", P.denied("path", deny)), "listed")
    wanted = listed.where(~F.col("denied")).where(P.included("path", include)).select("path")
    eligible = wanted.orderBy(T.utf16_key("path")).limit(most)
    read = materialize(S.read_contents(eligible.repartition(8, "path"), ws.root, commit), "contents")
    facts = extract_facts(read.where("reason IS NULL"))
    outcome = read.select("path", "digest", "reason").orderBy(T.utf16_key("path")).collect()
    skipped = [{"path": r["path"], "reason": r["reason"]} for r in outcome if r["reason"]]
    manifest = [{"path": r["path"], "digest": r["digest"]} for r in outcome if not r["reason"]]
    statuses = [] if commit else sorted((r["path"], r["status"]) for r in _source(spark, "git_status", ws.root).collect())
    touched = {p for p, _ in statuses}
    dirty = [{"path": r["path"], "digest": r["digest"] or T.digest_of({"path": r["path"], "reason": r["reason"]})} for r in outcome if r["path"] in touched]
    policy = T.digest_of({"policyVersion": POLICY, "extractor": EXTRACTOR, "denylist": deny})
    return Scan(eligible, read, facts, skipped, listed.where("denied").count(), wanted.count() > most, manifest, dirty, statuses, policy, _scripts(ws.root, commit))


def _blob(root: str, path: str, commit: str | None) -> bytes | None:
    if commit:
        reader = S.Blobs(root, commit)
        data, _ = reader.read(path)
        reader.close()
        return data
    return S.read_file(os.path.join(root, path))[0]


def _scripts(root: str, commit: str | None) -> list[str]:
    """Names of the first five scripts of the root package file."""
    try:
        value = json.loads(_blob(root, "package.json", commit) or b"{}")
    except ValueError:
        return []
    scripts = value.get("scripts") if isinstance(value, dict) else None
    return sorted(k for k, v in scripts.items() if isinstance(v, str))[:5] if isinstance(scripts, dict) else []


def analyze(spark: SparkSession, sc: Scan, root: str, deny: list[str], changed_paths: list[str], base: str | None, head: str | None) -> Analysis:
    """Graph and derived tables; what later steps read more than once is written once."""
    f = sc.facts
    g = E.build_graph(f.files, f.symbols, f.imports, f.calls, sc.eligible)
    g = E.CodeGraph(materialize(g.nodes, "nodes"), materialize(g.edges, "edges"), materialize(g.unresolved, "unresolved"))
    gods = materialize(G.god_symbols(g.edges, f.symbols), "gods")
    groups = materialize(communities(g.edges, g.nodes), "groups")
    language = f.symbols.join(f.files.select("path", "language"), "path").select(F.col("qualified_name").alias("member"), "language").distinct()
    hubs = gods.orderBy(F.desc("score"), T.utf16_key("qualified_name")).limit(5).select(F.col("qualified_name").alias("member"))
    hits = G.surprises(g.edges, G.membership(groups), hubs, language)
    log = _source(spark, "git_numstat", root, ref=head)
    log = materialize(log.where(~P.denied("path", deny)), "log")
    churn = materialize(history.churn(log), "churn")
    hunks = _source(spark, "git_diff", root, base=base, head=head).where(~P.denied("path", deny))
    paths = spark.createDataFrame([(p,) for p in changed_paths], "path string")
    hunks = hunks.join(paths, "path", "left_semi") if changed_paths else hunks
    changed = materialize(overlap.changed_symbols(hunks, f.symbols, paths).select("qualified_name").distinct(), "changed")
    most = lambda df, c, name: df.agg(F.coalesce(F.max(c), F.lit(0)).alias(name))
    largest = most(churn, "churn", "max_churn").crossJoin(most(gods, "score", "max_in_degree"))
    return Analysis(g, gods, groups, hits, G.dead_code(g.edges, f.symbols), changed, churn, history.cochange(log), largest)


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def community_rows(groups: DataFrame, symbols: DataFrame) -> list[dict]:
    """Communities, largest first, each with its five fullest files."""
    top = V.group_files(G.membership(groups), symbols).groupBy("community").agg(F.array_sort(F.collect_list(F.struct("rank", "path"))).alias("f"))  # five
    both = groups.join(top, F.col("id") == F.col("community"), "left").orderBy(F.desc("member_count"), T.utf16_key("id"))
    files = lambda r: [T.redact_py(x["path"]) for x in r["f"] or []]
    return [
        {"id": r["id"], "label": r["label"], "memberCount": r["member_count"], "topFiles": files(r), "cohesion": r["cohesion"]}
        for r in both.drop("members").collect()
    ]


def questions(a: Analysis, f: Facts) -> list[dict]:
    """Up to five questions, each from the first row of one list."""
    sizes = a.groups.select(F.col("id").alias("community"), F.col("member_count").alias("n"))
    rows = V.questions(a.gods, a.hits, a.graph.edges, f.symbols, a.dead, sizes, G.membership(a.groups)).orderBy("ord").collect()
    return [{"text": T.redact_py(r["text"]), "nodeId": T.redact_py(r["node_id"])} for r in rows]


def outlines(f: Facts) -> list[dict]:
    """The 20 files with most symbols, each with up to 30 symbols that are no members."""
    out: dict[str, list] = {}
    for r in V.outline_rows(f.files, f.symbols).orderBy("file_rank", "rank").collect():
        out.setdefault(r["path"], []).append({"qualifiedName": T.redact_py(r["qualified_name"]), "kind": r["kind"], "exported": r["exported"]})
    return [{"path": T.redact_py(p), "symbols": own} for p, own in out.items()]


def layers(files: DataFrame) -> list[dict]:
    rows = V.layer_nodes(files).orderBy(T.utf16_key("layer")).collect()
    return [{"id": f"layer:{r['layer']}", "name": r["layer"].capitalize(), "nodeIds": r["nodes"]} for r in rows]


def entry_points(files: DataFrame, n: int) -> list[str]:
    return [r["path"] for r in V.entry_ranking(files).orderBy("rank").limit(n).collect()]


def tour(a: Analysis, start: list[str]) -> list[str]:
    if not start:
        return []
    first = a.graph.nodes.where(F.col("id") == f"file:{start[0]}").select("id")
    return [r["node_id"] for r in V.tour(a.graph.edges, a.graph.nodes, first).orderBy("step").collect()]


def graph_section(a: Analysis, sc: Scan) -> dict:
    f, e = sc.facts, a.graph.edges
    hits = _rows(a.hits)
    red = T.redact_py
    routes = f.routes.orderBy(T.utf16_key("path"), "pos").collect()
    start = entry_points(f.files, 1)

    def route(r) -> dict:
        handler = red(r["handler_name"]) if r["handler_name"] else None
        return {"id": f"route:{r['path']}#{r['method']} {r['route_path']}", "method": r["method"], "path": red(r["route_path"]), "handler": handler}

    gods = a.gods.orderBy(F.desc("score"), T.utf16_key("qualified_name")).limit(20).collect()
    optional = {
        "communities": community_rows(a.groups, f.symbols),
        "routes": sorted((route(r) for r in routes), key=lambda r: r["id"]),
        "deadCode": [{"qualifiedName": red(r["qualified_name"]), "confidence": r["confidence"]} for r in a.dead.collect()],
        "surprises": [{"from": red(h["src"]), "to": red(h["dst"]), "score": h["score"], "reasons": h["reasons"]} for h in hits],
        "questions": questions(a, f),
        "outlines": outlines(f),
        "referenceCensus": [{"qualifiedName": red(r["qualified_name"]), "incomingCalls": r["n"]} for r in G.census(e, 20).collect()],
        "layers": layers(f.files),
        "tour": [{"order": i, "nodeId": x} for i, x in enumerate(tour(a, start), 1)],
        "dirImports": [{"from": r["from_dir"], "to": r["to_dir"], "count": r["n"]} for r in G.dir_imports(e).collect()],
    }
    return {
        "fileCount": f.files.count(), "symbolCount": f.symbols.count(), "edgeCount": e.count(),
        "godSymbols": [{"qualifiedName": red(r["qualified_name"]), "score": r["score"]} for r in gods],
        "boundaryFiles": [red(r["path"]) for r in G.boundary_files(e).orderBy(T.utf16_key("path")).collect()],
    } | {k: v for k, v in optional.items() if v}


def review_section(a: Analysis, sc: Scan) -> dict:
    f, red = sc.facts, T.redact_py
    last = f.symbols.groupBy("qualified_name").agg(F.max_by(F.struct("name", "path"), "pos").alias("s")).select("qualified_name", "s.*")
    risky = R.risk(last.join(a.changed, "qualified_name", "left_semi"), a.graph.edges, a.churn, a.largest).orderBy(T.utf16_key("qualified_name"))
    hit = _rows(G.impact(a.graph.edges, a.changed.select(E.sym_id(F.col("qualified_name")).alias("id"))).orderBy(F.desc("score"), T.utf16_key("id")))
    entry = lambda r: {"id": red(r["id"]), "score": r["score"]}
    return {
        "changedSymbols": [red(r["qualified_name"]) for r in a.changed.orderBy(T.utf16_key("qualified_name")).collect()],
        "risk": [{"qualifiedName": red(r["qualified_name"]), "totalRisk": r["total_risk"], "factors": r["factors"]} for r in _rows(risky)],
        "impact": {"direct": [entry(r) for r in hit if r["depth"] == 1], "transitive": [entry(r) for r in hit if r["depth"] > 1]},
        "testGaps": [red(r["path"]) for r in G.test_gaps(a.graph.edges, f.symbols).orderBy(T.utf16_key("path")).collect()],
    }


def coverage_section(a: Analysis, sc: Scan) -> dict:
    path = F.regexp_replace(P.file_of("caller"), "^file:", "")
    open_ = a.graph.unresolved.where(~P.is_test(path)).orderBy(F.desc("count"), T.utf16_key("caller")).limit(50)
    bad = G.integrity(a.graph.nodes, a.graph.edges).first()
    languages = sc.facts.files.select("language").distinct().orderBy(T.utf16_key("language"))
    return {
        "unresolvedCalls": [{"callerQualifiedName": T.redact_py(r["caller"]), "count": r["count"]} for r in open_.collect()],
        "skipped": sorted(({"path": T.redact_py(s["path"]), "reason": s["reason"]} for s in sc.skipped), key=lambda s: s["path"]),
        "truncated": sc.truncated, "languagesSeen": [r[0] for r in languages.collect()], "historyWindow": S.HISTORY,
        "graphIntegrity": {"missingSources": bad["missing_sources"], "missingTargets": bad["missing_targets"]},
    }


def architecture_text(a: Analysis, sc: Scan, focus: list[str]) -> str:
    f = sc.facts
    per = lambda c: ", ".join(f"{r[0]}: {r[1]}" for r in f.files.groupBy(c.alias("k")).count().orderBy(T.utf16_key("k")).collect()) or "none"
    names = [r["qualified_name"] for r in a.gods.orderBy(F.desc("score"), T.utf16_key("qualified_name")).limit(5).collect()]
    edge = [r["path"] for r in G.boundary_files(a.graph.edges).orderBy(T.utf16_key("path")).limit(5).collect()]
    groups = community_rows(a.groups, f.symbols)
    start = entry_points(f.files, 5)
    hubs = [r["path"] for r in V.fullest_files(f.files, f.symbols, 5).orderBy("rank").collect()] if not f.symbols.isEmpty() else []
    named = [f"{g['label'] or g['id']}" + (f":{g['topFiles'][0]}" if g["topFiles"] else "") for g in groups[:5]]
    lines = [
        f"Files: {f.files.count()} ({per(F.col('language'))})", f"Symbols: {f.symbols.count()}", f"Directories: {per(P.top_dir('path'))}",
        "Entry points: " + ", ".join(start) if start else "", "God symbols: " + ", ".join(names) if names else "",
        f"Communities: {len(groups)} ({', '.join(named)})" if groups else "",
        "Boundary files: " + ", ".join(edge) if edge else "", "Scripts: " + ", ".join(sc.scripts) if sc.scripts else "",
        "Outline hubs: " + ", ".join(T.redact_py(p) for p in hubs) if hubs else "",
    ]
    if "graph" in focus:
        lines.append("Layers: " + ", ".join(f"{r['layer'].capitalize()}: {r['n']}" for r in V.layer_counts(f.files).orderBy(T.utf16_key("layer")).collect()))
        moves = G.dir_imports(a.graph.edges, 8).collect()
        lines.append("Directory imports: " + ", ".join(f"{r['from_dir']}->{r['to_dir']}: {r['n']}" for r in moves) if moves else "")
    return "\n".join(x for x in lines if x)


def candidates(a: Analysis, sc: Scan, request: Q.Request) -> list[dict]:
    """Evidence in order: architecture, the best symbols, the best sources."""
    out = []
    if "architecture" in request.focus:
        text = architecture_text(a, sc, request.focus)
        out.append({
            "id": "arch:repository", "kind": "architecture", "title": "Repository architecture", "text": text, "provenance": "heuristic",
            "confidence": 0.7, "estimatedTokens": T.estimate_tokens_py(text), "_clip": False,
        })
    if not {"symbols", "source"} & set(request.focus):
        return out
    f = sc.facts
    best = rank.top_symbols(f.symbols, request.intent, a.graph.edges, a.changed, a.gods, SYMBOLS)
    best = best.withColumn("_r", F.struct((-F.col("score")).alias("s"), "qualified_name"))
    rows = f.symbols.join(F.broadcast(best), "qualified_name").orderBy("_r", T.utf16_key("path"), "pos").limit(SYMBOLS)  # broadcast: 500 rows
    told = F.concat_ws("\n", "signature", F.when(F.col("jsdoc") != "", F.col("jsdoc")))
    rows = rows.withColumn("sym_text", T.redact(told)).withColumn("src_text", T.redact("source"))
    for kind in ("sym", "src"):
        rows = with_tokens(rows, f"{kind}_text", f"{kind}_tokens")
    rows = rows.collect()
    for kind, prefix, column, most, clip in (("symbol", "sym", "sym_text", SYMBOLS, False), ("source", "source", "src_text", SOURCES, True)):
        if {"symbol": "symbols", "source": "source"}[kind] in request.focus:
            for r in rows[:most]:
                span = r["range"].asDict()
                out.append({
                    "id": f"{prefix}:{r['qualified_name']}#L{span['startLine']}-{span['endLine']}", "kind": kind, "title": r["name"],
                    "text": r[column], "path": r["path"], "range": span, "provenance": "extracted", "confidence": r["confidence"],
                    "estimatedTokens": r[column.replace("_text", "_tokens")], "_clip": clip,
                })
    return out


def fit_insights(sections: dict, budget: int) -> dict:
    """Insights shrink, then go one by one, until the sections fit."""
    graph = dict(sections.get("graph") or {})
    cut = 10
    while graph and T.estimate_tokens_py(T.canonical_json(sections)) > budget:
        if len(graph.get("outlines", ())) > cut:
            graph["outlines"] = graph["outlines"][:cut]
        elif "outlines" in graph and cut == 10 and len(graph["outlines"]) > 5:
            cut, graph["outlines"] = 5, graph["outlines"][:5]
        else:
            key = next((k for k in DROP if k in graph), None)
            if key is None:
                break
            del graph[key]
        sections = {**sections, "graph": dict(graph)}
    return sections


def pack_items(items: list[dict], budget: int) -> tuple[list[dict], list[dict]]:
    """Evidence that fits, and what is left out: one ordered fold over at most 701 candidates."""
    kept, left = [], []
    folded = rank.fold_pack(budget, ((x["estimatedTokens"], x["_clip"]) for x in items))
    for x, (used, fits, _) in zip(items, folded, strict=True):
        item = {k: v for k, v in x.items() if k != "_clip"}
        if not fits:
            left.append({"id": item["id"], "reason": "token-budget"})
        elif used < x["estimatedTokens"]:
            text = T.clip_py(item["text"], used)
            kept.append({**item, "text": text, "clipped": True, "estimatedTokens": T.estimate_tokens_py(text)})
        else:
            kept.append(item)
    if len(left) > OMITTED:
        left = [*left[:OMITTED], {"id": f"...{len(left) - OMITTED} more", "reason": "token-budget"}]
    return kept, left


def fit_envelope(make: Callable[[int, list, dict, list], dict], evidence: list, sections: dict, omitted: list, budget: int) -> dict:
    """Measure the whole report; drop insights, then evidence from the end, until it fits."""
    while True:
        body = make(0, evidence, sections, omitted)
        size = T.estimate_tokens_py(T.canonical_json({**body, "capsuleDigest": T.digest_of(body)}) + "\n") + MARGIN
        body = make(size, evidence, sections, omitted)
        done = {**body, "capsuleDigest": T.digest_of(body)}
        if max(size, T.estimate_tokens_py(T.canonical_json(done) + "\n")) <= budget:
            return done
        graph = sections.get("graph") or {}
        if key := next((k for k in DROP if k in graph), None):
            sections = {**sections, "graph": {k: v for k, v in graph.items() if k != key}}
        elif evidence:
            omitted = [*omitted, {"id": evidence[-1]["id"], "reason": "token-budget"}]
            evidence = evidence[:-1]
        else:
            raise EngineError("BUDGET_TOO_SMALL", "the token budget cannot hold an answer")


def verify_unchanged(spark: SparkSession, ws: S.Workspace, sc: Scan, deny: list[str], include: list[str], ref: str | None, commit: str | None) -> None:
    """The ref, or head, paths, dirty entries and dirty contents, are as they were."""
    if commit:
        same = S.resolve_ref(ws.root, ref) == commit
    else:
        statuses = spark.createDataFrame(sc.statuses, "path string, status string")
        before = scan_state(sc.contents.select("path"), statuses, sc.contents)
        listed = _source(spark, "git_files", ws.root).where(~P.denied("path", deny)).where(P.included("path", include))
        listed = listed.select("path").orderBy(T.utf16_key("path")).limit(Q.LIMITS["maxFiles"])
        now = _source(spark, "git_status", ws.root).select("path", "status")
        touched = listed.join(now.select("path").distinct(), "path", "left_semi")
        after = scan_state(listed, now, S.read_contents(touched, ws.root))
        same = S.resolve_workspace(ws.root).head == ws.head and verify.same(before, after, ["path"])
    if not same:
        raise EngineError("SOURCE_CHANGED", "the work tree changed during the analysis")


def scan_state(paths: DataFrame, statuses: DataFrame, contents: DataFrame) -> DataFrame:
    """what, path, value: one row for each path, dirty entry, and content of a dirty file."""
    dirty = contents.join(statuses.select("path").distinct(), "path", "left_semi")
    rows = paths.select(F.lit("path").alias("what"), "path", F.lit("").alias("value"))
    rows = rows.union(statuses.select(F.lit("status"), "path", "status"))
    return rows.union(dirty.select(F.lit("content"), "path", F.coalesce("digest", F.concat(F.lit("not read: "), "reason"))))


def pack(spark: SparkSession, value: dict, after_scan: Callable[[], None] | None = None) -> dict:
    """The report of one request (a checked dict, see ``request.parse``)."""
    request = Q.normalize(value)
    ws = S.resolve_workspace(request.workspace)
    commit = S.resolve_ref(ws.root, request.ref) if request.ref else None
    overlay = Q.load_overlay(ws.root, commit)
    request = Q.with_overlay(request, overlay)
    deny = P.deny_list(request.exclude)
    sc = scan(spark, ws, deny, request.include, commit)
    head = commit or ws.head
    base = S.resolve_ref(ws.root, request.base) if request.base else None
    changed, by_base = request.changed, bool(base and not request.changed)
    if by_base:
        names = _source(spark, "git_diff_names", ws.root, base=base, head=head).select(P.canonical("path").alias("path"))
        changed = [r["path"] for r in names.where("path IS NOT NULL").distinct().orderBy(T.utf16_key("path")).collect()]
    if changed:
        ok = spark.createDataFrame([(p,) for p in changed], "path string").where(~P.denied("path", deny))
        changed = [r["path"] for r in ok.orderBy(T.utf16_key("path")).collect()]
    a = analyze(spark, sc, ws.root, deny, changed, base if by_base else None, head if by_base or commit else None)
    source = T.digest_of({"head": head, "dirtyDigest": T.digest_of(sc.dirty), "fileManifest": sc.manifest})
    snapshot = {
        "projectId": ws.project_id, "workspaceId": ws.workspace_id, "head": head, "dirtyDigest": T.digest_of(sc.dirty), "sourceDigest": source,
        "snapshotDigest": T.digest_of({"sourceDigest": source, "extractor": EXTRACTOR, "policy": sc.policy_digest}), "extractorVersion": EXTRACTOR, "policyDigest": sc.policy_digest,
    }
    scope = {k: v for k, v in (("includePaths", request.include), ("excludePaths", request.exclude)) if v}
    blob = lambda p: (lambda d: None if d is None else hashlib.sha256(d).hexdigest())(_blob(ws.root, p, commit))
    target = {
        "version": 1, "head": head, **({"base": base, "diffRange": {"left": base, "right": head}} if base else {}), **scope, "sourceTreeDigest": T.digest_of(sc.manifest),
        "dirtyBlobs": sc.dirty, "policyDigest": sc.policy_digest, "packageDigest": blob("package.json"), "typescriptConfigDigest": blob("tsconfig.json"),
        "overlay": {"path": Q.OVERLAY, "digest": T.digest_of(overlay), "descriptor": overlay} if overlay is not None else None, "historyEndpoint": head, "truncated": sc.truncated,
    }
    target["manifestDigest"] = T.digest_of(target)
    items = candidates(a, sc, request)
    if after_scan:
        after_scan()
    verify_unchanged(spark, ws, sc, deny, request.include, request.ref, commit)
    evidence, omitted = pack_items(items, request.token_budget)
    refs = {k: v for k, v in (("gitRef", request.ref), ("baseRef", request.base)) if v}
    request_digest = T.digest_of({
        "protocolVersion": Q.PROTOCOL, "workspace": ws.workspace_id, "intent": request.intent, "focus": request.focus,
        "tokenBudget": request.token_budget, "changedPaths": changed, **refs, **scope,
    })
    capsule_id = "ctx-" + T.digest_of({"requestDigest": request_digest, "snapshotDigest": snapshot["snapshotDigest"], "manifestDigest": target["manifestDigest"]})[:16]
    denied = sc.denied
    big = sum(s["reason"] in ("too-large", "binary") for s in sc.skipped)
    warnings = [
        text for text, holds in (
            (f"{denied} file(s) excluded by denylist", denied), (f"{big} file(s) skipped (too-large or binary)", big),
            (f"workspace exceeds maxFiles ({Q.LIMITS['maxFiles']}); snapshot is partial", sc.truncated),
        ) if holds
    ]
    sections = {"coverage": coverage_section(a, sc)}
    if "graph" in request.focus:
        sections["graph"] = graph_section(a, sc)
    if "review" in request.focus:
        sections["review"] = review_section(a, sc)

    def make(size: int, evidence: list, sections: dict, omitted: list) -> dict:
        return {
            "schemaVersion": 1, "protocolVersion": Q.PROTOCOL, "capsuleId": capsule_id, "requestDigest": request_digest, "intent": request.intent, "focus": request.focus,
            "snapshot": snapshot, "analysisTarget": target, "budget": {"requestedTokens": request.token_budget, "estimatedTokens": size, "estimator": T.estimator()},
            "changedPaths": changed, **scope, "evidence": evidence, "sections": sections, "omitted": omitted, "warnings": warnings,
        }

    return fit_envelope(make, evidence, fit_insights(sections, request.token_budget), omitted, request.token_budget)
