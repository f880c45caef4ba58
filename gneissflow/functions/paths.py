"""Path predicates and rewrites as columns."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names, extensions and patterns that decide results.
DENY = [
    ".env", ".env.*", "*.pem", "*.key", "*.p12", "*.pfx", "id_rsa", "id_rsa.*", "id_dsa", "id_ecdsa", "id_ed25519",
    "credentials", "credential", ".npmrc", ".netrc", "secrets", "secret", "*.secret", "node_modules", ".patrol", ".git",
    "coverage", "dist", "build", ".DS_Store",
]
EXTENSIONS = [".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs"]
TEST_PATH = r"(?i)(?:^|/)(?:__tests__|test|tests|__mocks__|__fixtures__)/|\.(?:test|spec)\.(?:ts|tsx|mts|cts|js|jsx|mjs|cjs)$"
ENTRY_NAME = r"(?i)^(cli|index|main|app|server)\.(ts|js|tsx|jsx|mts|cts)$"
DEAD_ENTRY = r"(?i)(?:^|/)index\.(?:ts|tsx|js|jsx|mts|cts|mjs|cjs)$"
LAYERS = ["test", "docs", "entry", "workflow", "analysis", "infra", "other"]


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def glob_regex(pattern: str) -> str:
    """``**`` is any text, ``*`` any text without a slash, the rest literal."""
    parts = re.split(r"(\*\*|\*)", pattern.replace("\\", "/"))
    return "".join({"**": ".*", "*": "[^/]*"}.get(p) or re.escape(p) for p in parts if p)


def denied(path: str | Column, patterns: Sequence[str]) -> Column:
    """A pattern with a slash fits the whole path, one without fits any segment; case is ignored."""
    posix = F.replace(_col(path), F.lit("\\"), F.lit("/"))
    whole = [glob_regex(p) for p in patterns if "/" in p.replace("\\", "/")]
    single = [glob_regex(p) for p in patterns if "/" not in p.replace("\\", "/")]
    out = F.lit(False)
    if single:
        rx = "(?is)^(?:" + "|".join(single) + ")$"
        out = out | F.exists(F.split(posix, "/"), lambda s: s.rlike(rx))
    if whole:
        out = out | posix.rlike("(?is)^(?:" + "|".join(whole) + ")$")
    return out


def deny_list(extra: Sequence[str] = (), subtree: bool = True) -> list[str]:
    """Default patterns and the given ones; with ``subtree`` a path with a slash also bars what lies below it."""
    out = [*DENY, *extra]
    return [*out, *(f"{p.rstrip('/')}/**" for p in extra if "/" in p and "*" not in p)] if subtree else out


def included(path: str | Column, prefixes: Sequence[str]) -> Column:
    """The path is one of the prefixes or lies below one; no prefixes: all."""
    p = _col(path)
    out = F.lit(not prefixes)
    for x in prefixes:
        out = out | (p == x) | p.startswith(f"{x}/")
    return out


def canonical(path: str | Column) -> Column:
    """Relative path with single slashes; null if empty, absolute, of a drive, or leading out."""
    raw = _col(path)
    posix = F.replace(F.regexp_replace(raw, r"^\s+|\s+$", ""), F.lit("\\"), F.lit("/"))
    segments = F.filter(F.split(posix, "/"), lambda s: (s != "") & (s != "."))
    bad = raw.contains("\u0000") | posix.startswith("/") | posix.rlike("^[A-Za-z]:") | F.exists(segments, lambda s: s == "..") | (F.size(segments) == 0)
    return F.when(~bad, F.array_join(segments, "/"))


def normalized(path: str | Column) -> Column:
    """Dots resolved; null if it leads out of the root or nothing is left."""
    state = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("bad"))

    def step(s: Column, seg: Column) -> Column:
        keep, up = (seg != "") & (seg != ".") & (seg != ".."), seg == ".."
        shorter = F.slice(s["out"], F.lit(1), F.greatest(F.size(s["out"]) - 1, F.lit(0)))
        out = F.when(keep, F.array_append(s["out"], seg)).when(up & (F.size(s["out"]) > 0), shorter).otherwise(s["out"])
        return F.struct(out.alias("out"), (s["bad"] | (up & (F.size(s["out"]) == 0))).alias("bad"))

    return F.aggregate(F.split(_col(path), "/"), state, step, lambda s: F.when(~s["bad"] & (F.size(s["out"]) > 0), F.array_join(s["out"], "/")))


def language(path: str | Column) -> Column:
    p = F.lower(_col(path))
    return (
        F.when(p.rlike(r"\.(ts|tsx|mts|cts)$"), "typescript").when(p.rlike(r"\.(js|jsx|mjs|cjs)$"), "javascript")
        .when(p.rlike(r"\.(md|mdx|markdown)$"), "markdown").when(p.rlike(r"\.json$"), "json").otherwise("other")
    )


def is_test(path: str | Column) -> Column:
    return _col(path).rlike(TEST_PATH)


def is_shim(path: str | Column) -> Column:
    p = _col(path)
    return F.substring_index(p, "/", 1).isin("bin", "scripts")


def is_dead_entry(path: str | Column) -> Column:
    p = _col(path)
    return p.startswith("bin/") | p.rlike(DEAD_ENTRY)


def base_name(path: str | Column) -> Column:
    return F.substring_index(_col(path), "/", -1)


def top_dir(path: str | Column, root: str | None = ".") -> Column:
    """First directory; ``root`` for files at the top (None: the file's own name)."""
    p = _col(path)
    first = F.substring_index(p, "/", 1)
    return first if root is None else F.when(p.contains("/"), first).otherwise(F.lit(root))


def parent_dir(path: str | Column) -> Column:
    p = _col(path)
    return F.when(p.contains("/"), F.regexp_extract(p, r"(?s)^(.*)/[^/]*$", 1)).otherwise(F.lit("."))


def file_of(qname: str | Column) -> Column:
    return F.substring_index(_col(qname), "#", 1)


def simple_name(qname: str | Column) -> Column:
    """Last part of the name behind ``#``; the whole text without one."""
    q = _col(qname)
    return F.when(q.contains("#"), F.substring_index(F.element_at(F.split(q, "#"), 2), ".", -1)).otherwise(q)


def layer(path: str | Column) -> Column:
    """First of the ordered rules that fits."""
    p = _col(path)
    near = p.startswith("src/") | ~p.contains("/")
    return (
        F.when(p.rlike(r"^(test|tests|__tests__|spec|specs)/") | p.rlike(r"\.(test|spec)\."), "test")
        .when(p.rlike(r"^(docs|documentation)/") | p.rlike(r"(?i)\.(md|mdx)$"), "docs")
        .when(F.substring_index(p, "/", 1).isin("bin", "cli", "cmd") | (base_name(p).rlike(ENTRY_NAME) & near), "entry")
        .when(p.rlike(r"^(pipeline|wave|workflow)/"), "workflow")
        .when(p.rlike(r"^(graph|analysis)/"), "analysis")
        .when(p.rlike(r"^(infra|git)/") | base_name(p).startswith("git"), "infra")
        .otherwise("other")
    )


def entry_score(path: str | Column) -> Column:
    p = _col(path)
    near = p.startswith("src/") | ~p.contains("/")
    return (
        F.when(F.substring_index(p, "/", 1) == "bin", 2).otherwise(0)
        + F.when(p.startswith("src/cli/"), 1).otherwise(0)
        + F.when(base_name(p).rlike(ENTRY_NAME) & near, 3).otherwise(0)
    )


def import_candidates(source: str | Column, specifier: str | Column) -> Column:
    """Paths a relative import may mean, first choice first; null: the import is external."""
    src, spec = _col(source), _col(specifier)
    joined = F.when(src.contains("/"), F.concat(parent_dir(src), F.lit("/"), spec)).otherwise(spec)
    target = normalized(joined)

    def probes(t: Column) -> Column:
        swap = (
            F.when(t.endswith(".mjs"), F.regexp_replace(t, r"\.mjs$", ".mts")).when(t.endswith(".cjs"), F.regexp_replace(t, r"\.cjs$", ".cts"))
            .when(t.endswith(".jsx"), F.regexp_replace(t, r"\.jsx$", ".tsx")).when(t.endswith(".js"), F.regexp_replace(t, r"\.js$", ".ts"))
        )
        return F.array_compact(F.array(t, swap, *[F.concat(t, F.lit(e)) for e in EXTENSIONS], *[F.concat(t, F.lit(f"/index{e}")) for e in EXTENSIONS]))

    def tried(t: Column) -> Column:
        shim = src.startswith("bin/") & t.startswith("dist/")
        return F.when(shim, F.concat(probes(t), probes(F.substring(t, 6, 1 << 20)))).otherwise(probes(t))

    # the path is needed in many places: bound once by a one-element array
    all_ = F.get(F.transform(F.array(target), tried), F.lit(0))
    return F.when((spec.startswith("./") | spec.startswith("../")) & target.isNotNull(), all_)


def test_subjects(path: str | Column) -> Column:
    """Files a test file may stand for by its name, first choice first."""
    p = _col(path)
    stem = F.regexp_extract(p, r"(?i)^(.+)\.(test|spec)\.(ts|tsx|mts|cts|js|jsx|mjs|cjs)$", 1)
    near = F.when(stem != "", F.array(*[F.concat(stem, F.lit(e)) for e in EXTENSIONS])).otherwise(F.array().cast("array<string>"))
    rx = r"(?i)^((?:.+/)?)(?:__tests__|test|tests)/(.+\.(?:ts|tsx|mts|cts|js|jsx|mjs|cjs))$"
    whole = F.regexp_replace(F.concat(F.regexp_extract(p, rx, 1), F.regexp_extract(p, rx, 2)), r"(?i)^(.*?)\.(test|spec)\.", "$1.")
    swap = [F.regexp_replace(whole, r"\.(?:ts|tsx|mts|cts|js|jsx|mjs|cjs)$", e) for e in EXTENSIONS]
    far = F.when(p.rlike(rx), F.array(*[x for b in swap for x in (b, F.concat(F.lit("src/"), b))])).otherwise(F.array().cast("array<string>"))
    return F.concat(near, far)
