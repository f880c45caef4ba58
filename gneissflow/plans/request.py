"""Requests: reading, strict validation, normalization, project overlay."""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass, field, replace

from ..errors import EngineError
from ..sources.git import git

# Limits and names of the request protocol.
PROTOCOL = 1
FOCUS = ["architecture", "symbols", "source", "graph", "review"]
LIMITS = {
    "minBudget": 128, "maxBudget": 32_000, "maxRequestBytes": 1_048_576, "maxChangedPaths": 200, "maxFileBytes": 1_000_000, "maxFiles": 10_000,
}
FLOOR = 64
OVERLAY = "gneissflow.project.json"
LISTS = ("changedPaths", "includePaths", "excludePaths")
FIELDS = {"protocolVersion", "workspace", "intent", "focus", "tokenBudget", "gitRef", "baseRef", *LISTS}


@dataclass(frozen=True)
class Request:
    workspace: str
    intent: str
    focus: list[str]
    token_budget: int
    changed: list[str] = field(default_factory=list)
    ref: str | None = None
    base: str | None = None
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)


def bad(message: str) -> EngineError:
    return EngineError("REQUEST_INVALID", message)


def canonical(raw: str) -> str | None:
    """Plain-Python twin of the column function, for request paths."""
    if not raw or "\0" in raw:
        return None
    path = raw.strip().replace("\\", "/")
    if path.startswith("/") or re.match(r"[A-Za-z]:", path):
        return None
    parts = [p for p in path.split("/") if p not in ("", ".")]
    return "/".join(parts) if parts and ".." not in parts else None


def _paths(values: list[str], what: str) -> list[str]:
    out = set()
    for raw in values:
        p = canonical(raw)
        if p is None:
            raise bad(f"invalid {what}: {raw}")
        out.add(p)
    return sorted(out, key=lambda p: p.encode("utf-16-be", "surrogatepass"))


def parse(raw: bytes, wanted: int | None = None) -> dict:
    """A request from its bytes, checked field by field; unknown fields are refused."""
    if len(raw) > LIMITS["maxRequestBytes"]:
        raise EngineError("REQUEST_TOO_LARGE", "request is larger than 1 MiB")
    try:
        value = json.loads(raw)
    except ValueError:
        raise bad("request is not JSON") from None
    if not isinstance(value, dict):
        raise bad("request is not an object")
    version = value.get("protocolVersion")
    if version != PROTOCOL or isinstance(version, bool) or (wanted is not None and wanted != version):
        raise EngineError("PROTOCOL_UNSUPPORTED", f"only protocol version {PROTOCOL} is supported")
    if extra := set(value) - FIELDS:
        raise bad(f"unknown field: {sorted(extra)[0]}")
    for name in ("workspace", "intent"):
        if not isinstance(value.get(name), str) or not value[name].strip():
            raise bad(f"{name} is missing or empty")
    focus, budget = value.get("focus"), value.get("tokenBudget")
    if not isinstance(focus, list) or not focus or any(f not in FOCUS for f in focus):
        raise bad("focus is not a list of known values")
    if isinstance(budget, bool) or not isinstance(budget, int) or not 1 <= budget <= LIMITS["maxBudget"]:
        raise bad("tokenBudget is out of range")
    for name in LISTS:
        if name in value and (not isinstance(value[name], list) or len(value[name]) > LIMITS["maxChangedPaths"] or any(not isinstance(p, str) or not p for p in value[name])):
            raise bad(f"{name} is not a list of at most {LIMITS['maxChangedPaths']} paths")
    for name in ("gitRef", "baseRef"):
        if name in value and not isinstance(value[name], str):
            raise bad(f"{name} is not text")
    return value


def normalize(value: dict) -> Request:
    intent = value["intent"].strip()
    focus = [f for f in FOCUS if f in value["focus"]]
    if not intent or not focus:
        raise bad("intent or focus is empty")
    if value["tokenBudget"] < FLOOR:
        raise EngineError("BUDGET_TOO_SMALL", "token budget is below the smallest answer")
    refs = {}
    for name in ("gitRef", "baseRef"):
        if value.get(name) is not None:
            refs[name] = value[name].strip()
            if not refs[name]:
                raise bad(f"{name} is empty")
    lists = {n: _paths(value.get(n) or [], n) for n in LISTS}
    return Request(value["workspace"], intent, focus, value["tokenBudget"], lists["changedPaths"], refs.get("gitRef"), refs.get("baseRef"), lists["includePaths"], lists["excludePaths"])


def load_overlay(root: str, commit: str | None = None) -> dict | None:
    """include and exclude paths of the project's overlay file; a bad one at a commit counts as none."""
    if commit:
        raw = git(root, "cat-file", "blob", f"{commit}:{OVERLAY}", check=False)
    else:
        try:
            with open(os.path.join(root, OVERLAY), "rb") as f:
                raw = f.read(LIMITS["maxFileBytes"])
        except FileNotFoundError:
            raw = None
    if raw is None:
        return None
    try:
        value = json.loads(raw)
        if not isinstance(value, dict) or set(value) - {"includePaths", "excludePaths"} or any(not isinstance(v, list) or any(not isinstance(p, str) for p in v) for v in value.values()):
            raise bad(f"invalid {OVERLAY}")
        return {k: _paths(v, f"path in {OVERLAY}") for k, v in value.items() if v}
    except (ValueError, EngineError) as error:
        if commit:
            return None
        raise error if isinstance(error, EngineError) else bad(f"invalid JSON in {OVERLAY}") from None


def with_overlay(request: Request, overlay: dict | None) -> Request:
    """The overlay fills only what the request leaves empty."""
    overlay = overlay or {}
    return replace(request, include=request.include or overlay.get("includePaths", []), exclude=request.exclude or overlay.get("excludePaths", []))
