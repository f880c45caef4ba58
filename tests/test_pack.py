import json
import os
import subprocess

import pytest

from gneissflow.errors import EngineError
from gneissflow.functions.text import canonical_json, estimate_tokens_py, estimator
from gneissflow.plans import request as Q
from gneissflow.plans.pack import descriptor, fit_insights, pack
from gneissflow.sources import git as S

FOCUS = ["architecture", "symbols", "source", "graph", "review"]


def write(root, path, text):
    full = os.path.join(root, path)
    os.makedirs(os.path.dirname(full), exist_ok=True)
    with open(full, "w") as f:
        f.write(text)


def commit(root, message="one"):
    for args in (["add", "-A", "-f"], ["-c", "user.email=a@b", "-c", "user.name=n", "commit", "-qm", message]):
        subprocess.run(["git", *args], cwd=root, check=True)


@pytest.fixture
def repo(tmp_path):
    root = str(tmp_path / "r")
    os.makedirs(root)
    subprocess.run(["git", "init", "-q"], cwd=root, check=True)
    write(root, "package.json", '{"scripts": {"test": "y", "build": "x"}}')
    write(root, "src/auth.ts", "export class AuthService {\n  rotate(key: string) {\n    return helper(key);\n  }\n}\nexport function helper(x: string) {\n  return x;\n}\nexport function unused() {\n  return 1;\n}\n")
    write(root, "src/index.ts", "import { AuthService, helper } from './auth.js';\nexport function main() {\n  helper('a');\n  return new AuthService().rotate('x');\n}\napp.get('/x', helper);\n")
    write(root, "test/auth.test.ts", "import { helper } from '../src/auth';\nhelper('t');\n")
    write(root, "secrets/leak.ts", "export const a = 1;")
    write(root, "data.bin", "a\0b")
    commit(root)
    return root


def ask(root, **more):
    return {"protocolVersion": 1, "workspace": root, "intent": "rotate AuthService.rotate", "focus": FOCUS, "tokenBudget": 12000, **more}


def test_sources(spark, repo):
    S.register(spark)
    load = lambda n, **o: [tuple(r) for r in spark.read.format(n).options(root=repo, **o).load().collect()]
    assert ("src/auth.ts",) in load("git_files") and load("git_files") == load("git_files", ref="HEAD")
    first = S.resolve_workspace(repo).head
    write(repo, "src/auth.ts", "export const b = 2;\n")
    write(repo, "new file.ts", "x")
    assert sorted(load("git_status")) == [("new file.ts", "?"), ("src/auth.ts", "M")]
    assert load("git_diff") == [("src/auth.ts", 1, 1)]
    commit(repo, "two")
    assert load("git_diff_names", base=first, head="HEAD") == [("new file.ts",), ("src/auth.ts",)]
    log = load("git_numstat")
    assert {n for n, *_ in log} == {1, 2} and (1, "1", "11", "src/auth.ts") in log
    with pytest.raises(EngineError, match="unknown"):
        S.resolve_ref(repo, "nope")


def test_parsers():
    assert list(S.parse_status("R  new\0old\0 M a\0?? b\0")) == [("new", " "), ("a", "M"), ("b", "?")]
    assert list(S.parse_numstat("COMMIT a\nCOMMIT b\n1\t2\tx\n-\t-\ty\n")) == [(2, "1", "2", "x"), (2, "-", "-", "y")]
    diff = "diff --git a/a/lib/x.ts b/a/lib/x.ts\n--- a/a/lib/x.ts\n+++ b/a/lib/x.ts\n@@ -1 +1,2 @@\n@@ -5,2 +7,0 @@\n@@ -9 +10 @@\n"
    assert list(S.parse_hunks(diff)) == [("a/lib/x.ts", 1, 2), ("a/lib/x.ts", 10, 10)]


def test_report(spark, repo):
    write(repo, "src/auth.ts", open(os.path.join(repo, "src/auth.ts")).read().replace("return helper(key)", "return helper(key + '1')"))
    out = pack(spark, ask(repo))
    g, r = out["sections"]["graph"], out["sections"]["review"]
    assert g["fileCount"] == 4 and g["symbolCount"] == 5 and g["godSymbols"] == [{"qualifiedName": "src/auth.ts#helper", "score": 3}]
    assert g["boundaryFiles"] == ["src/auth.ts"] and g["routes"][0]["handler"] == "helper"
    assert {d["qualifiedName"] for d in g["deadCode"]} >= {"src/auth.ts#unused"}
    assert r["changedSymbols"] == ["src/auth.ts#AuthService", "src/auth.ts#AuthService.rotate"]
    assert r["impact"]["direct"] == [] and "src/index.ts" in r["testGaps"]
    assert out["sections"]["coverage"]["skipped"] == [{"path": "data.bin", "reason": "binary"}]
    assert out["sections"]["coverage"]["graphIntegrity"] == {"missingSources": 0, "missingTargets": 0}
    assert out["warnings"] == ["1 file(s) excluded by denylist", "1 file(s) skipped (too-large or binary)"]
    assert out["evidence"][0]["id"] == "arch:repository" and "Scripts: build, test" in out["evidence"][0]["text"]
    assert estimate_tokens_py(json.dumps(out, ensure_ascii=False, separators=(",", ":"))) <= 12000
    assert pack(spark, ask(repo)) == out


def test_history_review_and_budget(spark, repo):
    first = S.resolve_workspace(repo).head
    write(repo, "src/auth.ts", open(os.path.join(repo, "src/auth.ts")).read().replace("return x", "return x + x"))
    commit(repo, "two")
    write(repo, "src/auth.ts", "broken work tree {{{")
    out = pack(spark, ask(repo, gitRef="HEAD", baseRef=first, focus=["review"]))
    assert out["changedPaths"] == ["src/auth.ts"] and out["sections"]["review"]["changedSymbols"] == ["src/auth.ts#helper"]
    assert out["sections"]["review"]["impact"]["direct"] and "graph" not in out["sections"]
    with pytest.raises(EngineError) as e:
        pack(spark, ask(repo, tokenBudget=200, gitRef="HEAD"))
    assert e.value.code == "BUDGET_TOO_SMALL"


def test_source_changed(spark, repo):
    with pytest.raises(EngineError) as e:
        pack(spark, ask(repo, focus=["architecture"]), lambda: write(repo, "src/new.ts", "export const z = 1;"))
    assert e.value.code == "SOURCE_CHANGED"


def test_requests(repo):
    code = lambda raw, **o: pytest.raises(EngineError, Q.parse, raw if isinstance(raw, bytes) else json.dumps(raw).encode(), **o).value.code
    assert code(b"{") == "REQUEST_INVALID" and code(ask(repo, extra=1)) == "REQUEST_INVALID" and code(ask(repo, intent=" ")) == "REQUEST_INVALID"
    assert code(ask(repo, protocolVersion=2)) == "PROTOCOL_UNSUPPORTED" and code(json.dumps(ask(repo)).encode(), wanted=2) == "PROTOCOL_UNSUPPORTED"
    assert code(ask(repo, focus=["x"])) == "REQUEST_INVALID" and code(b" " * (1 << 20) + b"x") == "REQUEST_TOO_LARGE"
    assert pytest.raises(EngineError, Q.normalize, ask(repo, tokenBudget=63)).value.code == "BUDGET_TOO_SMALL"
    assert pytest.raises(EngineError, Q.normalize, ask(repo, changedPaths=["../a"])).value.code == "REQUEST_INVALID"
    r = Q.normalize(ask(repo, changedPaths=["./b", "a", "b"], focus=["review", "symbols"]))
    assert r.changed == ["a", "b"] and r.focus == ["symbols", "review"]
    write(repo, Q.OVERLAY, '{"includePaths": ["src"]}')
    assert Q.with_overlay(r, Q.load_overlay(repo)).include == ["src"]
    write(repo, Q.OVERLAY, "{")
    assert pytest.raises(EngineError, Q.load_overlay, repo).value.code == "REQUEST_INVALID"
    assert pytest.raises(EngineError, S.resolve_workspace, "/nonexistent").value.exit_code == 1
    limits = descriptor()["limits"]
    assert limits["maxFiles"] == 10_000 and (limits["minBudget"], limits["maxBudget"]) == (128, 32_000)
    assert descriptor()["estimator"] == estimator()


def test_insights_shrink_then_go():
    many = {"coverage": {"a": 1}, "graph": {"fileCount": 1, "outlines": [{"path": "p" * 40}] * 20, "tour": [1] * 5}}
    ten = {**many, "graph": {**many["graph"], "outlines": many["graph"]["outlines"][:10]}}
    size = estimate_tokens_py(canonical_json(ten))  # exactly what ten outlines need
    assert len(fit_insights(many, size)["graph"]["outlines"]) == 10 and "outlines" not in fit_insights(many, 20)["graph"]
    assert fit_insights(many, 0) == {"coverage": {"a": 1}, "graph": {"fileCount": 1}}


def test_git_output_has_a_limit(repo):
    assert S.git(repo, "ls-files", most=10_000).startswith(b"data.bin")
    assert S.git(repo, "ls-files", check=False, most=5) is None
    with pytest.raises(EngineError, match="output over 5 bytes"):
        S.git(repo, "ls-files", most=5)
