"""Listings in parts, paths they are bound to, and history in ranges."""

import json
import os
import subprocess

import pytest
from pyspark.sql import functions as F

from gneissflow.operators import history
from gneissflow.sources import git as S

FILES = [
    "a.ts", "z file.md", "src/x.ts", "src/y.js", "src/deep/er/k.ts", "src/deep/er/l.ts", "src/[x]/m.ts", "docs/one.md", "docs/two/three.md", "-odd/n.ts",
    "gone/old.ts", "lib/é.ts",
]


def put(root, path, text="x\n"):
    full = os.path.join(root, path)
    os.makedirs(os.path.dirname(full), exist_ok=True)
    with open(full, "w") as f:
        f.write(text)


def commit(root, message):
    for args in (["add", "-A", "."], ["-c", "user.email=a@b", "-c", "user.name=n", "commit", "-qm", message, "--allow-empty"]):
        subprocess.run(["git", *args], cwd=root, check=True)


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    root = str(tmp_path_factory.mktemp("listed"))
    subprocess.run(["git", "init", "-q"], cwd=root, check=True)
    for p in FILES:
        put(root, p)
    put(root, ".gitignore", "node_modules/\n*.log\n")
    commit(root, "files")
    for n in range(6):
        put(root, "src/x.ts", f"{n}\n" * (n + 1))
        put(root, f"docs/{n % 2}.md", f"{n}\n")
        commit(root, f"change {n}")
    commit(root, "nothing")
    put(root, "node_modules/m/i.ts")
    put(root, "src/deep/debug.log")
    put(root, "new/untracked.ts")
    put(root, "other/repo/f.ts")
    subprocess.run(["git", "init", "-q"], cwd=os.path.join(root, "other/repo"), check=True)
    os.remove(os.path.join(root, "gone/old.ts"))
    os.rmdir(os.path.join(root, "gone"))
    os.symlink("src", os.path.join(root, "link"))
    return root


def load(spark, title, root, **options):
    S.register(spark)
    return spark.read.format(title).options(root=root, **options).load()


def raw(root, *args):
    return sorted(p for p in subprocess.run(["git", *args, "-z"], cwd=root, check=True, capture_output=True, text=True).stdout.split("\0") if p)


@pytest.mark.parametrize("ref", [None, "HEAD"])
@pytest.mark.parametrize("listings", [2, 8, 64])
def test_parts_of_a_listing_are_the_listing(spark, repo, ref, listings, monkeypatch):
    monkeypatch.setattr(S, "LISTINGS", listings)
    want = raw(repo, "ls-tree", "-r", "--name-only", ref) if ref else raw(repo, "ls-files", "--cached", "--others", "--exclude-standard")
    o = {"root": repo} | ({"ref": ref} if ref else {})
    parts = S.GitFiles.parts(repo, o)
    assert sorted(p for part in parts for (p,) in S.GitFiles.rows(repo, o, part)) == want and len(parts) > 1
    assert sorted(r["path"] for r in load(spark, "git_files", repo, **({"ref": ref} if ref else {})).collect()) == want


UNDER = [["src/x.ts"], ["a.ts", "docs/one.md", "none"], ["src/deep"], ["src/deep/er/k.ts", "src/[x]"], ["s"], ["-odd", "lib/é.ts", "other"], ["new"], []]


@pytest.mark.parametrize("ref", [None, "HEAD"])
def test_bound_listings(spark, repo, ref):
    o = {"root": repo} | ({"ref": ref} if ref else {})
    files = [p for part in S.GitFiles.parts(repo, o) for (p,) in S.GitFiles.rows(repo, o, part)]
    for under in UNDER:
        own = o | {"under": json.dumps(under)}
        want = sorted(p for p in files if not under or any(p == u or p.startswith(f"{u}/") for u in under))
        assert sorted(p for part in S.GitFiles.parts(repo, own) for (p,) in S.GitFiles.rows(repo, own, part)) == want
    bound = load(spark, "git_files", **o | {"under": json.dumps(["src"])})
    assert bound.count() == sum(p.startswith("src/") for p in files) and bound.where("path = 'src/y.js'").count() == 1
    assert bound.count() == sum(p.startswith("src/") for p in files)  # one query leaves nothing behind for the next


def test_only_directories_that_may_hold_the_paths_are_listed(repo):
    def listed(under):
        parts = S.GitFiles.parts(repo, {"root": repo, "ref": "HEAD", "under": json.dumps(under)})
        return {p.split("/")[0] for part in parts if part[0] == "in" for p in part[1]}

    assert listed(["src/deep"]) == {"src"} and listed(["docs/two/three.md", "lib"]) == {"docs", "lib"} and listed(["a.ts"]) == set()


@pytest.mark.parametrize("width", [1, 2, 3, 5, 100])
def test_ranges_of_the_log_are_the_log(spark, repo, width):
    whole = sorted(load(spark, "git_numstat", repo).collect())
    assert sorted(load(spark, "git_numstat", repo, range=str(width)).collect()) == whole
    assert {r["commit_no"] for r in whole} == set(range(2, 9))  # the newest commit changes nothing
    assert sorted(load(spark, "git_numstat", repo, range=str(width), limit="3").collect()) == [r for r in whole if r["commit_no"] <= 3]
    assert sorted(load(spark, "git_numstat", repo, range=str(width), since="HEAD~3").collect()) == [r for r in whole if r["commit_no"] <= 3]


def test_no_commit_gives_no_log(spark, tmp_path):
    subprocess.run(["git", "init", "-q"], cwd=tmp_path, check=True)
    assert load(spark, "git_numstat", str(tmp_path)).count() == 0 and load(spark, "git_files", str(tmp_path)).count() == 0


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_ranges_add_up(spark, tmp_path, parts):
    rows = [(c, str(c % 5), "-" if c % 7 == 0 else "2", f"p{(c * k) % 11}") for c in range(60) for k in range(1, 4)]
    rows += [(60, "1", "1", f"w{k}") for k in range(51)] + [(61, None, "1", "p1"), (61, "1", "1", None)]
    log = spark.createDataFrame(rows, "commit_no long, added string, deleted string, path string")
    part = log.withColumn("part", F.col("commit_no") % parts)
    where = str(tmp_path / "kept")
    for n in [*range(parts), 0]:  # one after the other, the first one twice
        history.add_ranges(part.where(F.col("part") == n), where)
    churn, pairs = history.totals(spark, where)
    assert sorted(map(str, churn.drop("parts").collect())) == sorted(map(str, history.churn(log).collect()))
    assert sorted(pairs.drop("parts").collect()) == sorted(history.cochange(log).collect())
    assert churn.agg(F.max("parts")).first()[0] <= parts
    with pytest.raises(Exception, match="a commit without a part"):
        history.add_ranges(log.withColumn("part", F.lit(None).cast("string")), where)
