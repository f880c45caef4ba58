"""Git as Spark data sources: files, status, commit log, diff hunks, changed names, blobs.

``register(spark)`` makes ``spark.read.format("git_files").option("root", ...)`` and the others
available.  Files are listed by one Git process for each group of directories, the log by one for
each range of commits; status and diffs are one process each.  ``git_files`` takes ``under``, a JSON
list of files and directories: only directories that may hold them are listed, and no other path is
emitted.  This is an option and no ``pushFilters`` on purpose: Spark 4.1.2 keeps a Python reader with
the filters of one query for the next query of the same DataFrame, which then loses rows.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import stat
import subprocess
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..errors import EngineError
from ..functions.text import digest_of

MAX_BYTES = 1_000_000
MAX_OUTPUT = 64 << 20  # of one Git command
HISTORY = 2000
RANGE = 250  # commits that one task of the log reads
LISTINGS = 64  # most directories that are listed by tasks of their own; more are put together
HUNK = re.compile(r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@")


GIT = ["git", "-c", "core.quotepath=off", "-c", "core.fsmonitor=false"]


def neutral_env() -> dict[str, str]:
    """The environment without Git's own variables, system or user configuration."""
    env = {k: v for k, v in os.environ.items() if not k.upper().startswith("GIT_")}
    return env | {"GIT_CONFIG_NOSYSTEM": "1", "GIT_CONFIG_GLOBAL": os.devnull, "GIT_TERMINAL_PROMPT": "0", "GIT_OPTIONAL_LOCKS": "0", "LC_ALL": "C"}


def git(root: str, *args: str, check: bool = True, most: int = MAX_OUTPUT) -> bytes | None:
    """Output of a Git command in a neutral environment; None if it fails and ``check`` is off.

    A command that writes more than ``most`` bytes is stopped and counts as failed.
    """
    with tempfile.TemporaryFile() as errors, subprocess.Popen([*GIT, *args], cwd=root, env=neutral_env(), stdout=subprocess.PIPE, stderr=errors) as run:
        out = run.stdout.read(most + 1)
        if len(out) > most:
            run.kill()
        run.wait()
        if not run.returncode and len(out) <= most:
            return out
        errors.seek(0)
        why = f"output over {most} bytes" if len(out) > most else errors.read(300).decode(errors="replace").strip()
    if check:
        raise EngineError("WORKSPACE_INVALID", f"git {args[0]} failed: {why}")
    return None


@dataclass(frozen=True)
class Workspace:
    root: str
    project_id: str
    workspace_id: str
    head: str


def resolve_workspace(path: str) -> Workspace:
    """Top level, head and two stable ids of the work tree that holds ``path``."""
    if not os.path.isdir(path):
        raise EngineError("WORKSPACE_INVALID", f"no such directory: {path}")
    top = git(path, "rev-parse", "--show-toplevel", check=False)
    head = git(path, "rev-parse", "HEAD", check=False)
    if top is None or head is None:
        raise EngineError("WORKSPACE_INVALID", f"not a Git work tree with a commit: {path}")
    root = top.decode().strip()
    common = os.path.realpath(os.path.join(root, git(root, "rev-parse", "--git-common-dir").decode().strip()))
    return Workspace(root, digest_of({"t": "project", "path": common}), digest_of({"t": "workspace", "path": os.path.realpath(root)}), head.decode().strip())


def resolve_ref(root: str, ref: str) -> str:
    found = None if ref.startswith("-") else git(root, "rev-parse", "--verify", "--quiet", "--end-of-options", f"{ref}^{{commit}}", check=False)
    if found is None:
        raise EngineError("REQUEST_INVALID", f"unknown Git ref: {ref}")
    return found.decode().strip()


def parse_status(raw: str) -> Iterator[tuple[str, str]]:
    """(path, status) of ``status --porcelain -z``; a rename gives its new name."""
    parts = raw.split("\0")
    i = 0
    while i < len(parts):
        entry = parts[i]
        i += 1
        if len(entry) < 4:
            continue
        x, y = entry[0], entry[1]
        if x in "RC" or y in "RC":
            i += 1
        yield entry[3:], "?" if x == "?" else y


def parse_numstat(raw: str) -> Iterator[tuple[int, str, str, str]]:
    """(commit_no, added, deleted, path); every commit keeps a number of its own."""
    number = 0
    for line in raw.split("\n"):
        if line.startswith("COMMIT "):
            number += 1
        elif line:
            parts = line.split("\t")
            if len(parts) >= 3:
                yield number, parts[0], parts[1], "\t".join(parts[2:])


def parse_hunks(raw: str) -> Iterator[tuple[str, int, int]]:
    """(path, start, end) of the new side; deletions have no lines there and are left out."""
    path = None
    for line in raw.split("\n"):
        if line.startswith("+++ "):
            path = line[6:].rstrip("\t") if line.startswith("+++ b/") else None
        elif path and (m := HUNK.match(line)):
            start, n = int(m[1]), int(m[2]) if m[2] is not None else 1
            if n:
                yield path, start, start + n - 1


class _Listing(DataSource):
    """Git listings as rows; subclasses give the schema, the parts of the listing and a part's rows."""

    @classmethod
    def name(cls) -> str:
        return cls.title

    def schema(self) -> str:
        return self.columns

    def reader(self, schema) -> DataSourceReader:
        return _Reader(type(self), dict(self.options))

    @staticmethod
    def parts(root: str, o: dict) -> list:
        return [None]


class _Reader(DataSourceReader):
    def __init__(self, kind, options: dict):
        self.kind, self.options = kind, options
        self.root = options.get("root") or options["path"]

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.kind.parts(self.root, self.options)]

    def read(self, partition) -> Iterator[tuple]:
        if partition is not None:  # None: a listing without parts
            yield from self.kind.rows(self.root, self.options, partition.value)


def _tree(root: str, ref: str, folder: str = "") -> tuple[list[str], list[str]]:
    """(directories, other entries) right under a folder of a commit."""
    raw = git(root, "ls-tree", "-z", ref, *(["--", f"{folder}/"] if folder else []))
    folders, others = [], []
    for entry in raw.decode(errors="surrogateescape").split("\0"):
        if entry:
            about, path = entry.split("\t", 1)
            (folders if about.split()[1] == "tree" else others).append(path)
    return folders, others


def _folders(root: str, ref: str | None, folder: str = "") -> list[str]:
    """Directories right under a folder of a commit or of the work tree; links and other repositories are none."""
    if ref:
        return _tree(root, ref, folder)[0]
    try:
        with os.scandir(os.path.join(root, folder)) as found:
            own = [f"{folder}/{e.name}" if folder else e.name for e in found if e.name != ".git" and e.is_dir(follow_symlinks=False)]
    except OSError:  # not readable, or gone by now: Git lists what it can of it as a whole
        return []
    return sorted(p for p in own if not os.path.lexists(os.path.join(root, p, ".git")))


def _within(path: str, under: list[str]) -> bool:
    """The path is one of ``under`` or lies below one; an empty list has all."""
    return not under or any(path == p or path.startswith(f"{p}/") for p in under)


class GitFiles(_Listing):
    """Paths of a commit (``ref``), or tracked and untracked ones of the work tree, in no order over tasks;
    with ``under`` those that are in its list or lie below one of it."""

    title, columns = "git_files", "path string"

    @staticmethod
    def parts(root: str, o: dict) -> list:
        """Groups of directories, and the rest: (opened directories, directories with a group)."""
        ref, opened, folders = o.get("ref"), [""], _folders(root, o.get("ref"))
        under = json.loads(o.get("under") or "[]")
        chosen = lambda names: [d for d in names if _within(d, under) or any(p.startswith(f"{d}/") for p in under)]
        closed, folders = set(folders) - set(chosen(folders)), chosen(folders)
        while folders and len(folders) < LISTINGS // 4:  # one big directory is opened, so that it is not one task
            inner = {p: _folders(root, ref, p) for p in folders}
            deeper = [p for p in folders if inner[p]]
            if not deeper or sum(len(inner[p]) or 1 for p in folders) > LISTINGS * 4:
                break
            opened += deeper
            below = [q for p in folders for q in (inner[p] or [p])]
            closed |= set(below) - set(chosen(below))
            folders = chosen(below)
        groups = [("in", folders[i::LISTINGS]) for i in range(min(LISTINGS, len(folders)))]
        return [*groups, ("rest", opened, sorted({*folders, *closed}))]

    @staticmethod
    def rows(root: str, o: dict, part: tuple) -> Iterator[tuple]:
        ref = o.get("ref")
        if ref and part[0] == "rest":
            found = [x for folder in part[1] for x in _tree(root, ref, folder)[1]]
        elif ref:
            found = git(root, "ls-tree", "-r", "--name-only", "-z", ref, "--", *(f"{p}/" for p in part[1])).decode(errors="surrogateescape").split("\0")
        else:
            own = [f":(top,literal){p}/" for p in part[1]] if part[0] == "in" else [".", *(f":(top,exclude,literal){p}/" for p in part[2])]
            found = git(root, "ls-files", "-z", "--cached", "--others", "--exclude-standard", "--", *own).decode(errors="surrogateescape").split("\0")
        under = json.loads(o.get("under") or "[]")
        for p in sorted({x for x in found if x and _within(x, under)}):
            yield (p,)


class GitStatus(_Listing):
    title, columns = "git_status", "path string, status string"

    @staticmethod
    def rows(root: str, o: dict, part=None) -> Iterator[tuple]:
        yield from parse_status(git(root, "status", "--porcelain", "-z", "--untracked-files=all").decode(errors="surrogateescape"))


class GitNumstat(_Listing):
    """Changed lines of the last ``limit`` commits up to ``ref``, of those not reached by ``since`` if it is
    given; ``range`` commits a task.  Commit 1 is the newest one."""

    title, columns = "git_numstat", "commit_no long, added string, deleted string, path string"

    @staticmethod
    def parts(root: str, o: dict) -> list:
        """(commit, not reached by, commits before, commits) of each range, all from one resolved commit."""
        ref, since = o.get("ref") or "HEAD", o.get("since")
        head = None if ref.startswith("-") else git(root, "rev-parse", "--verify", "--quiet", "--end-of-options", f"{ref}^{{commit}}", check=False)
        if head is None:
            return []
        head, stop = head.decode().strip(), [f"^{resolve_ref(root, since)}"] if since else []
        total = int(git(root, "rev-list", "--count", f"-n{o.get('limit', HISTORY)}", head, *stop))
        step = int(o.get("range", RANGE))
        return [(head, stop, i, min(step, total - i)) for i in range(0, total, step)]

    @staticmethod
    def rows(root: str, o: dict, part: tuple) -> Iterator[tuple]:
        head, stop, before, n = part
        raw = git(root, "log", "--numstat", "--no-renames", f"--skip={before}", f"-n{n}", "--format=COMMIT %H", head, *stop)
        for number, *rest in parse_numstat(raw.decode(errors="replace")):
            yield before + number, *rest


class GitDiff(_Listing):
    title, columns = "git_diff", "path string, start int, end int"

    @staticmethod
    def rows(root: str, o: dict, part=None) -> Iterator[tuple]:
        span = [f"{o['base']}...{o['head']}"] if o.get("base") else [o["head"]] if o.get("head") else ["HEAD"]
        yield from parse_hunks((git(root, "diff", "--unified=0", "--no-color", "--no-ext-diff", *span, check=False) or b"").decode(errors="replace"))


class GitDiffNames(_Listing):
    title, columns = "git_diff_names", "path string"

    @staticmethod
    def rows(root: str, o: dict, part=None) -> Iterator[tuple]:
        raw = git(root, "diff", "--name-only", "-z", f"{o['base']}...{o['head']}", check=False) or b""
        for p in raw.decode(errors="surrogateescape").split("\0"):
            if p:
                yield (p,)


def register(spark: SparkSession) -> None:
    for source in (GitFiles, GitStatus, GitNumstat, GitDiff, GitDiffNames):
        spark.dataSource.register(source)


def read_file(path: str, most: int = MAX_BYTES) -> tuple[bytes | None, str | None]:
    """(bytes, None) of a regular file, or (None, why not); links are not followed."""
    try:
        fd = os.open(path, os.O_RDONLY | os.O_NOFOLLOW | os.O_NONBLOCK)
    except OSError:
        return None, "not-a-file" if os.path.islink(path) else "read-error"
    with os.fdopen(fd, "rb") as f:
        info = os.fstat(f.fileno())
        if not stat.S_ISREG(info.st_mode):
            return None, "not-a-file"
        if info.st_size > most:
            return None, "too-large"
        data = f.read(most + 1)
    if len(data) != info.st_size:
        raise EngineError("SOURCE_CHANGED", f"file changed while it was read: {path}")
    return (None, "binary") if b"\0" in data else (data, None)


class Blobs:
    """Contents at a commit, by one ``cat-file --batch`` process."""

    def __init__(self, root: str, commit: str, most: int = MAX_BYTES):
        self.commit, self.most = commit, most
        self.run = subprocess.Popen([*GIT, "cat-file", "--batch"], cwd=root, env=neutral_env(), stdin=subprocess.PIPE, stdout=subprocess.PIPE)

    def read(self, path: str) -> tuple[bytes | None, str | None]:
        if "\n" in path:
            return None, "read-error"
        self.run.stdin.write(f"{self.commit}:{path}\n".encode(errors="surrogateescape"))
        self.run.stdin.flush()
        head = self.run.stdout.readline().split()
        if len(head) != 3:
            return None, "read-error"
        size, parts, left = int(head[2]), [], int(head[2]) + 1
        while left:
            part = self.run.stdout.read(min(left, 1 << 20))
            if not part:
                return None, "read-error"
            if size <= self.most:
                parts.append(part)
            left -= len(part)
        if head[1] != b"blob":
            return None, "not-a-file"
        if size > self.most:
            return None, "too-large"
        data = b"".join(parts)[:-1]
        return (None, "binary") if b"\0" in data else (data, None)

    def close(self) -> None:
        self.run.stdin.close()
        self.run.wait()


def read_contents(paths: DataFrame, root: str, ref: str | None = None) -> DataFrame:
    """path, content (text), size, digest, reason: each listed file, read where its row is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = Blobs(root, ref) if ref else None
        for batch in batches:
            for p in batch.column(0).to_pylist():
                data, reason = blobs.read(p) if blobs else read_file(os.path.join(root, p))
                text = None if data is None else data.decode(errors="replace")
                cols = [[p], [text], [None if data is None else len(data)], [None if data is None else hashlib.sha256(data).hexdigest()], [reason]]
                types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(cols, types, strict=True)], names=["path", "content", "size", "digest", "reason"])
        if blobs:
            blobs.close()

    return paths.select("path").mapInArrow(run, "path string, content string, size long, digest string, reason string")
