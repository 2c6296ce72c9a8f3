"""Listing a documentation tree (S1-S12): what is read, what is passed over, and why."""

from __future__ import annotations

import datetime
import os
import subprocess
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import ignore_rules, is_ignored
from ..model import Config

# Folders of packages and tools that hold no authored documents.
SKIP_DIRS = (".git", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".tox", ".venv", "__pycache__", "node_modules", "vendor")
SKIP_PATHS = (".claude/agent-memory", ".claude/plans", ".claude/worktrees")
SUFFIXES = (".md", ".markdown", ".mdx")
IGNORE_FILE = ".inkgraphignore"
MAX_IGNORE = 1 << 20


@dataclass
class Listing:
    """Files to read as (doc_id, path, mtime, size), all other paths, and notices as (kind, path, detail)."""

    root: str
    files: list[tuple[str, str, datetime.datetime, int]] = field(default_factory=list)
    assets: list[str] = field(default_factory=list)
    notices: list[tuple[str, str, str]] = field(default_factory=list)


def git_ignored(root: str, timeout: float = 30.0, limit: int = 64 << 20) -> tuple[list[str], list[tuple[str, str, str]]]:
    """Untracked ignored paths that git reports (S5); none, and a notice, if it cannot."""
    try:
        done = subprocess.run(["git", "-C", root, "ls-files", "--others", "--ignored", "--exclude-standard", "--directory", "-z"], capture_output=True, timeout=timeout, check=True)
    except (OSError, subprocess.SubprocessError) as failed:
        return [], [("git-ignore", ".", f"git rules not used: {failed}")]
    if len(done.stdout) > limit:
        return [], [("git-ignore", ".", "git rules not used: too many paths")]
    return [p for p in done.stdout.decode("utf-8", "surrogateescape").split("\0") if p], []


def _literal(path: str) -> str:
    return "/" + "".join("\\" + c if c in "*?[\\!# " else c for c in path)


def list_tree(root: str, config: Config = Config()) -> Listing:
    """Walk the tree in path order, never along symbolic links."""
    base = os.path.realpath(root)
    out = Listing(base)
    lines: list[str] = list(config.ignore)
    if config.respect_gitignore:
        paths, notes = git_ignored(base)
        lines = [_literal(p) for p in paths] + lines
        out.notices += notes
    ignore = os.path.join(base, IGNORE_FILE)
    if os.path.islink(ignore):
        out.notices.append(("ignore-file", IGNORE_FILE, "symbolic link not followed"))
    elif os.path.isfile(ignore):
        if os.path.getsize(ignore) > MAX_IGNORE:
            out.notices.append(("ignore-file", IGNORE_FILE, "larger than 1 MiB, not used"))
        else:
            lines += Path(ignore).read_text("utf-8", "replace").splitlines()
    rules = ignore_rules(lines)
    own = os.path.realpath(config.output_dir) if config.output_dir else None
    cut = False
    for here, dirs, names in os.walk(base):
        rel = "" if here == base else os.path.relpath(here, base).replace(os.sep, "/") + "/"
        keep = []
        for d in sorted(dirs):
            path, full = rel + d, os.path.join(here, d)
            if d in SKIP_DIRS or path in SKIP_PATHS or is_ignored(path, rules, True) or own and os.path.realpath(full) == own:
                continue
            if os.path.islink(full):
                out.notices.append(("skipped-symlink", path, "symbolic link not followed"))
            elif os.path.lexists(os.path.join(full, ".git")):
                out.notices.append(("nested-repository", path, "a repository of its own"))
            else:
                keep.append(d)
                out.assets.append(path)
        dirs[:] = keep
        for name in sorted(names):
            path, full = rel + name, os.path.join(here, name)
            if is_ignored(path, rules):
                continue
            if os.path.islink(full):
                out.notices.append(("skipped-symlink", path, "symbolic link not followed"))
                continue
            if not os.path.isfile(full):
                continue
            if not name.lower().endswith(SUFFIXES):
                out.assets.append(path)
                continue
            stat = os.stat(full)
            if stat.st_size > config.max_file_bytes:
                out.notices.append(("skipped-oversize", path, f"{stat.st_size} bytes"))
                continue
            if len(out.files) >= config.max_files:
                cut = True
                continue
            out.files.append((path, full, datetime.datetime.fromtimestamp(stat.st_mtime, datetime.UTC), stat.st_size))
    if cut:
        out.notices.append(("truncated", ".", f"only the first {config.max_files} documents are read"))
    out.files.sort()
    return out


def files(spark: SparkSession, listing: Listing) -> DataFrame:
    """``files(doc_id, content, mod_time, size)``; contents are read by the executors."""
    if not listing.files:
        return spark.createDataFrame([], "doc_id string, content binary, mod_time timestamp, size long")
    read = spark.read.format("binaryFile").load([path for _, path, _, _ in listing.files])
    names = spark.createDataFrame([(i, "file:" + p) for i, p, _, _ in listing.files], "doc_id string, path string")
    return read.join(F.broadcast(names), F.regexp_replace(read["path"], "^file:/+", "file:/") == names["path"]).select("doc_id", "content", F.col("modificationTime").alias("mod_time"), F.col("length").alias("size"))
