"""Path functions as column expressions, and translators from globs and ignore patterns to regular expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(path: Column) -> Column:
    """Lexically cleaned slash path: no empty or ``.`` segment, ``..`` resolved where it can be, ``.`` for nothing."""
    absolute = F.startswith(path, F.lit("/"))

    def step(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        up = F.when((F.size(acc) > 0) & (last != ".."), F.slice(acc, F.lit(1), F.size(acc) - 1)).when(absolute, acc).otherwise(F.concat(acc, F.array(x)))
        return F.when(x.isin("", "."), acc).when(x == "..", up).otherwise(F.concat(acc, F.array(x)))

    joined = F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")
    return F.when(absolute, F.concat(F.lit("/"), joined)).when(joined == "", F.lit(".")).otherwise(joined)


def escapes(path: Column) -> Column:
    """Nothing, the root itself, or above it."""
    return path.isin("", ".", "..") | F.startswith(path, F.lit("../"))


def normalise(origin_dir: Column, target: Column, prefix: Column) -> Column:
    """Where a target leads (J2): null outside the root.

    A single leading slash starts at the root, or at ``prefix`` if there is one; anything
    else is relative to the origin's folder.
    """
    slashed = F.replace(target, F.lit("\\"), F.lit("/"))
    rooted = F.startswith(slashed, F.lit("/"))
    inner = clean(F.regexp_replace(slashed, "^/+", ""))
    from_root = F.when(escapes(inner), F.lit(None).cast("string")).when(prefix.isNotNull() & (prefix != ""), F.concat(prefix, F.lit("/"), inner)).otherwise(inner)
    relative = clean(F.concat(origin_dir, F.lit("/"), slashed))
    return F.when(rooted, from_root).otherwise(F.when(~escapes(relative), relative))


def is_markdown(path: Column) -> Column:
    return F.lower(path).rlike(r"\.(md|markdown|mdx)$")


def glob_regex(glob: str) -> str | None:
    """A path glob as a regular expression; ``*`` and ``?`` stop at a slash; None if malformed."""
    out, at = [], 0
    while at < len(glob):
        c = glob[at]
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "\\":
            at += 1
            if at == len(glob):
                return None
            out.append(re.escape(glob[at]))
        elif c == "[":
            end, members, k = None, [], at + 1
            negated = k < len(glob) and glob[k] == "^"
            k += negated
            while k < len(glob):
                if glob[k] == "]" and members:
                    end = k
                    break
                if glob[k] == "\\":
                    k += 1
                    if k == len(glob):
                        return None
                low = glob[k]
                if low in "]-" and glob[k - 1] != "\\":
                    return None
                k += 1
                if k + 1 < len(glob) and glob[k] == "-" and glob[k + 1] != "]":
                    members.append(f"{re.escape(low)}-{re.escape(glob[k + 1])}")
                    k += 2
                else:
                    members.append(re.escape(low))
            if end is None:
                return None
            out.append(f"(?!/)[{'^' if negated else ''}{''.join(members)}]")
            at = end
        else:
            out.append(re.escape(c))
        at += 1
    return "^" + "".join(out) + "$"


def matches_any(path: Column, globs: list[str]) -> Column:
    found = [r for r in map(glob_regex, globs) if r is not None]
    return path.rlike("|".join(f"(?:{r})" for r in found)) if found else F.lit(False)


def ignore_rules(lines: list[str]) -> list[tuple[re.Pattern, bool, bool]]:
    """Ignore-file lines as (pattern, re-includes, folders only), in order; the last match wins."""
    out = []
    for raw in lines:
        line = raw.rstrip("\r\n")
        line = re.sub(r"(?<!\\) +$", "", line)
        if not line or line.startswith("#"):
            continue
        keep = line.startswith("!")
        line = line[1:] if keep else line
        line = re.sub(r"^\\([#!])", r"\1", line)
        folder = line.endswith("/")
        line = line.rstrip("/")
        if not line:
            continue
        anchored = "/" in line
        line = line.lstrip("/")
        body, at = [], 0
        while at < len(line):
            if line.startswith("**/", at) and (at == 0 or line[at - 1] == "/"):
                body.append("(?:[^/]+/)*")
                at += 3
            elif line.startswith("/**", at) and at + 3 == len(line):
                body.append("/.+")
                at += 3
            elif line[at] == "*":
                while at < len(line) and line[at] == "*":
                    at += 1
                body.append("[^/]*")
            elif line[at] == "?":
                body.append("[^/]")
                at += 1
            elif line[at] == "[" and "]" in line[at + 2 :]:
                end = line.index("]", at + 2)
                inner = line[at + 1 : end]
                inner = "^" + inner[1:] if inner[:1] in "!^" else inner
                body.append("(?!/)[" + inner.replace("\\", "\\\\") + "]")
                at = end + 1
            elif line[at] == "\\" and at + 1 < len(line):
                body.append(re.escape(line[at + 1]))
                at += 2
            else:
                body.append(re.escape(line[at]))
                at += 1
        try:
            out.append((re.compile(("" if anchored else "(?:.*/)?") + "".join(body) + r"\Z"), keep, folder))
        except re.error:
            continue
    return out


def is_ignored(path: str, rules: list[tuple[re.Pattern, bool, bool]], is_dir: bool = False) -> bool:
    """Whether a path, or a folder above it, is ignored."""
    parts = path.split("/")
    for k in range(1, len(parts) + 1):
        here, folder = "/".join(parts[:k]), is_dir or k < len(parts)
        verdict = False
        for pattern, keep, folders_only in rules:
            if (folder or not folders_only) and pattern.match(here):
                verdict = not keep
        if verdict:
            return True
    return False


def ignored(path: Column, lines: list[str]) -> Column:
    """:func:`is_ignored` of a file's path as a column expression."""
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(F.array_join(F.slice(parts, F.lit(1), k), "/").alias("path"), (k < F.size(parts)).alias("folder")))

    def verdict(x: Column) -> Column:
        out = F.lit(False)
        for pattern, keep, folders_only in ignore_rules(lines):
            hit = x["path"].rlike("^(?:" + pattern.pattern.removesuffix(r"\Z") + r")\z")
            out = F.when(hit & x["folder"] if folders_only else hit, F.lit(not keep)).otherwise(out)
        return out

    return F.coalesce(F.exists(above, verdict), F.lit(False))
