"""Markdown documents to rows: front matter, sections, references, anchors.

A line pass finds the blocks of a CommonMark subset (front matter, fences, indented code,
headings of both kinds, HTML comments); an inline pass over each text block finds code
spans, wikilinks, links, images and autolinks.  It is plain Python, run by Arrow batches.
"""

from __future__ import annotations

import datetime
import json
import re
import tomllib
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_FRONT_MATTER = 64 << 10
MAX_TAG = 16 << 10
LIST_KEYS, TEXT_KEYS = ("tags", "aliases", "related"), ("title", "description", "name", "parent", "status", "date")
EXTERNAL = ("http://", "https://", "mailto:", "ftp://", "file://", "data:", "//")

SCHEMA = (
    "doc_id string, title string, description string, fm struct<title:string,description:string,tags:array<string>,aliases:array<string>,name:string,parent:string,"
    "related:array<string>,status:string,date:string>, extra string, fm_present boolean, fm_parsed boolean, n_lines int, mod_time timestamp, "
    "sections array<struct<ord:int,level:int,text:string,slug:string,parent_ord:int,start_line:int,end_line:int>>, "
    "refs array<struct<ref_ord:int,raw_target:string,fragment:string,type:string,line:int,anchor_text:string>>, anchors array<string>"
)


def _plain(value: Any) -> Any:
    """A decoded value as JSON can hold it."""
    if isinstance(value, dict):
        return {str(k): _plain(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_plain(v) for v in value]
    return value if isinstance(value, str | int | float | bool | type(None)) else str(value)


def _text(value: Any) -> str:
    if value is None or isinstance(value, dict | list):
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, datetime.datetime | datetime.date):
        return value.isoformat()
    return str(value)


def front_matter(text: str) -> tuple[dict, dict, bool, bool, int]:
    """(known keys, other keys, present, parsed, lines that the block takes)."""
    lines = text.split("\n")
    fence = lines[0].rstrip("\r \t")
    if fence not in ("---", "+++"):
        return {}, {}, False, False, 0
    end = next((k for k in range(1, len(lines)) if lines[k].rstrip("\r \t") == fence), None)
    if end is None:
        return {}, {}, False, False, 0
    body = "\n".join(lines[1:end])
    if len(body.encode()) > MAX_FRONT_MATTER:
        return {}, {}, True, False, end + 1
    try:
        if fence == "+++":
            found = tomllib.loads(body)
        else:
            import yaml

            found = yaml.safe_load(body)
    except Exception:  # any decoding error only means that there is nothing to use
        return {}, {}, True, False, end + 1
    if found is None:
        found = {}
    if not isinstance(found, dict):
        return {}, {}, True, False, end + 1
    known: dict[str, Any] = {}
    extra: dict[str, Any] = {}
    for key, value in found.items():
        name = str(key).lower()
        if name in TEXT_KEYS:
            known[name] = _text(value)
        elif name in LIST_KEYS:
            items = value if isinstance(value, list) else [] if value is None else [value]
            known[name] = [x for x in map(_text, items) if x]
        else:
            extra[str(key)] = _plain(value)
    return known, extra, True, True, end + 1


# --- slugs ----------------------------------------------------------------------------


def slug_base(raw: str, keep: frozenset[int] = frozenset()) -> str:
    """ASCII letters and digits in lower case; white space, ``-`` and ``_`` become ``-``; the rest goes.

    ``keep``: places of underscores that stay.
    """
    out = []
    for k, c in enumerate(raw.strip()):
        if c.isascii() and c.isalnum():
            out.append(c.lower())
        elif c == "_" and k in keep:
            out.append("_")
        elif c in " \t\n\r\v\f-_":
            out.append("-")
    return "".join(out) or "heading"


class Slugs:
    """Slugs of one document; names with underscores from code count their repeats by themselves."""

    def __init__(self) -> None:
        self.seen: dict[str, int] = {}
        self.own: dict[str, int] = {}

    @staticmethod
    def _next(seen: dict[str, int], base: str) -> str:
        if base not in seen:
            seen[base] = 0
            return base
        while True:
            seen[base] += 1
            name = f"{base}-{seen[base]}"
            if name not in seen:
                seen[name] = 0
                return name

    def of(self, raw: str) -> str:
        raw = raw.strip()
        inside = {k for m in re.finditer(r"(?<!`)(`+)(?!`)(.+?)(?<!`)\1(?!`)", raw) for k in range(m.start(2), m.end(2)) if raw[k] == "_"}
        automatic = self._next(self.seen, slug_base(raw))
        return self._next(self.own, slug_base(raw, frozenset(inside))) if inside else automatic


# --- inline ---------------------------------------------------------------------------

_AUTOLINK = re.compile(r"<([A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*|[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*)>")
_TAG = re.compile(r"<!--.*?-->|</?[A-Za-z][^<>]*>", re.S)
_DEFINITION = re.compile(r"^ {0,3}\[((?:[^\[\]\\]|\\.)+)\]:[ \t]*(?:<([^<>\n]*)>|(\S+))(?:[ \t]+(?:\"[^\"]*\"|'[^']*'|\([^)]*\)))?[ \t]*$")
_ESCAPED = re.compile(r"\\([!-/:-@\[-`{-~])")


def _label(text: str) -> str:
    return " ".join(text.split()).casefold()


def _destination(text: str, at: int) -> tuple[str, int] | None:
    """Destination and end of ``(dest "title")`` from the place of its bracket."""
    k = at + 1
    while k < len(text) and text[k] in " \t\n":
        k += 1
    if k < len(text) and text[k] == "<":
        end = re.compile(r"(?:[^<>\n\\]|\\.)*>").match(text, k + 1)
        if end is None:
            return None
        dest, k = text[k + 1 : end.end() - 1], end.end()
    else:
        depth, start = 0, k
        while k < len(text) and text[k] not in " \t\n":
            if text[k] == "\\" and k + 1 < len(text):
                k += 1
            elif text[k] == "(":
                depth += 1
            elif text[k] == ")":
                if depth == 0:
                    break
                depth -= 1
            k += 1
        dest = text[start:k]
    rest = re.compile(r"[ \t\n]*(?:(?<=[ \t\n])(?:\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\))[ \t\n]*)?\)", re.S).match(text, k)
    return (_ESCAPED.sub(r"\1", dest), rest.end()) if rest else None


def inline(text: str, definitions: dict[str, str], depth: int = 0) -> tuple[str, list[tuple[int, str, str, str, str]]]:
    """(visible text, references as (place, type, target, fragment, anchor text)) of one text block."""
    out: list[str] = []
    refs: list[tuple[int, str, str, str, str]] = []
    open_: list[tuple[int, int, bool, int]] = []  # (place in text, place in out, image, references so far)
    k = 0
    while k < len(text):
        c = text[k]
        if c == "\\" and k + 1 < len(text) and _ESCAPED.match(text, k):
            out.append(text[k + 1])
            k += 2
        elif c == "`":
            run = re.compile("`+").match(text, k).end() - k
            end = re.compile(rf"(?<!`)`{{{run}}}(?!`)").search(text, k + run)
            if end:
                out.append(" ".join(text[k + run : end.start()].split("\n")).strip())
                k = end.end()
            else:
                out.append(text[k : k + run])
                k += run
        elif text.startswith("[[", k) or text.startswith("![[", k):
            embed = c == "!"
            start = k + 2 + embed
            end = text.find("]]", start)
            inner = text[start:end] if end >= 0 else "\n"
            spec, _, display = inner.partition("|")
            target, _, fragment = (x.strip() for x in spec.partition("#"))
            if "\n" in inner or "[[" in inner or not (target or fragment):
                out.append(text[k : k + 2 + embed])
                k += 2 + embed
                continue
            kind = "transclusion" if embed else "wikilink" if target else "anchor"
            shown = display.strip() or target or fragment
            refs.append((k, kind, target, fragment, shown))
            out.append(shown)
            k = end + 2
        elif c == "[" or text.startswith("![", k):
            open_.append((k, len(out), c == "!", len(refs)))
            k += 1 + (c == "!")
        elif c == "]" and open_:
            start, place, image, before = open_.pop()
            label = text[start + 1 + image : k]
            found, end = None, k + 1
            if text.startswith("(", k + 1):
                got = _destination(text, k + 1)
                if got:
                    found, end = got
            if found is None and text.startswith("[", k + 1) and (m := re.compile(r"\[((?:[^\[\]\\]|\\.)*)\]").match(text, k + 1)):
                name = definitions.get(_label(m[1] or label))
                if name is not None:
                    found, end = name, m.end()
            if found is None:
                found = definitions.get(_label(label))
                end = k + 1
            if found is None:
                out[place:] = [("![" if image else "[") + "".join(out[place:]) + "]"]
                k += 1
                continue
            shown = "".join(out[place:])
            out[place:] = [shown]
            refs.insert(before, (start, *classify(found, "image-embed" if image else "relative-link"), shown.strip()))
            if not image:  # links do not hold links
                open_ = [x for x in open_ if x[2]]
            k = end
        elif c == "<" and (m := _AUTOLINK.match(text, k)):
            target = m[1] if ":" in m[1] else "mailto:" + m[1]
            refs.append((k, "external" if is_external(target) else "relative-link", target, "", m[1]))
            out.append(m[1])
            k = m.end()
        elif c == "<" and (m := _TAG.match(text, k)):
            k = m.end()
        elif c in "*_" and (c == "*" or not (0 < k < len(text) - 1 and text[k - 1].isalnum() and text[k + 1].isalnum())):
            k += 1
        else:
            out.append(c)
            k += 1
    return "".join(out), refs


def is_external(target: str) -> bool:
    return target.lower().startswith(EXTERNAL)


def classify(dest: str, kind: str) -> tuple[str, str, str]:
    """(type, target, fragment) of a destination."""
    if is_external(dest):
        return "external", dest, ""
    target, _, fragment = dest.partition("#")
    if not target and fragment:
        return "anchor", "", fragment
    return kind, target, fragment


# --- blocks ---------------------------------------------------------------------------

_FENCE = re.compile(r"^ {0,3}(`{3,}(?=[^`]*$)|~{3,})")
_ATX = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_SETEXT = re.compile(r"^ {0,3}(=+|-+)[ \t]*$")
_RULE = re.compile(r"^ {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_MARKER = re.compile(r"^ {0,3}(?:[-+*]|\d{1,9}[.)])(?:[ \t]+|$)")
_QUOTE = re.compile(r"^ {0,3}> ?")
_EXPLICIT = re.compile(r"^(.*?)[ \t]*\{(?:#([^\s{}]+)|/\*[ \t]*#([^\s*]+)[ \t]*\*/)\}$")


def parse(doc_id: str, source: bytes) -> dict[str, Any]:
    """One document's row; nothing in it makes the parser fail."""
    text = source.decode("utf-8", "replace").removeprefix("\ufeff").replace("\r\n", "\n").replace("\r", "\n")
    known, extra, present, parsed, skip = front_matter(text)
    lines = text.split("\n")
    if lines and not lines[-1]:
        lines.pop()
    definitions: dict[str, str] = {}
    blocks: list[tuple[str, int, list[str], str]] = []  # (kind, first line, lines, raw heading line)
    run: list[str] = []
    first, fence, comment = 0, "", False

    def flush() -> None:
        nonlocal run
        if run:
            blocks.append(("text", first, run, ""))
        run = []

    in_list = False
    for number, line in enumerate(lines[skip:], skip + 1):
        if comment:
            comment = "-->" not in line
            continue
        if fence:
            closing = re.match(r"^\s*(`{3,}|~{3,})[ \t]*$", line)
            if closing and closing[1][0] == fence[0] and len(closing[1]) >= len(fence):
                fence = ""
            continue
        bare = line
        while (m := _QUOTE.match(bare)) and m.end():
            bare = bare[m.end() :]
        item = False
        while not _RULE.match(bare) and (m := _MARKER.match(bare)):
            bare, item, in_list = bare[m.end() :], True, True
            if not bare:
                break
        if not line.strip():
            flush()
            continue
        indented = re.match(r"^(?: {4}|\t)", line)
        if in_list and indented:
            bare = bare.strip()
            indented = None
        elif not item and not line.startswith(" "):
            in_list = False if not run else in_list
        if m := _FENCE.match(bare):
            flush()
            fence = m[1]
            continue
        if indented and not run:
            continue
        if re.match(r"^ {0,3}<!--", bare) and "-->" not in bare:
            flush()
            comment = True
            continue
        if m := _ATX.match(bare):
            flush()
            blocks.append(("heading", number, [str(len(m[1]))], m[2] or ""))
            continue
        if run and not item and (m := _SETEXT.match(bare)):
            whole, run = run, []
            blocks.append(("heading", first, ["1" if m[1][0] == "=" else "2", *whole], whole[-1]))
            continue
        if _RULE.match(bare):
            flush()
            continue
        if not run and (m := _DEFINITION.match(bare)):
            definitions.setdefault(_label(m[1]), _ESCAPED.sub(r"\1", m[2] if m[2] is not None else m[3]))
            continue
        if item:
            flush()
        if not run:
            first = number
        run.append(bare if run else bare.lstrip())
    flush()

    sections: list[dict] = []
    refs: list[tuple] = []
    slugs, stack = Slugs(), []
    for kind, line, body, raw in blocks:
        if kind == "heading":
            level = int(body[0])
            content, slug = "\n".join(body[1:]) or raw, slugs.of(raw)
            if m := _EXPLICIT.match(raw.rstrip()):
                content, slug = content.rstrip()[: m.end(1) - len(raw.rstrip())], m[2] or m[3]
            shown, found = inline(content, definitions)
            shown = shown.strip()
            while stack and sections[stack[-1]]["level"] >= level:
                sections[stack.pop()]["end_line"] = line - 1
            sections.append({"ord": len(sections), "level": level, "text": shown, "slug": slug, "parent_ord": stack[-1] if stack else -1, "start_line": line, "end_line": len(lines)})
            stack.append(len(sections) - 1)
        else:
            content = "\n".join(body)
            _, found = inline(content, definitions)
        refs += [(line + content.count("\n", 0, at), *rest) for at, *rest in found]
    title = known.get("title") or next((s["text"] for s in sections if s["level"] == 1), "") or next((s["text"] for s in sections if s["text"]), "")
    return {
        "doc_id": doc_id, "title": title or doc_id, "description": known.get("description") or next((s["text"] for s in sections), ""),
        "fm": {**{k: known.get(k, "") for k in TEXT_KEYS}, **{k: known.get(k, []) for k in LIST_KEYS}}, "extra": json.dumps(extra, sort_keys=True),
        "fm_present": present, "fm_parsed": parsed, "n_lines": len(lines), "sections": sections,
        "refs": [{"ref_ord": k, "raw_target": t, "fragment": f, "type": y, "line": n, "anchor_text": a} for k, (n, y, t, f, a) in enumerate(refs)],
        "anchors": literal_anchors(lines, skip),
    }


_COMPONENT = re.compile(r" {0,3}<Heading(?=[ \t\r\n>/])")
_NAME = re.compile(r"[ \t\r\n]*([A-Za-z0-9_:-]+)[ \t\r\n]*(=[ \t\r\n]*)?")
_TAG_END = re.compile(r"[ \t\r\n]*/?>")
_QUOTED = re.compile(r"\"([^\"<\r\n]*)\"|'([^'<\r\n]*)'")
_HIDING = re.compile(r"<!--|\{/\*|`+")
_HIDING_SCRIPT = re.compile(r"<!--|\{/\*|`+|['\"]")
_SCRIPT = re.compile(r"[ \t]*(?:const|let|var|export|import)(?:[ \t]|$)")


def _braced(text: str, at: int) -> int | None:
    """Where an expression in braces, opened before ``at`` and on one line, has ended."""
    depth = 1
    for m in re.compile(r"[{}\r\n]").finditer(text, at):
        depth += {"{": 1, "}": -1}.get(m[0], -depth)
        if m[0] in "\r\n":
            return None
        if not depth:
            return m.end()
    return None


def component_id(text: str, at: int) -> tuple[str | None, int]:
    """(literal id, where the tag ends) of a component whose attributes begin at ``at``; no id if it has none, several, one that is
    an expression, or an attribute that is malformed - then the place is where reading stopped."""
    text, ids = text[: at + MAX_TAG], []
    while not (end := _TAG_END.match(text, at)):
        name = _NAME.match(text, at)
        if not name:
            return None, at + 1
        at = name.end()
        if not name[2]:
            if name[1] == "id":
                return None, at
            continue
        if value := _QUOTED.match(text, at):
            if name[1] == "id":
                ids.append(value[1] if value[1] is not None else value[2])
            at = value.end()
        elif text[at : at + 1] == "{" and name[1] != "id" and (close := _braced(text, at + 1)):
            at = close
        else:
            return None, at + 1
    sound = len(ids) == 1 and ids[0] != "" and ids[0].strip() == ids[0] and not set(ids[0]) & set("{}<>\\\"'")
    return ids[0] if sound else None, end.end()


def _hidden(line: str, inside: tuple[str, str] | None) -> tuple[str, str] | None:
    """What conceals the next line: a comment, a code span or a script's string that this line leaves open."""
    at, opener = 0, _HIDING_SCRIPT if _SCRIPT.match(line) else _HIDING
    while True:
        if inside is None:
            m = opener.search(line, at)
            if not m:
                return None
            inside, at = ("code" if m[0][0] == "`" else m[0], m[0]), m.end()
        kind, mark = inside
        if kind == "<!--":
            m = re.compile("-->").search(line, at)
        elif kind == "{/*":
            m = re.compile(r"\*/").search(line, at)
            m = m and re.compile(r"[ \t]*\}").match(line, m.end())  # else the rest of the line says nothing
        elif kind == "code":
            m = re.compile(rf"(?<!`){mark}(?!`)").search(line, at)
        else:
            m = re.compile(rf"(?:\\.|[^\\{mark}])*{mark}").match(line, at)
        if not m:
            return inside
        inside, at = None, m.end()


def literal_anchors(lines: list[str], skip: int = 0) -> list[str]:
    """Literal ids of ``<Heading id="...">`` components that begin a line (P7), outside fences, indented code, comments, code spans and strings."""
    out, fence, inside = [], "", None
    text, starts = "\n".join(lines) + "\n", [0]
    for line in lines:
        starts.append(starts[-1] + len(line) + 1)
    k = skip
    while k < len(lines):
        line = lines[k]
        k += 1
        if fence:
            closing = re.match(r"^ {0,3}(`{3,}|~{3,})[ \t\r]*$", line)
            fence = "" if closing and closing[1][0] == fence[0] and len(closing[1]) >= len(fence) else fence
            continue
        if m := re.match(r"^ {0,3}(`{3,}|~{3,})", line):
            fence = m[1]
            continue
        if re.match(r"^(?: {4}|\t)", line):
            continue
        if not inside and (m := _COMPONENT.match(text, starts[k - 1])):
            found, end = component_id(text, m.end())
            while k < len(lines) and starts[k] < end:  # its lines are read
                k += 1
            if found is not None:
                out.append(found)
                inside = _hidden(text[end : starts[k] - 1], None)  # what follows it on its last line
            continue
        inside = _hidden(line, inside)
    return out


def documents(files: DataFrame) -> DataFrame:
    """``files(doc_id, content, mod_time)`` -> one nested row for each document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [{**parse(d, bytes(c or b"")), "mod_time": t} for d, c, t in zip(batch["doc_id"], batch["content"], batch["mod_time"], strict=True)]
            if rows:
                yield pd.DataFrame(rows)

    return files.select("doc_id", "content", "mod_time").mapInPandas(run, SCHEMA)


def sections(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.explode("sections").alias("s")).select("doc_id", "s.*")


def raw_refs(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").alias("origin"), F.explode("refs").alias("r")).select("origin", "r.*")


def anchors(docs: DataFrame) -> DataFrame:
    """(doc_id, anchor, kind): slugs of sections and literal anchors, distinct."""
    found = sections(docs).where("slug <> ''").select("doc_id", F.col("slug").alias("anchor"), F.lit("section").alias("kind"))
    return found.unionByName(docs.select("doc_id", F.explode("anchors").alias("anchor"), F.lit("literal").alias("kind"))).distinct()


def aliases(docs: DataFrame) -> DataFrame:
    """(alias, doc_id), distinct."""
    every = F.array_compact(F.array_union("fm.aliases", F.array("fm.name")))
    return docs.select(F.explode(every).alias("alias"), "doc_id").where("alias <> ''").distinct()


def contains(docs: DataFrame) -> DataFrame:
    """(src, dst): each section with a slug under the nearest section above it that has one, else under its document (B1)."""
    # one pass over a document's sections: for each its own slug or, without one, what holds it
    def step(held: Column, s: Column) -> Column:
        above = F.when(s["parent_ord"] >= 0, F.get(held, s["parent_ord"])["name"]).otherwise(F.lit(""))
        return F.concat(held, F.array(F.struct(above.alias("up"), F.when(s["slug"] != "", s["slug"]).otherwise(above).alias("name"), s["slug"].alias("slug"))))

    none = F.array().cast("array<struct<up:string,name:string,slug:string>>")
    rows = docs.select("doc_id", F.explode(F.aggregate("sections", none, step)).alias("s")).where("s.slug <> ''")
    return rows.select(F.when(F.col("s.up") == "", F.col("doc_id")).otherwise(F.concat("doc_id", F.lit("#"), "s.up")).alias("src"), F.concat("doc_id", F.lit("#"), "s.slug").alias("dst"))


def duplicate_ids(docs: DataFrame) -> DataFrame:
    """(doc_id, n) of the ids that more than one file gives."""
    return docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def heading_count(docs: DataFrame) -> DataFrame:
    """One row: ``headings``, the distinct slugs and literal anchors of all documents (I4)."""
    return anchors(docs).agg(F.count(F.lit(1)).alias("headings"))
