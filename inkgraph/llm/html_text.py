"""Main-text extraction from HTML by composite text density.

1. A tolerant tokeniser builds the element tree in document order: raw-text elements are
   skipped to their end tag, void elements take no children, a block start closes an open
   paragraph, list items, cells and options close their like, a stray end tag is ignored.
2. Elements that never hold main text go: scripts, styles, forms, navigation, asides,
   footers, page headers, and elements whose class, id or role names a menu, sidebar,
   notice, advert, comment list and the like (``DROP_TAGS``, ``DROP_WORDS``).
3. Every remaining element gets its characters, tags, link characters and link tags, and
   from these its composite density: characters per tag, adjusted by the share of links
   against the body's.  An element's density sum is the sum over its children.
4. The element with the largest density sum is the core.  The result starts at the article,
   main or named content element around it, else at the core.  On the way up to the body,
   or to a main element, each ancestor adds those of its parts off the path that reach a
   threshold: a share of the core's density; for parts that hold an article or named
   content the least density on the core's path, if that is less.  Parts of ``PROSE``
   characters in paragraphs and few links reach it too, and headings before a kept part stay.
   Text of the ancestor itself and its inline elements are one part.  A core that holds
   sections, not paragraphs, loses its lists of links (``LINKS`` or more, most of the
   characters) below the least of these thresholds.
5. Its text is cut at block elements; white space becomes one space, blocks are trimmed and
   joined by a line feed.

All passes run over arrays in document order, so depth costs no stack.  Defined cases: a
null or empty page, or one without text, gives an empty text; markup that the page breaks
off in is dropped; pages without a body element count as body; repeated rows are alike; very
long or deep pages are read whole; other columns are not read, whatever their names.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import StringType

from .text import pick

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>"']|"[^"]*"|'[^']*')*)>|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z][^<>]*(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role|aria-label|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)

# The elements of HTML by the way they are read, and names that mark what is not main text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg math xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
DROP_TAGS = frozenset("head nav aside footer form button select input label dialog menu object audio video canvas".split())
DROP_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar side aside footer "
    "header masthead topbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login search share sharing social "
    "related recommended recommendations comment comments reply replies disqus respond widget widgets toolbar pagination pager copyright legal skip hidden "
    "complementary contentinfo banner-ad dialog".split()
)
KEEP_WORDS = frozenset("article content main post entry story body text".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Of the core's density, what other parts must reach; characters in paragraphs that are text anyway.
SHARE = 0.2
PROSE = 80
#: Links of a part that can be a list of links.
LINKS = 3


def _labelled(tag: str, attributes: str) -> bool:
    """An article or main element, or one whose class, id or role names content."""
    if tag in ("article", "main"):
        return True
    named = (x for name, value in _ATTRIBUTE.findall(attributes) if name.lower() in ("class", "id", "role") for x in re.split(r"[^a-z0-9]+", value.lower()))
    return tag not in ("html", "body") and not KEEP_WORDS.isdisjoint(named)


def _unwanted(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in DROP_TAGS or tag == "header" and not in_article:
        return True
    if "=" not in attributes and "hidden" not in attributes.lower():
        return False
    words: set[str] = set()
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name != "aria-hidden":
            words.update(re.split(r"[^a-z0-9]+", value))
    return tag not in ("html", "body", "article", "main") and bool(words & DROP_WORDS) and not (words & KEEP_WORDS and not words & {"comment", "comments", "ad", "ads", "sidebar", "advert"})


def _tree(page: str):
    """Parallel lists over elements in document order: tag, parent, dropped, labelled; and the text runs as (element, text)."""
    tags, parents, dropped, labelled, runs = ["#page"], [-1], [False], [False], []
    stack, at, n_articles = [0], 0, 0

    def close_to(depth: int) -> None:
        nonlocal n_articles
        while len(stack) > depth:
            n_articles -= tags[stack.pop()] in ("article", "main")

    def close_like(names, stops) -> None:
        for depth in range(len(stack) - 1, 0, -1):
            tag = tags[stack[depth]]
            if tag in names:
                close_to(depth)
                return
            if tag in stops:
                return

    text = page.find("<")
    if text < 0:
        text = len(page)
    if text:
        runs.append((0, page[:text]))
    at, size = text, len(page)
    while at < size:
        token = _TOKEN.match(page, at)
        if token is None:  # a lone "<" is text
            end = page.find("<", at + 1)
            end = size if end < 0 else end
            runs.append((stack[-1], page[at:end]))
            at = end
            continue
        at = token.end()
        tag = (token[2] or "").lower()
        if tag and not token[1]:
            if tag in BLOCK:
                close_like(("p",), ("article", "div", "section", "main", "td", "th", "li", "blockquote", "button", "body", "aside", "form"))
            if tag in CLOSES:
                names, stops = CLOSES[tag]
                close_like(names.split(), stops)
            me = len(tags)
            tags.append(tag)
            parents.append(stack[-1])
            dropped.append(dropped[stack[-1]] or tag in RAW or _unwanted(tag, token[3] or "", n_articles > 0))
            labelled.append(not dropped[me] and _labelled(tag, token[3] or ""))
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
                at = size if end is None else end.start()
                if end is not None:
                    at = page.find(">", at) + 1 or size
            elif tag not in VOID and not (token[3] or "").endswith("/"):
                stack.append(me)
                n_articles += tag in ("article", "main")
            elif tag == "br" or tag == "hr":
                runs.append((me, " "))
        elif tag:
            for depth in range(len(stack) - 1, 0, -1):
                if tags[stack[depth]] == tag:
                    close_to(depth)
                    break
        end = page.find("<", at)
        end = size if end < 0 else end
        if end > at:
            runs.append((stack[-1], page[at:end]))
            at = end
    return tags, parents, dropped, labelled, runs


def _composite(c: int, t: int, lc: int, lt: int, share: float) -> float:
    """Composite density of characters, tags, link characters, link tags; the body's share of links."""
    base = math.log(c / max(c - lc, 1) * lc + share * c + math.e)
    return c / max(t, 1) * math.log(c / max(lc, 1) * max(t, 1) / max(lt, 1) + 1) / math.log(base + math.e - 1)


def _densities(tags, parents, dropped, runs):
    n = len(tags)
    chars, n_tags, link_chars, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    linked, in_p, own, prose = [False] * n, [False] * n, [0] * n, [0] * n
    for i in range(1, n):
        linked[i] = linked[parents[i]] or tags[i] == "a"
        in_p[i] = in_p[parents[i]] or tags[i] == "p"
    for i, text in runs:
        if not dropped[i]:
            size = len("".join(text.split()))
            chars[i] += size
            own[i] += size
            if linked[i]:
                link_chars[i] += size
            elif in_p[i]:
                prose[i] += size
    for i in range(n - 1, 0, -1):
        if not dropped[i]:
            p = parents[i]
            chars[p] += chars[i]
            link_chars[p] += link_chars[i]
            prose[p] += prose[i]
            n_tags[p] += n_tags[i] + 1
            link_tags[p] += link_tags[i] + (tags[i] == "a")
    body = next((i for i, t in enumerate(tags) if t == "body"), 0)
    share = link_chars[body] / max(chars[body], 1)
    density, total = [0.0] * n, [0.0] * n
    for i in range(n):
        if dropped[i] or not chars[i]:
            continue
        density[i] = _composite(chars[i], n_tags[i], link_chars[i], link_tags[i], share)
    for i in range(1, n):
        total[parents[i]] += density[i]
    return density, total, body, share, (chars, n_tags, link_chars, link_tags, own, prose)


def _picked(tags, parents, dropped, labelled, path, top, density, share, counts) -> tuple[set[int], set[int]]:
    """The elements that are kept whole, and those whose own text is kept: ``top`` and what its ancestors add."""
    chars, n_tags, link_chars, link_tags, own, prose = counts
    n = len(tags)
    blocks, holds, children = [x in BLOCK for x in tags], list(labelled), {i: [] for i in path}
    for i in range(n - 1, 0, -1):
        p = parents[i]
        if not dropped[i]:
            blocks[p], holds[p] = blocks[p] or blocks[i], holds[p] or holds[i]
            if p in children and chars[i]:
                children[p].append(i)
    bar = SHARE * density[path[0]]
    low = min(bar, min(density[i] for i in path))
    whole, text = {top}, set()
    parts = children[top]
    if not labelled[top] and not own[top] and parts and all(blocks[i] and tags[i] != "p" for i in parts):
        lists = {i for i in parts if tags[i] not in HEADINGS and density[i] < low and link_tags[i] >= LINKS and 2 * link_chars[i] > chars[i]}
        whole = set(parts) - lists if lists else whole
    for at in path[path.index(top) : -1]:
        if tags[at] == "main":
            break
        p, loose, before_kept = parents[at], [], False
        for i in children[p]:  # the last comes first
            if i == at:
                before_kept = True
            elif not blocks[i]:
                loose.append(i)
            elif tags[i] in HEADINGS and before_kept:
                whole.add(i)
            else:
                before_kept = density[i] >= (low if holds[i] else bar) or prose[i] >= PROSE and 4 * link_chars[i] < chars[i]
                if before_kept:
                    whole.add(i)
        c, lc, lt = (own[p] + sum(chars[i] for i in loose), sum(link_chars[i] for i in loose), sum(link_tags[i] + (tags[i] == "a") for i in loose))
        if c and _composite(c, sum(n_tags[i] + 1 for i in loose), lc, lt, share) >= bar:
            whole.update(loose)
            text.add(p)
    return whole, text


def main_text(page: str | None) -> str:
    """The main text of one page."""
    if not page:
        return ""
    tags, parents, dropped, labelled, runs = _tree(page)
    density, total, body, share, counts = _densities(tags, parents, dropped, runs)
    inside = [False] * len(tags)
    for i in range(len(tags)):
        inside[i] = i == body or i > 0 and inside[parents[i]]
    live = [i for i in range(len(tags)) if not dropped[i] and (inside[i] or not body)]
    if not live:
        return ""
    core = max(live, key=lambda i: (total[i] or density[i] / 2, -i))
    path, at = [], core
    while at >= 0:
        path.append(at)
        if at == body:
            break
        at = parents[at]
    top = next((i for i in path if labelled[i]), core)
    whole, text_of = _picked(tags, parents, dropped, labelled, path, top, density, share, counts)
    chosen = [False] * len(tags)
    block = [0] * len(tags)
    for i in range(len(tags)):
        p = parents[i]
        chosen[i] = i in whole or p >= 0 and chosen[p] and not dropped[i]
        block[i] = i if tags[i] in BLOCK or p < 0 else block[p]
    # a block's text ends where another block begins or ends
    out: list[list[str]] = []
    last = -1
    opened = 0
    for i, text in runs:
        begun = any(tags[k] in BLOCK for k in range(opened + 1, i + 1)) if i > opened else False
        opened = max(opened, i)
        if not chosen[i] and i not in text_of:
            continue
        if block[i] != last or begun:
            out.append([])
            last = block[i]
        out[-1].append(text)
    lines = (" ".join(html.unescape("".join(parts)).split()) for parts in out)
    return "\n".join(x for x in lines if x)


@arrow_udf(StringType())
def _main_text(pages: pa.Array) -> pa.Array:
    return pa.array([main_text(x) for x in pages.to_pylist()], pa.string())


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each input row: id, url, text, n_chars (code points)."""
    rows = df.select(pick(df, id_col).alias(id_col), pick(df, url_col).alias(url_col), _main_text(pick(df, html_col)).alias("text"))
    return rows.withColumn("n_chars", F.length("text").cast("long"))
