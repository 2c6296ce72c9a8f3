"""License scans, HTML extraction, line dedup."""

import random
import re

import xxhash

from inkgraph.llm import html_text as H
from inkgraph.llm import licenses as L
from inkgraph.llm import line_dedup as D

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

# --- license scans


def words_of(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))


def base_of(w):
    return [(k, label) for k in range(len(w)) for p, label in L.BASE if w[k : k + len(p.split())] == p.split()]


def detections_of(w):
    found = []
    for i, word in enumerate(w):
        context, hits = " ".join(w[i:]), []
        for order, (gates, pattern, label, priority, confidence) in enumerate(L.rules()):
            if word in gates and (m := re.match(f"({pattern})(?= |$)", context, re.A)) and m[1]:
                hits.append((priority, len(m[1]), -order, m[1], label, confidence))
        if hits:
            priority, _, _, text, label, confidence = max(hits)
            found.append((i, i + 1 + text.count(" "), label, priority, confidence))
    return [d for k, d in enumerate(found) if not any(p[1] >= d[1] and p[3] >= d[3] for p in found[:k])]


TEXTS = [
    None, "", "mit", "Licensed under the Apache License, Version 2.0 (the License)", "CC BY-NC 4.0 and cc by cc by", "GNU General Public License version 3 or later. GNU General Public License", "GPLv3 lgpl 2.1",
    "MIT License mit license", "BSD 3-Clause License, two clause BSD license", "Creative Commons Attribution-ShareAlike 4.0 International License", "released under the MIT license. All rights reserved", "Permission is hereby granted, free of charge, to any person obtaining a copy",
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version. SPDX-License-Identifier: MIT",
    "Neither the name of the Example Foundation of Anywhere nor the names of its contributors may be used to endorse or promote products", "https://www.apache.org/licenses/LICENSE-2.0 gplv2 three-clause BSD",
    "apache" + " filler" * 3000 + " apache license 2.0", "Mozilla Public License 2.0, Eclipse Public License - v 2.0", "public domain; CC0 1.0", "gnu\ngeneral\tpublic\x00license", "the gnu général public license",
]


def test_license_scan(spark):
    assert len(L.rules()) > 300
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*TEXTS, TEXTS[3], TEXTS[3]])], "doc_id int, text string, labels string")
    got = {r["doc_id"]: r for r in L.scan(df).collect()}
    for i, t in enumerate([*TEXTS, TEXTS[3], TEXTS[3]]):
        w, r = words_of(t), got[i]
        base, found = base_of(w), detections_of(w)
        assert r["n_words"] == len(w) and [tuple(p) for p in r["base"]] == base
        assert [tuple(d) for d in r["detections"]] == found, t
        assert r["labels"] == sorted({x for _, x in base} | {d[2] for d in found})
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(r["labels"])
    assert "apache-2.0" in got[3]["labels"] and "cc-by-nc-4.0" in got[4]["labels"] and "gpl-3.0" in got[5]["labels"]
    assert L.scan(df.limit(0)).count() == 0


# --- HTML extraction

PAGES = [
    (None, ""), ("", ""), ("plain  text", "plain text"), ("<p>a<p>b", "a\nb"), ("<article><p>unclosed <b>bold", "unclosed bold"), ("<article><p>cut <a hre", "cut"), ("<p>1 < 2 and 3</p>", "1 < 2 and 3"),
    ("<article><p>a<br>b &amp; c&nbsp;&eacute;&am</p>text<p>c</p></article>", "a b & c é&am\ntext\nc"),
    ("<body><nav><a href=x>menu</a></nav><div class='ad'>buy</div><article><h1>T</h1><p>one two three</p><!-- no --><script>x='</p>'</script></article><footer>f</footer></body>", "T\none two three"),
    ("<body><header>Site</header><main><article><header><h1>Title</h1></header><p>Text</p><aside>no</aside><ul><li>i<li>j</ul><pre>a\n  b</pre></article></main><form><p>f</p></form></body>", "Title\nText\ni\nj\na b"),
    ("<html><body><div><div class='post'><h1>T</h1><section><p>One one one one one one</p><p>Two two two</p></section><section><p>Three three <a href=x>link</a></p></section></div>"
     "<div class=comments><p>Nice nice nice nice nice nice nice nice nice nice nice</p></div></div></body></html>", "T\nOne one one one one one\nTwo two two\nThree three link"),
    ("<article><h1>Short</h1></article><div class=sidebar>" + "much more text here " * 30 + "</div>", "Short"),
    ("<div>" * 5000 + "deep" + "</div>" * 7, "deep"), ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"), ("<article><textarea>x</textarea><p>y</p></div></article>", "y"),
]


def test_html(spark):
    for page, text in PAGES:
        assert H.main_text(page) == text, page
    df = spark.createDataFrame([(i, None, p, "x") for i, (p, _) in enumerate(PAGES)] + [(None, "u", PAGES[3][0], "x")] * 2, "page_id long, url string, html string, text string")
    got = H.extract(df).collect()
    assert {r["page_id"]: r["text"] for r in got if r["page_id"] is not None} == {i: t for i, (_, t) in enumerate(PAGES)}
    assert all(r["n_chars"] == len(r["text"]) for r in got) and len(got) == len(PAGES) + 2
    assert H.extract(df.limit(0)).count() == 0


def test_html_never_fails():
    r = random.Random(10)
    bits = ["<p>", "</p>", "<div", " class='x", '"', ">", "text ", "&", "&lt", "<!--", "-->", "<script>", "</script>", "<", "</", "<li>", "<a href=", "é", "\n", "<article>", "</article>", "<!doctype", "<br/>"]
    for _ in range(500):
        H.main_text("".join(r.choice(bits) for _ in range(r.randrange(30))))


# --- line dedup


def chunks(t):
    lines = (t or "").split("\n")
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in lines]
    out, start = [], 0
    for i in range(len(lines)):
        before = h[i - 1] if i else 0
        rolled = h[i] ^ ((before << 1 | before >> 63) & (2**64 - 1))
        if (rolled - 2**64 * (rolled >> 63)) % D.DIVISOR == 0 or i == len(lines) - 1:
            out.append((start, lines[start : i + 1]))
            start = i + 1
    return out


def cleaned(rows):
    worth = lambda c: sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) for x in c) >= D.MIN_LINES
    first = {}
    for i, t in rows:
        for s, c in chunks(t):
            if worth(c):
                first["\n".join(c)] = min(first.get("\n".join(c), (i, s)), (i, s))
    return sorted((i, "\n".join(x for s, c in chunks(t) if not worth(c) or first["\n".join(c)] == (i, s) for x in c)) for i, t in rows)


def test_line_dedup(spark):
    r = random.Random(11)
    pool = [f"shared line number {k} with some words" for k in range(12)]
    rows = [(i, "\n".join(r.choice([r.choice(pool), f"own {i} {r.random()}", "", " "]) for _ in range(r.randrange(30)))) for i in range(80)]
    block = "\n".join(f"passage sentence {k} that many documents share" for k in range(25))
    rows += [(100 + i, f"intro {i}\n{block}\noutro {i}") for i in range(40)] + [(200, block), (201, block), (300, None), (301, ""), (302, "\n\n\n")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = D.line_dedup(df).collect()
    assert sorted((x["doc_id"], x["text"]) for x in got) == cleaned(rows)
    for x in got:
        lines = x["text"].split("\n") if x["n_lines"] > x["n_removed_lines"] else []
        assert x["n_lines"] - x["n_removed_lines"] == len(lines)
    assert any(x["n_removed_lines"] > 10 for x in got if 100 < x["doc_id"] < 140)


def test_line_dedup_edges(spark):
    block = "\n".join(f"passage sentence {k} that two documents share" for k in range(20))
    df = spark.createDataFrame([(1, block, "a"), (1, block, "a"), (None, block, "b"), (2, "lonely line", "c")], "doc_id long, text string, gone string")
    got = D.line_dedup(df).collect()
    assert len(got) == 4 and [x["n_removed_lines"] for x in got if x["doc_id"] == 2] == [0]
    assert len({(x["doc_id"], x["text"]) for x in got}) == 3
    assert D.line_dedup(df.limit(0)).count() == 0
