"""Line dedup by repeated passages, against a search of all passages."""

import random
from hashlib import md5

from inkgraph.llm import line_dedup as D


def passages(lines):
    worded = [i for i, x in enumerate(lines) if x.strip(" \t\n\x0b\f\r")]
    for a, i in enumerate(worded):
        for j in worded[a + D.MIN_LINES - 1 :]:
            text = "\n".join(lines[i : j + 1])
            yield i, j + 1, text


def deduped(rows):
    """Lines of any passage that occurs before, whatever its length, go."""
    rows = [((i, md5(f"{i}\0{t or ''}".encode()).digest()), (t or "").split("\n")) for i, t in rows]
    first = {}
    for row, lines in rows:
        for i, j, text in passages(lines):
            first[text] = min(first.get(text, (row, i, j)), (row, i, j))
    out = []
    for row, lines in rows:
        gone = {k for i, j, text in passages(lines) if row != first[text][0] or i >= first[text][2] for k in range(i, j)}
        out.append((row[0], "\n".join(x for k, x in enumerate(lines) if k not in gone), len(gone)))
    return sorted(out)


def found(spark, rows):
    got = D.passage_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for x, t in zip(sorted(got, key=lambda x: x["doc_id"]), [t or "" for _, t in sorted(rows, key=lambda x: x[0])]):
        assert x["n_lines"] == t.count("\n") + 1 and x["n_removed_chars"] == len(t) - len(x["text"])
    return sorted((x["doc_id"], x["text"], x["n_removed_lines"]) for x in got)


def test_passages_of_two_to_six_lines_go_whatever_stands_beside_them(spark):
    rows = []
    for n in range(2, 7):
        for copy in range(6):
            block = "\n".join(f"passage {n} has this line {k} wherever it stands" for k in range(n))
            rows.append((10 * n + copy, f"own words {n} {copy} before it\n{block}\nown words {n} {copy} after it"))
    got = {i: t.split("\n") for i, t, _ in found(spark, rows)}
    for i, t in rows:
        own = [x for x in t.split("\n") if x.startswith("own")]
        assert got[i] == (t.split("\n") if i % 10 == 0 else own)


def test_passages_against_all_passages(spark):
    r = random.Random(12)
    pool = [f"shared line {k} with some more words" for k in range(8)] + ["a", "b", "c c", "", " ", "short one"]
    rows = [(i, "\n".join(r.choice(pool) if r.random() < 0.7 else f"own {r.random()}" for _ in range(r.randrange(25)))) for i in range(60)]
    tail = "a long first line of forty characters, or more\nx\ny\nz"
    rows += [(100, "p\n" + tail + "\nq"), (101, "r\n" + tail + "\ns"), (102, "same same same same same\n" * 7), (103, None), (104, ""), (105, "\n\n"), (106, "\n".join("abcdefghijklmnopqrstuvwxyz")), (107, "0\n" + "\n".join("abcdefghijklmnopqrstuvwxyz"))]
    got = found(spark, rows)
    assert got == deduped(rows)
    assert (101, "r\ns", 4) in got and (102, "same same same same same\nsame same same same same\n", 5) in got and (107, "0", 26) in got


def test_passages_of_repeated_rows_and_ids(spark):
    block = "\n".join(f"passage sentence {k} that documents share" for k in range(3))
    df = spark.createDataFrame([(1, block), (1, block), (None, f"x\n{block}"), (2, "lonely line"), (1, f"y\n{block}")], "doc_id long, text string")
    got = D.passage_dedup(df).collect()
    assert sorted((x["doc_id"] or 0, x["text"]) for x in got) == [(0, f"x\n{block}"), (1, ""), (1, ""), (1, "y"), (2, "lonely line")]
    assert D.passage_dedup(df.limit(0)).count() == 0


def test_very_long_text_and_clashing_names(spark):
    own = [f"line {k} of a very long text" for k in range(60_000)]
    rows = [(1, "\n".join(own), "q", 1), (2, "\n".join(["before", *own[30_000:30_100], "after"]), "q", 1)]
    got = {x["doc_id"]: x for x in D.passage_dedup(spark.createDataFrame(rows, "doc_id long, text string, hash string, n_lines int")).collect()}
    assert got[1]["n_removed_lines"] == 0 and got[1]["text"] == rows[0][1] and got[2]["text"] == "before\nafter"
