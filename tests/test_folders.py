"""Links to folders: a folder's documents are joined where they are asked for, never held by a reference."""

import pytest

from inkgraph.docgraph import DocGraph
from inkgraph.model import Config

N = 40


def text(k):
    return f"# Doc {k}\n\nSee [all](../{'b' if k % 2 else 'a'}) and [one](../a/d{(k * 7) % N}.md).\n".encode()


def path(k):
    return f"a/d{k}.md" if k < 30 else f"b/d{k}.md"


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame([(path(k), bytearray(text(k))) for k in range(N)], "doc_id string, content binary").selectExpr("*", "timestamp'2024-01-01' AS mod_time").cache()
    return docs, spark.createDataFrame([], "path string")


def wanted(strict=False):
    ids = {path(k) for k in range(N)}
    edges = set()
    for k in range(N):
        one = f"a/d{(k * 7) % N}.md"
        edges |= {(path(k), one)} & {(path(k), x) for x in ids}
        edges |= set() if strict else {(path(k), x) for x in ids if x.startswith("b/" if k % 2 else "a/")}
    return {(a, b) for a, b in edges if a != b}


def test_no_reference_holds_a_folders_documents(spark, tables):
    g = DocGraph(spark, *tables)
    assert "children" not in g.refs.columns
    assert {(r["src_doc"], r["dst_doc"]) for r in g.edges.collect() if r["src_doc"] != r["dst_doc"]} == wanted()
    folder = [r for r in g.edges.collect() if r["line"] == 0]
    assert len(folder) == N // 2 * 30 + N // 2 * 10 and all(r["src"].startswith(r["src_doc"] + "#doc-") for r in folder)


def test_projection_has_each_edge_once_without_comparing_what_folders_give(spark, tables):
    g = DocGraph(spark, *tables)
    found = [tuple(r) for r in g.projection.select("src", "dst").collect()]
    assert len(found) == len(set(found)) and set(found) == wanted()
    strict = DocGraph(spark, *tables, Config(strict=True))
    assert {tuple(r) for r in strict.projection.collect()} == wanted(strict=True)
    assert DocGraph(spark, *tables, Config(nav_types=("wikilink",))).projection.isEmpty()


def test_backlinks_of_folders_and_documents_meet_in_one_sorted_row(spark, tables):
    into = {}
    for a, b in wanted():
        into.setdefault(b, []).append(a)
    assert {r["id"]: r["backlinks"] for r in DocGraph(spark, *tables).backlinks.collect()} == {b: sorted(x) for b, x in into.items()}
