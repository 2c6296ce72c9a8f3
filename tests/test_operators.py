"""Operators at the edges of what they take: large counts, long chains, many rounds, ignore lines."""

import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from inkgraph.docgraph import DocGraph
from inkgraph.functions import paths as P
from inkgraph.model import Config
from inkgraph.operators import components as C
from inkgraph.operators import findings as N
from inkgraph.operators import graph as G
from inkgraph.operators import rank as R
from inkgraph.operators import reach as B
from inkgraph.plans.lineage import Grown, Scratch
from inkgraph.sources import markdown as M


def test_hits_with_many_links_to_one_page(spark):
    """A page with 100,000 links to it: the squared sum has more than ten digits."""
    nodes = spark.range(100_001)
    found = R.hits(nodes, nodes.where("id > 0").select(F.col("id").alias("src"), F.lit(0).cast("long").alias("dst")), max_rounds=2).where("id = 0").first()
    assert found["authority"] == pytest.approx(1.0) and found["hub"] == 0.0


def test_strong_components_of_a_long_chain_take_linear_time():
    def seconds(n):
        began = time.perf_counter()
        C._strong(pd.DataFrame({"src": range(n), "dst": range(1, n + 1)}))
        return time.perf_counter() - began

    seconds(1000)
    assert seconds(80_000) < 5


def test_grown_table_stays_few_tables(spark):
    scratch = Scratch(spark, "test-grown")
    grown = Grown(scratch, "rows", fan=3)
    for k in range(20):
        grown.add(spark.createDataFrame([(k,)], "id int"))
    assert sorted(r["id"] for r in grown.table().collect()) == list(range(20))
    assert sum(map(len, grown.sizes)) <= 2 * len(grown.sizes)


def test_hops_over_many_rounds(spark):
    proj = spark.range(20).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    got = {r["id"]: r["hops"] for r in B.hops(proj, spark.createDataFrame([(0,), (15,)], "id long")).collect()}
    assert got == {k: k if k < 15 else k - 15 for k in range(21)}
    assert B.shortest_path(proj, 0, 12) == list(range(13))


def test_ranked_split_is_the_sorted_order(spark):
    rows = [(k, (k * 37 % 10) / 10, k % 3) for k in range(200)]
    got = G.ranked_split(spark.createDataFrame(rows, "id int, authority double, in_degree int")).collect()
    order = [r[0] for r in sorted(rows, key=lambda r: (-r[1], -r[2], r[0]))]
    assert [r["id"] for r in sorted(got, key=lambda r: r["place"])] == order and sorted(r["place"] for r in got) == list(range(1, 201))
    assert {r["id"] for r in got if r["primary"]} == set(order[:20])


IGNORE = ["drafts/", "x.md", "!keep.md", "/top.md", "a/**/z.md", "# no", "b*.md", "!b1.md"]


def test_ignored_as_a_column(spark):
    paths = ["drafts/a.md", "q/drafts/b/c.md", "drafts", "x.md", "deep/er/x.md", "keep.md", "top.md", "n/top.md", "a/z.md", "a/b/c/z.md", "b1.md", "b2.md", "ab.md", ""]
    got = {r["path"]: r["hit"] for r in spark.createDataFrame([(p,) for p in paths], "path string").select("path", P.ignored(F.col("path"), IGNORE).alias("hit")).collect()}
    assert got == {p: P.is_ignored(p, P.ignore_rules(IGNORE)) for p in paths}


def test_excluded_documents_by_ignore_lines(spark):
    rows = [("drafts/a.md", "info", None), ("deep/x.md", "info", None), ("deep/x.md", "error", None), ("keep.md", "info", None), ("ok.md", "info", "drafts/a.md"), ("ok.md", "info", "ok2.md")]
    found = spark.createDataFrame([(d, s, "bridge", {"targetDocument": t}) for d, s, t in rows], "document string, severity string, kind string, details map<string,string>")
    left = N.select(found, everything=True, exclude=("drafts/", "x.md", "!keep.md")).collect()
    assert sorted((r["document"], r["severity"], r["details"]["targetDocument"]) for r in left) == sorted([rows[2], rows[3], rows[5]], key=str)


def files(spark, **texts):
    return spark.createDataFrame([(k.replace("__", "/") + ".md", v.encode()) for k, v in texts.items()], "doc_id string, content binary").withColumn("mod_time", F.lit("2024-01-01").cast("timestamp"))


def test_section_hangs_on_the_nearest_one_with_a_slug(spark):
    docs = M.documents(files(spark, a="# One\n\n## !!!\n\n### Three\n\n## Four\n"))
    slugs = [r["slug"] for r in M.sections(docs).orderBy("ord").collect()]
    edges = {tuple(r) for r in M.contains(docs).collect()}
    assert ("a.md", "a.md#one") in edges and ("a.md#one", "a.md#four") in edges
    assert ("a.md#one" if slugs[1] == "" else f"a.md#{slugs[1]}", "a.md#three") in edges


def test_configured_navigation_reaches_scent(spark):
    g = lambda types: DocGraph(spark, files(spark, a="# A\n\n[zzz](b.md) and [[b]]\n", b="# Other Name\n"), spark.createDataFrame([], "path string"), Config(nav_types=types))
    assert {r["anchor"] for r in g(("wikilink",)).scent.collect()} <= {"b"}
    assert "zzz" in {r["anchor"] for r in g(("relative-link",)).scent.collect()}


def test_duplicates_and_headings(spark):
    docs = M.documents(files(spark, a="# A\n\n## B\n", b="no heading\n"))
    assert M.heading_count(docs).first()["headings"] == 2 and M.duplicate_ids(docs).count() == 0
    assert [tuple(r) for r in M.duplicate_ids(docs.unionByName(docs.where("doc_id = 'a.md'"))).collect()] == [("a.md", 2)]
    assert M.heading_count(docs.limit(0)).first()["headings"] == 0
