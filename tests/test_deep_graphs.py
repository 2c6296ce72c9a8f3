"""Graphs of many levels, and reports of some kinds alone."""

from inkgraph.docgraph import DocGraph
from inkgraph.operators import findings as N
from inkgraph.operators import reach as B

from . import brute


def test_a_deep_graph_takes_few_jobs(spark):
    edges = [(k, k + 1) for k in range(300)] + [(k, k + 3) for k in range(0, 300, 7)] + [(250, 900), (901, 5), (7, 2)]
    proj = spark.createDataFrame(edges, "src long, dst long").coalesce(1)
    roots = spark.createDataFrame([(0,), (100,), (77777,)], "id long").coalesce(1)
    spark.sparkContext.setJobGroup("deep", "deep")
    found = {r["id"]: r["hops"] for r in B.hops(proj, roots).collect()}
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("deep"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert found == brute.bfs(brute.adjacency(range(1000), edges), [0, 100]) | {77777: 0}
    assert jobs < 200
    assert {r["id"]: r["hops"] for r in B.hops(proj, roots, max_rounds=20).collect()} == {v: d for v, d in found.items() if d <= 20}


class Narrow(DocGraph):
    @property
    def cuts(self):
        raise AssertionError("not asked for")

    gaps = suggestions = betweenness = scent = cuts


def test_a_report_of_some_kinds_computes_these_alone(spark):
    docs = spark.createDataFrame([("README.md", bytearray(b"# R\n\n[a](a.md)\n")), ("a.md", bytearray(b"# A\n")), ("b.md", bytearray(b"# B\n"))], "doc_id string, content binary").selectExpr("*", "timestamp'2024-01-01' AS mod_time")
    g = Narrow(spark, docs, spark.createDataFrame([], "path string"))
    assert [r["id"] for r in N.report(g, kinds=("orphan", "dead-end", "unreachable")).collect()] == ["dead-end:a.md", "orphan:b.md"]
