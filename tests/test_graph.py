"""Graph operators against brute force, hand-computed values and themselves under other partitions."""

import random

import pytest
from pyspark.sql import functions as F

from inkgraph.operators import components as C
from inkgraph.operators import graph as G
from inkgraph.operators import paths as A
from inkgraph.operators import rank as R
from inkgraph.operators import reach as B

from . import brute

GOLDEN = {
    "README.md": ["docs/guide.md", "docs/sub/overview.md"], "docs/README.md": ["docs/guide.md"], "docs/cycle/alpha.md": ["docs/cycle/beta.md"], "docs/cycle/beta.md": ["docs/cycle/alpha.md"], "docs/flow/aside.md": ["docs/flow/branch.md"],
    "docs/flow/branch.md": ["docs/flow/terminal.md"], "docs/guide.md": ["README.md", "docs/sub/overview.md"], "docs/island/four.md": ["docs/island/one.md", "docs/island/two.md"], "docs/island/one.md": ["docs/island/two.md"],
    "docs/island/three.md": ["docs/island/one.md", "docs/island/two.md"], "docs/island/two.md": ["docs/island/one.md"], "docs/links.md": ["README.md", "docs/guide.md", "docs/sub/overview.md"], "docs/stray.md": ["README.md"],
    "docs/sub/overview.md": ["docs/flow/branch.md", "docs/guide.md"], "CHANGELOG.md": [], "docs/project/notes.md": [], "docs/team/notes.md": [], "docs/flow/terminal.md": [],
}


def golden():
    return sorted(GOLDEN), [(a, b) for a, bs in GOLDEN.items() for b in bs]


def randomised(seed):
    r = random.Random(seed)
    nodes = [f"d{k:02}" for k in range(r.choice([2, 5, 12, 20]))]
    return nodes, [(r.choice(nodes), r.choice(nodes)) for _ in range(r.randrange(1, 3 * len(nodes)))]


GRAPHS = [golden(), (["a"], []), (["a", "b", "c"], [("a", "a"), ("a", "b"), ("b", "a"), ("a", "b")]), *[randomised(s) for s in range(3)]]


@pytest.fixture(scope="module", params=range(len(GRAPHS)), ids=lambda k: f"graph{k}")
def case(request, spark):
    nodes, edges = GRAPHS[request.param]
    df = spark.createDataFrame([(v,) for v in nodes], "id string")
    proj = G.projection(spark.createDataFrame(edges, "src string, dst string")).cache()
    return nodes, edges, df, proj


def rows(df):
    return {r[0]: r[1] for r in df.collect()}


def test_degrees_and_reach(case, spark):
    nodes, edges, df, proj = case
    out = brute.adjacency(nodes, edges)
    into = brute.adjacency(nodes, [(b, a) for a, b in edges])
    assert {r["id"]: (r["in_degree"], r["out_degree"]) for r in G.degrees(df, proj).collect()} == {v: (len(into[v]), len(out[v])) for v in nodes}
    roots = nodes[:1]
    found = B.hops(proj, spark.createDataFrame([(v,) for v in roots], "id string"))
    assert rows(found) == brute.bfs(out, roots)
    assert B.hops(proj, df.limit(0)).count() == 0
    assert rows(G.backlinks(proj)) == {v: x for v, x in into.items() if x}


def test_components(case):
    nodes, edges, df, proj = case
    weak = C.weak_components(df, proj).cache()
    strong = C.strong_components(df, proj, weak).cache()
    assert rows(weak) == brute.weak(nodes, edges) and rows(strong) == brute.strong(nodes, edges)
    assert rows(C.strong_components(df, proj, weak, max_edges=0)) == rows(strong)
    assert rows(C.bowtie(df, proj, weak, strong)) == brute.bowtie(nodes, edges)
    points, bridges = brute.cuts(nodes, edges)
    got = C.cut_structure(proj, weak).collect()
    assert {r["a"] for r in got if r["kind"] != "bridge"} == points and {(r["a"], r["b"]) for r in got if r["kind"] == "bridge"} == bridges


def test_scores(case):
    nodes, edges, df, proj = case
    assert rows(R.pagerank(df, proj)) == pytest.approx(brute.pagerank(nodes, edges), abs=1e-6)
    hub, auth = brute.hits(nodes, edges)
    got = R.hits(df, proj).collect()
    assert {r["id"]: r["hub"] for r in got} == pytest.approx(hub, abs=1e-6) and {r["id"]: r["authority"] for r in got} == pytest.approx(auth, abs=1e-6)


def test_all_pairs(case, monkeypatch):
    nodes, edges, df, proj = case
    out = brute.adjacency(nodes, edges)
    for limit in (A.SHARED_EDGES, -1):  # both ways: shared adjacency, and joins
        monkeypatch.setattr(A, "SHARED_EDGES", limit)
        assert {(r["src"], r["dst"]): r["hops"] for r in A.distances(df, proj).collect()} == {(v, w): d for v in nodes for w, d in brute.bfs(out, [v]).items()}
        assert rows(A.betweenness(df, proj)) == pytest.approx(brute.betweenness(nodes, edges), abs=1e-9)
    got = {**A.compactness(df, proj).first().asDict(), **A.path_lengths(df, proj).first().asDict(), **G.clustering(proj).first().asDict()}
    assert got == pytest.approx(brute.navigability(nodes, edges), abs=1e-9)


def test_suggestions(case):
    nodes, edges, df, proj = case
    found, truncated, hubs = G.link_prediction(proj)
    want = brute.suggestions(nodes, edges)
    got = sorted((tuple(r) for r in found.collect()), key=lambda r: (-round(r[5], 9), -r[2], r[0], r[1]))
    assert [r[:5] for r in got] == [r[:5] for r in want] and [r[5] for r in got] == pytest.approx([r[5] for r in want]) and not truncated and not hubs


def test_shortest_path(case):
    nodes, edges, _, proj = case
    out = brute.adjacency(nodes, edges)
    for src, dst in ((nodes[0], nodes[-1]), (nodes[0], nodes[0])):
        parent, queue = {src: None}, [src]
        for v in queue:
            for w in out[v]:
                if w not in parent:
                    parent[w] = v
                    queue.append(w)
        path, at = [], dst if dst in parent else None
        while at is not None:
            path.append(at)
            at = parent[at]
        assert B.shortest_path(proj, src, dst) == path[::-1]


def test_golden_numbers(spark):
    nodes, edges = golden()
    df, proj = spark.createDataFrame([(v,) for v in nodes], "id string"), spark.createDataFrame(edges, "src string, dst string").cache()
    weak = C.weak_components(df, proj).cache()
    score = R.pagerank(df, proj).cache()
    assert {r["id"]: round(r["score"], 6) for r in G.top_n(score, 3).collect()} == {"docs/island/one.md": 0.164040, "docs/island/two.md": 0.164040, "docs/guide.md": 0.093990}
    gaps, more = G.gaps(weak)
    assert [tuple(r) for r in gaps.collect()] == [("README.md", "docs/cycle/alpha.md"), ("README.md", "docs/island/four.md"), ("docs/cycle/alpha.md", "docs/island/four.md")] and not more
    trails = {r["root"]: r["order"] for r in C.trails(df, proj, weak, C.strong_components(df, proj, weak), score).collect()}
    assert trails["docs/guide.md"] == ["docs/README.md", "docs/flow/aside.md", "docs/links.md", "docs/stray.md", "docs/guide.md", "docs/sub/overview.md", "README.md", "docs/flow/branch.md", "docs/flow/terminal.md"]
    assert len(trails) == 6


def test_gap_cap(spark):
    pairs = spark.range(1500).select(F.col("id").cast("int").alias("component"))
    members = pairs.withColumn("id", F.col("component")).unionByName(pairs.withColumn("id", F.col("component") + 10_000)).select("id", "component")
    found, more = G.gaps(members)
    assert found.count() == 1000 and more and found.first() == (0, 1)


def test_long_chain(spark):
    n = 3000
    edges = spark.range(n - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    df = spark.range(n)
    assert C.weak_components(df, edges).select("component").distinct().count() == 1
    assert C.strong_components(df, edges).select("component").distinct().count() == n


@pytest.mark.parametrize("parts", ["1", "2", "8"])
def test_same_under_any_partitioning(spark, parts):
    nodes, edges = randomised(99)
    r = random.Random(int(parts))
    r.shuffle(edges)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        df, proj = spark.createDataFrame([(v,) for v in nodes], "id string"), G.projection(spark.createDataFrame(edges, "src string, dst string"))
        got = sorted(tuple(x) for x in R.pagerank(df, proj).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    global _first
    _first = globals().get("_first", got)
    assert got == _first
