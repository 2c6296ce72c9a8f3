"""Cut vertices and bridges of a component that is larger than a kernel may get."""

import random
from itertools import combinations

from inkgraph.operators import components as C


def parts(vertices, edges):
    left, n = set(vertices), 0
    while left:
        n, todo = n + 1, [left.pop()]
        while todo:
            v = todo.pop()
            near = {b if a == v else a for a, b in edges if v in (a, b)} & left
            left -= near
            todo += near
    return n


def test_cuts_of_a_component_beyond_the_kernel(spark):
    rng = random.Random(5)
    edges = {(a, b) for block in (range(0, 14), range(13, 26), range(30, 45)) for a, b in combinations(block, 2) if rng.random() < 0.8} | {(20, 30), (44, 46), (46, 47)}
    ids = {x for e in edges for x in e}
    proj = spark.createDataFrame([e if rng.random() < 0.5 else e[::-1] for e in sorted(edges)], "src long, dst long")
    nodes = spark.createDataFrame([(x,) for x in ids], "id long")
    weak = C.weak_components(nodes, proj).cache()
    whole = parts(ids, edges)
    points = {x for x in ids if parts(ids - {x}, {e for e in edges if x not in e}) > whole}
    bridges = {e for e in edges if parts(ids, edges - {e}) > whole}
    assert points == {13, 20, 30, 44, 46} and bridges == {(20, 30), (44, 46), (46, 47)}
    for limit in (C.KERNEL_EDGES, 2 * len(ids)):  # all edges, and what stands for them
        found = C.cut_structure(proj, weak, max_edges=limit).collect()
        assert {r["a"] for r in found if r["kind"] == "articulation-point"} == points
        assert {(r["a"], r["b"]) for r in found if r["kind"] == "bridge"} == bridges
