"""The shared walk looks at a dense graph's edges from the end with fewer of them, and finds what plain search finds."""

import random

import numpy as np

from inkgraph.operators import paths as A

from . import brute


def side(n, edges):
    first = np.zeros(n + 1, np.int64)
    for a, _ in edges:
        first[a + 1] += 1
    return A.Side(np.cumsum(first), np.array([b for _, b in sorted(edges)], np.int32))


def graphs():
    rng = random.Random(7)
    for n in (1, 2, 5, 12, 40, 200):
        for factor in (0, 1, 3, 20, 60):
            edges = {(rng.randrange(n), rng.randrange(n)) for _ in range(n * factor)}
            yield n, {x for x in edges if x[0] != x[1]}


def test_all_pairs_distances_by_level():
    for n, edges in graphs():
        onward, backward, out = side(n, edges), side(n, {(b, a) for a, b in edges}), brute.adjacency(range(n), edges)
        for s in range(0, n, max(1, n // 5)):
            (dist, levels), wanted = A._walk(onward, backward, s), brute.bfs(out, [s])
            assert {v: int(d) for v, d in enumerate(dist) if d >= 0} == wanted
            assert [sorted(x.tolist()) for x in levels] == [sorted(v for v in wanted if wanted[v] == d) for d in range(max(wanted.values()) + 1)]


def test_a_dense_graph_is_not_walked_edge_by_edge():
    n = 400
    rng = random.Random(3)
    edges = {(a, b) for a in range(n) for b in rng.sample(range(n), 60) if a != b}
    seen = []

    class Counted(A.Side):
        def at(self, vertices):
            found = super().at(vertices)
            seen.append(len(found))
            return found

    onward, backward = (Counted(*side(n, e)) for e in (edges, {(b, a) for a, b in edges}))
    A._walk(onward, backward, 0)
    assert sum(seen) < len(edges) / 2
