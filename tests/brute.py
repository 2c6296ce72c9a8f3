"""Plain-Python twins of the graph operators, for small graphs."""

from collections import deque
from itertools import combinations
from math import log, sqrt


def adjacency(nodes, edges):
    out = {v: [] for v in nodes}
    for a, b in sorted(set(edges)):
        if a != b:
            out[a].append(b)
    return out


def undirected(nodes, edges):
    return adjacency(nodes, [*edges, *((b, a) for a, b in edges)])


def bfs(out, sources):
    dist = dict.fromkeys(sources, 0)
    queue = deque(sorted(sources))
    while queue:
        v = queue.popleft()
        for w in out[v]:
            if w not in dist:
                dist[w] = dist[v] + 1
                queue.append(w)
    return dist


def weak(nodes, edges):
    near = undirected(nodes, edges)
    return {v: min(bfs(near, [v])) for v in nodes}


def strong(nodes, edges):
    out = adjacency(nodes, edges)
    reach = {v: set(bfs(out, [v])) for v in nodes}
    return {v: min(w for w in reach[v] if v in reach[w]) for v in nodes}


def pagerank(nodes, edges, damping=0.85, tolerance=1e-6, rounds=100):
    out, n = adjacency(nodes, edges), len(nodes)
    if n <= 1:
        return dict.fromkeys(nodes, 1.0)
    score = dict.fromkeys(nodes, 1 / n)
    for _ in range(rounds):
        loose = sum(score[v] for v in nodes if not out[v])
        new = dict.fromkeys(nodes, (1 - damping) / n + damping * loose / n)
        for v in nodes:
            for w in out[v]:
                new[w] += damping * score[v] / len(out[v])
        change, score = sum(abs(new[v] - score[v]) for v in nodes), new
        if change < n * tolerance:
            break
    return score


def hits(nodes, edges, tolerance=1e-8, rounds=100):
    out = adjacency(nodes, edges)
    hub, auth = dict.fromkeys(nodes, 1.0), dict.fromkeys(nodes, 1.0)
    unit = lambda m: {k: x / s for k, x in m.items()} if (s := sqrt(sum(x * x for x in m.values()))) else m
    for _ in range(rounds):
        a = dict.fromkeys(nodes, 0.0)
        for v in nodes:
            for w in out[v]:
                a[w] += hub[v]
        a = unit(a)
        h = unit({v: sum(a[w] for w in out[v]) for v in nodes})
        moved = sqrt(sum((a[v] - auth[v]) ** 2 for v in nodes)) + sqrt(sum((h[v] - hub[v]) ** 2 for v in nodes))
        hub, auth = h, a
        if moved < tolerance:
            break
    return hub, auth


def betweenness(nodes, edges):
    out, n = adjacency(nodes, edges), len(nodes)
    score = dict.fromkeys(nodes, 0.0)
    dist = {v: bfs(out, [v]) for v in nodes}
    paths = {}
    for s in nodes:
        count = {s: 1}
        for v in sorted(dist[s], key=dist[s].get):
            for w in out[v]:
                if dist[s][w] == dist[s][v] + 1:
                    count[w] = count.get(w, 0) + count[v]
        paths[s] = count
    for s in nodes:
        for t in dist[s]:
            for v in dist[s]:
                if s != t and v not in (s, t) and t in dist[v] and dist[s][v] + dist[v][t] == dist[s][t]:
                    score[v] += paths[s][v] * paths[v][t] / paths[s][t]
    return {v: score[v] / ((n - 1) * (n - 2)) if n > 2 else 0.0 for v in nodes}


def cuts(nodes, edges):
    def parts(vs, es):
        return len(set(weak(vs, es).values()))

    pairs = {(min(e), max(e)) for e in edges if e[0] != e[1]}
    whole = parts(nodes, pairs)
    points = {v for v in nodes if parts([x for x in nodes if x != v], [e for e in pairs if v not in e]) > whole - (not any(v in e for e in pairs))}
    return points, {e for e in pairs if parts(nodes, pairs - {e}) > whole}


def navigability(nodes, edges):
    out, near, n = adjacency(nodes, edges), undirected(nodes, edges), len(nodes)
    dist = {v: bfs(out, [v]) for v in nodes}
    cost = sum(dist[a].get(b, n) for a in nodes for b in nodes if a != b)
    ap = sum(abs(sum(dist[a].get(v, 0) for a in nodes) - sum(dist[v].values())) for v in nodes)
    lap = n * n / 2 if n % 2 == 0 else (n * n - 1) / 2
    far = sorted(d for v in nodes for w, d in bfs(near, [v]).items() if w != v)
    local = [2 * sum(b in near[a] for a, b in combinations(near[v], 2)) / (len(near[v]) * (len(near[v]) - 1)) for v in nodes if len(near[v]) > 1]
    k = len(far)
    return {
        "compactness": ((n * n - n) * n - cost) / ((n * n - n) * (n - 1)) if n > 1 else 0.0, "stratum": min(ap / lap, 1) if n > 1 else 0.0,
        "characteristic_path_length": sum(far) / k if k else 0.0, "median_path_length": (far[(k - 1) // 2] + far[k // 2]) / 2 if k else 0.0,
        "diameter": max(far, default=0), "reachable_pairs": k, "clustering": sum(local) / len(local) if local else 0.0,
    }


def suggestions(nodes, edges, min_shared=2, fanout=256):
    near, out = undirected(nodes, edges), adjacency(nodes, edges)
    into = adjacency(nodes, [(b, a) for a, b in edges])
    rows = []
    for a, b in combinations(sorted(nodes), 2):
        shared = [c for c in near[a] if c in near[b] and 2 <= len(near[c]) <= fanout]
        if len(shared) >= min_shared and b not in near[a]:
            rows.append((a, b, len(shared), len(set(out[a]) & set(out[b])), len(set(into[a]) & set(into[b])), sum(1 / log(len(near[c])) for c in shared)))
    return sorted(rows, key=lambda r: (-r[5], -r[2], r[0], r[1]))


def bowtie(nodes, edges):
    scc, wcc, out = strong(nodes, edges), weak(nodes, edges), adjacency(nodes, edges)
    size = {}
    for c in scc.values():
        size[c] = size.get(c, 0) + 1
    giant = min(size, key=lambda c: (-size[c], c))
    down = bfs(out, [v for v in nodes if scc[v] == giant])
    up = bfs(adjacency(nodes, [(b, a) for a, b in edges]), [v for v in nodes if scc[v] == giant])
    return {v: "core" if scc[v] == giant else "in" if v in up else "out" if v in down else "tendril" if wcc[v] == wcc[giant] else "disconnected" for v in nodes}
