"""Components: weak, strong, bow-tie, cut structure, reading orders.

Weak components come from alternating star contraction.

Each round points every vertex of a neighbourhood at the smallest vertex seen there: first
the larger neighbours (large star), then the smaller ones (small star).  Rounds take three
shuffles of the edge list, their number grows with the logarithm of the longest path, and
the edge list never grows.  The edge list of each round is written to the shared folder.
"""

from __future__ import annotations

from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import Scratch


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with v < u; every v of u, and u, pointed at u's smallest."""
    least = edges.select("u", "v", F.min("v").over(Window.partitionBy("u")).alias("m"))
    both = least.select("m", F.explode(F.array("u", "v")).alias("u"))
    return both.where("u <> m").select("u", F.col("m").alias("v")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of u pointed at the smallest of u and its neighbours; edges may repeat."""
    both = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")
    least = both.select("u", "v", F.least(F.min("v").over(Window.partitionBy("u")), F.col("u")).alias("m"))
    return least.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _are_stars(edges: DataFrame) -> bool:
    """Whether each u has one v, and no v is a u; then the v are the smallest of their components."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("ups"), F.lit(0).alias("downs")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("ups"), F.lit(1).alias("downs")))
    counted = ends.groupBy("x").agg(F.sum("ups").alias("ups"), F.max("downs").alias("downs"))
    return counted.where("ups + downs > 1").isEmpty()


def component_of(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60, within: Scratch | None = None) -> DataFrame:
    """(id, component) of every vertex that has an edge to another; component is its smallest id.

    Defined cases: null ends and self-loops are ignored, repeated edges count once, no edges
    give no rows.  It ends when every vertex but the centres points at one centre, and fails
    after ``max_rounds``.  Its tables are in a folder of their own, or ``within`` another operator's.
    """
    scratch = Scratch(edges.sparkSession, "components", within)
    clean = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where(f"{src} IS NOT NULL AND {dst} IS NOT NULL").where("u <> v").distinct()
    now = scratch.write(clean, "r0")
    for k in range(1, max_rounds + 1):
        if _are_stars(now):
            return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
        after = scratch.write(_small_star(_large_star(now)), f"r{k}")
        scratch.drop(f"r{k - 1}")
        now = after
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def weak_components(nodes: DataFrame, proj: DataFrame) -> DataFrame:
    """(id, component) of all vertices; a component's id is its smallest member."""
    found = component_of(proj)
    return nodes.select("id").distinct().join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def sizes(component: DataFrame) -> DataFrame:
    """(component, size, members): members sorted."""
    return component.groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.sort_array(F.collect_list("id")).alias("members"))


#: The largest weak component, in edges, that a kernel gets as a whole.
KERNEL_EDGES = 5_000_000


def by_component(proj: DataFrame, weak: DataFrame, max_edges: int) -> DataFrame | None:
    """Edges with their weak component; None when one of these has more than ``max_edges`` edges."""
    edges = proj.join(weak.withColumnRenamed("id", "src"), "src")
    most = edges.groupBy("component").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    return None if (most or 0) > max_edges else edges


def _strong(pdf: pd.DataFrame) -> pd.DataFrame:
    """Strong components of one weak component, by an iterative depth-first search."""
    ids = sorted(set(pdf["src"]) | set(pdf["dst"]))
    place = {x: k for k, x in enumerate(ids)}
    out: list[list[int]] = [[] for _ in ids]
    for s, t in zip(pdf["src"], pdf["dst"], strict=True):
        out[place[s]].append(place[t])
    order, low, owner = [-1] * len(ids), [0] * len(ids), [-1] * len(ids)
    waiting: list[int] = []
    clock = 0
    for root in range(len(ids)):
        if order[root] >= 0:
            continue
        order[root] = low[root] = clock
        clock += 1
        waiting.append(root)
        work = [(root, iter(out[root]))]
        while work:
            v, rest = work[-1]
            for w in rest:
                if order[w] < 0:
                    order[w] = low[w] = clock
                    clock += 1
                    waiting.append(w)
                    work.append((w, iter(out[w])))
                    break
                if owner[w] < 0:
                    low[v] = min(low[v], order[w])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == order[v]:
                    mine = [waiting.pop()]
                    while mine[-1] != v:
                        mine.append(waiting.pop())
                    least = min(mine)
                    for w in mine:
                        owner[w] = least
    return pd.DataFrame({"id": ids, "component": [ids[k] for k in owner]})


def strong_components(nodes: DataFrame, proj: DataFrame, weak: DataFrame | None = None, max_edges: int = KERNEL_EDGES) -> DataFrame:
    """(id, component) of all vertices; a component's id is its smallest member.

    Weak components of up to ``max_edges`` edges go to a kernel each; if one is larger, all
    are found by :func:`coloured` rounds of joins.
    """
    weak = weak if weak is not None else weak_components(nodes, proj)
    edges = by_component(proj, weak, max_edges)
    if edges is None:
        found = coloured(proj)
    else:
        kind = proj.schema["src"].dataType.simpleString()
        found = edges.select("component", "src", "dst").groupBy("component").applyInPandas(_strong, f"id {kind}, component {kind}")
    return nodes.select("id").distinct().join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def coloured(proj: DataFrame) -> DataFrame:
    """Strong components by colouring: every vertex takes the smallest id that reaches it, and
    those of a colour that reach its origin are one component; the rest goes on."""
    scratch = Scratch(proj.sparkSession, "coloured")
    edges = scratch.write(proj.select("src", "dst"), "edges")
    left = scratch.write(edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct(), "left")
    out, k = None, 0
    while not left.isEmpty():
        k += 1
        colour = _spread(left.select("id", F.col("id").alias("colour")), edges, scratch, f"f{k}")
        a, b = (colour.select(F.col("id").alias(e), F.col("colour").alias(f"c_{e}")) for e in ("src", "dst"))
        inner = scratch.write(edges.join(a, "src").join(b, "dst").where("c_src = c_dst").select("src", "dst"), f"e{k}")
        back = _spread(colour.where("id = colour").select("id", "colour"), inner.select(F.col("dst").alias("src"), F.col("src").alias("dst")), scratch, f"b{k}")
        out = back if out is None else out.unionByName(back)
        left = scratch.write(left.join(back.select("id"), "id", "left_anti"), f"l{k}")
        edges = scratch.write(inner.join(left.withColumnRenamed("id", "src"), "src", "left_semi").join(left.withColumnRenamed("id", "dst"), "dst", "left_semi"), f"r{k}")
    return (out if out is not None else left.select("id", F.col("id").alias("colour"))).select("id", F.col("colour").alias("component"))


def _spread(start: DataFrame, edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The smallest colour that reaches each vertex along ``edges``; only improved vertices send again."""
    now = scratch.write(start, f"{name}-0")
    fresh, k = now, 0
    while not fresh.isEmpty():
        k += 1
        sent = edges.join(fresh.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("colour").alias("sent"))
        both = now.join(sent, "id", "full").select("id", F.least("colour", "sent").alias("colour"), (F.col("colour").isNull() | (F.col("sent") < F.col("colour"))).alias("better"))
        both = scratch.write(both, f"{name}-{k}")
        now, fresh = both.select("id", "colour"), both.where("better").select("id", "colour")
    return now


def bowtie(nodes: DataFrame, proj: DataFrame, weak: DataFrame, strong: DataFrame) -> DataFrame:
    """(id, bucket) around the largest strong component, ties by smallest id."""
    from .reach import hops

    giant = strong.groupBy("component").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "component").limit(1)
    core = strong.join(F.broadcast(giant.select("component")), "component").select("id")
    down = hops(proj, core).select("id", F.lit(True).alias("down"))
    up = hops(proj.select(F.col("dst").alias("src"), F.col("src").alias("dst")), core).select("id", F.lit(True).alias("up"))
    near = weak.join(F.broadcast(weak.join(core, "id").select("component").distinct()), "component").select("id", F.lit(True).alias("near"))
    bucket = F.when(F.col("up") & F.col("down"), "core").when(F.col("up"), "in").when(F.col("down"), "out").when(F.col("near"), "tendril").otherwise("disconnected")
    joined = nodes.select("id").distinct().join(down, "id", "left").join(up, "id", "left").join(near, "id", "left")
    return joined.select("id", bucket.alias("bucket"))


def _cuts(pdf: pd.DataFrame) -> pd.DataFrame:
    """Cut vertices and cut edges of one component, by an iterative low-link search."""
    ids = sorted(set(pdf["src"]) | set(pdf["dst"]))
    place = {x: k for k, x in enumerate(ids)}
    near: list[list[int]] = [[] for _ in ids]
    for s, t in zip(pdf["src"], pdf["dst"], strict=True):
        near[place[s]].append(place[t])
    order, low = [-1] * len(ids), [0] * len(ids)
    order[0], clock, children = 0, 1, 0
    points, edges = set(), []
    work = [(0, -1, iter(near[0]))]
    while work:
        v, parent, rest = work[-1]
        for w in rest:
            if order[w] < 0:
                order[w] = low[w] = clock
                clock += 1
                children += v == 0
                work.append((w, v, iter(near[w])))
                break
            if w != parent:
                low[v] = min(low[v], order[w])
        else:
            work.pop()
            if parent >= 0:
                low[parent] = min(low[parent], low[v])
                if parent and low[v] >= order[parent]:
                    points.add(parent)
                if low[v] > order[parent]:
                    edges.append((min(v, parent), max(v, parent)))
    if children > 1:
        points.add(0)
    rows = [("articulation-point", ids[p], ids[p]) for p in sorted(points)] + [("bridge", ids[a], ids[b]) for a, b in sorted(edges)]
    return pd.DataFrame(rows, columns=["kind", "a", "b"])


def _forest(u: np.ndarray, v: np.ndarray, n: int, breadth_first: bool) -> np.ndarray:
    """The places of a spanning forest's edges among the edges (u, v); any one, or a breadth-first one."""
    if not breadth_first:
        root, kept = list(range(n)), []
        for k, (a, b) in enumerate(zip(u.tolist(), v.tolist(), strict=True)):
            while root[a] != a:
                root[a] = root[root[a]]
                a = root[a]
            while root[b] != b:
                root[b] = root[root[b]]
                b = root[b]
            if a != b:
                root[a] = b
                kept.append(k)
        return np.array(kept, np.int64)
    ends, place = np.concatenate([u, v]), np.tile(np.arange(len(u)), 2)
    order = np.argsort(ends, kind="stable")
    other, place = np.concatenate([v, u])[order], place[order]
    first = np.searchsorted(ends[order], np.arange(n + 1)).tolist()
    seen, kept = np.zeros(n, bool), []
    for start in range(n):
        if seen[start]:
            continue
        seen[start] = True
        queue = [start]
        for x in queue:
            near = other[first[x]:first[x + 1]]
            if len(near) and not seen[near].all():
                fresh, at = np.unique(near, return_index=True)
                at = at[~seen[fresh]]
                seen[near] = True
                kept.append(place[first[x]:first[x + 1]][at])
                queue += near[at].tolist()
    return np.concatenate(kept) if kept else np.zeros(0, np.int64)


def certificate(batches):
    """Of the edges (component, src, dst) of a task, for each component few that keep its cut vertices and cut edges.

    A breadth-first forest and a spanning forest of the rest: whatever edges join them, the same
    vertices and edges cut the graph as with all edges (Cheriyan, Kao and Thurimella; Eppstein et al.).
    """
    table = pa.Table.from_batches(list(batches))
    ids = pc.unique(pa.chunked_array([*table["src"].chunks, *table["dst"].chunks], table.schema.field("src").type))
    u, v = (pc.index_in(table[c], value_set=ids).to_numpy().astype(np.int64) for c in ("src", "dst"))
    tree = _forest(u, v, len(ids), True)
    rest = np.setdiff1d(np.arange(len(u)), tree)
    keep = np.concatenate([tree, rest[_forest(u[rest], v[rest], len(ids), False)]])
    yield from table.take(pa.array(np.sort(keep))).to_batches()


def _thinned(edges: DataFrame, most: int, max_edges: int) -> DataFrame:
    """Edges of which each component has ``max_edges`` at most: certificates of parts, of these together, and so on.

    A component's edges are dealt over tasks; as long as fewer tasks can hold what is left, they do.
    """
    scratch, k = Scratch(edges.sparkSession, "certificates"), 0
    parts = max(2, -(-most // max(max_edges, 1)), int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    now = edges
    while True:
        k += 1
        dealt = now.repartition(parts, F.pmod(F.xxhash64("src", "dst"), F.lit(parts)), F.col("component")) if parts > 1 else now.repartition(1)
        now = scratch.write(dealt.mapInArrow(_filled, edges.schema), f"c{k}")
        left = now.groupBy("component").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        if left <= max_edges:
            return now
        fewer = min(parts - 1, -(-left // max(max_edges, 1)))
        if fewer < 1 or parts == 1:
            raise ValueError(f"a component has {left} edges that none can stand for, more than {max_edges}: raise max_edges if a task can hold it")
        parts = fewer


def _filled(batches):
    found = [x for x in batches if x.num_rows]
    if found:
        yield from certificate(found)


def cut_structure(proj: DataFrame, weak: DataFrame, max_edges: int = KERNEL_EDGES) -> DataFrame:
    """(kind, a, b): cut vertices (a = b) and bridges (a < b) of the undirected graph.

    One component is one kernel's work.  Of a component of more than ``max_edges`` edges the kernel gets
    a certificate, of less than two edges for each vertex, which tasks make from parts of it; only a component of
    so many vertices that this is too large is an error.
    """
    once = proj.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    counted = by_component(once, weak, max_edges)
    if counted is None:
        edges = once.join(weak.withColumnRenamed("id", "src"), "src").select("component", "src", "dst")
        most = edges.groupBy("component").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
        counted = _thinned(edges, most, max_edges)
    edges = counted.select("component", "src", "dst").unionByName(counted.select("component", F.col("dst").alias("src"), F.col("src").alias("dst")))
    kind = proj.schema["src"].dataType.simpleString()
    return edges.groupBy("component").applyInPandas(_cuts, f"kind string, a {kind}, b {kind}")


def trails(nodes: DataFrame, proj: DataFrame, weak: DataFrame, strong: DataFrame, score: DataFrame, max_edges: int = KERNEL_EDGES) -> DataFrame:
    """(root, order): a reading order of each weak component.

    Strong components in topological order, of those free the one with the best member first
    (ties by id), members by score; the root is the member of the best score.
    """
    edges = by_component(proj, weak, max_edges)
    if edges is None:
        raise ValueError(f"a component has more than {max_edges} edges: raise max_edges if a task can hold it")
    vertex = weak.withColumnRenamed("component", "weak").join(strong.withColumnRenamed("component", "strong"), "id").join(score, "id")
    kind = nodes.schema["id"].dataType.simpleString()
    rows = vertex.select("weak", "id", "strong", "score", F.lit(None).cast(kind).alias("dst")).unionByName(
        edges.select(F.col("component").alias("weak"), F.col("src").alias("id"), F.lit(None).cast(kind).alias("strong"), F.lit(None).cast("double").alias("score"), "dst"))
    return rows.groupBy("weak").applyInPandas(_trail, f"root {kind}, order array<{kind}>")


def _trail(pdf: pd.DataFrame) -> pd.DataFrame:
    vertex, edges = pdf[pdf["strong"].notna()], pdf[pdf["strong"].isna()]
    score = dict(zip(vertex["id"].tolist(), vertex["score"].tolist(), strict=True))
    home = dict(zip(vertex["id"].tolist(), vertex["strong"].tolist(), strict=True))
    members: dict = {}
    for v in sorted(home, key=lambda x: (-score[x], x)):
        members.setdefault(home[v], []).append(v)
    below: dict = {c: set() for c in members}
    for s, t in zip(edges["id"].tolist(), edges["dst"].tolist(), strict=True):
        t = type(s)(t)
        if home[s] != home[t]:
            below[home[s]].add(home[t])
    above = dict.fromkeys(members, 0)
    for targets in below.values():
        for c in targets:
            above[c] += 1
    free = [(-score[members[c][0]], c) for c, n in above.items() if n == 0]
    heapify(free)
    order: list = []
    while free:
        _, c = heappop(free)
        order += members[c]
        for d in below[c]:
            above[d] -= 1
            if above[d] == 0:
                heappush(free, (-score[members[d][0]], d))
    return pd.DataFrame({"root": [min(home, key=lambda x: (-score[x], x))], "order": [order]})
