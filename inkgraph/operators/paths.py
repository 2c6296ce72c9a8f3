"""All-pairs operators: distances, betweenness, navigability.

Sources are dealt out over tasks, each walks its sources breadth-first over an adjacency
that all tasks share.  A level is found from whichever end has fewer edges to look at: from
its vertices onward, or from the vertices not reached yet backward; so a dense graph costs a
source little more than its vertices, not all edges.  The adjacency is sent to every executor
only while it is small: up to ``SHARED_EDGES`` entries, counted first.  Beyond, distances come
level by level from joins.  Nothing holds all pairs at once: tasks hand on what they have summed.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import Grown, Scratch
from .graph import closure

#: Entries of the shared adjacency, of 4 bytes: an edge has one onward and one backward, or one for each way if all edges go both ways.
SHARED_EDGES = 60_000_000
#: How many edges back from a vertex are looked at one by one before all the rest.
FIRST_LOOKS = 8


class Side(NamedTuple):
    """The edges at one of their ends: those of vertex ``v`` lead to ``ends[first[v]:first[v + 1]]``."""

    first: np.ndarray
    ends: np.ndarray

    def at(self, vertices: np.ndarray) -> np.ndarray:
        """The other ends of all edges of ``vertices``, vertex by vertex."""
        low, high = self.first[vertices], self.first[vertices + 1]
        sizes = high - low
        total = int(sizes.sum())
        if total > 32 * len(vertices):
            return np.concatenate([self.ends[a:b] for a, b in zip(low.tolist(), high.tolist(), strict=True)])
        return self.ends[np.arange(total) + np.repeat(low - (np.cumsum(sizes) - sizes), sizes)]

    def sizes(self, vertices: np.ndarray) -> np.ndarray:
        return self.first[vertices + 1] - self.first[vertices]


def _shared(nodes: DataFrame, proj: DataFrame, both_ways: bool = False):
    """Broadcast (sorted ids, onward, backward): the edges by place in the ids; None if there are too many."""
    if (1 if both_ways else 2) * proj.count() > SHARED_EDGES or nodes.count() > SHARED_EDGES:
        return None
    spark = nodes.sparkSession
    every = nodes.select("id").union(proj.select("src")).union(proj.select("dst")).where("id IS NOT NULL").distinct()
    ids = every.toArrow().column(0).combine_chunks()
    ids = ids.take(pc.sort_indices(ids))
    known = spark.sparkContext.broadcast(ids)
    onward = _side(proj, "src", "dst", known, len(ids))
    backward = onward if both_ways else _side(proj, "dst", "src", known, len(ids))
    known.destroy()
    return spark.sparkContext.broadcast((ids, onward, backward))


def _side(proj: DataFrame, own: str, other: str, known, n: int) -> Side:
    """The edges by their ``own`` end; tasks number and sort them, the driver only puts the parts in place."""

    def run(batches):
        pairs = [tuple(pc.index_in(batch.column(k), value_set=known.value).to_numpy(zero_copy_only=False).astype(np.int32) for k in (0, 1)) for batch in batches]
        if pairs:
            s, t = (np.concatenate(x) for x in zip(*pairs, strict=True))
            order = np.lexsort((t, s))
            vertices, counts = np.unique(s, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([x.astype(np.int32).tobytes()], pa.binary()) for x in (vertices, counts, t[order])], ["v", "n", "t"])

    parts = int(proj.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = proj.select(own, other).where(f"{own} IS NOT NULL AND {other} IS NOT NULL").repartition(parts, own).mapInArrow(run, "v binary, n binary, t binary").toArrow()
    found = [[np.frombuffer(x.as_py(), np.int32) for x in row] for row in zip(*rows.columns, strict=True)]
    sizes = np.zeros(n, np.int64)
    for v, k, _ in found:
        sizes[v] = k
    first = np.concatenate([[0], np.cumsum(sizes)])
    ends = np.empty(first[-1], np.int32)
    for v, k, t in found:
        k = k.astype(np.int64)
        ends[np.arange(len(t)) + np.repeat(first[v] - (np.cumsum(k) - k), k)] = t
    return Side(first, ends)


def _walk(onward: Side, backward: Side, source: int):
    """Distances from a source (-1: not reached) and the vertices of each level."""
    n = len(onward.first) - 1
    dist = np.full(n, -1, np.int32)
    dist[source] = 0
    levels, left = [np.array([source])], len(backward.ends) - int(backward.sizes(np.array([source]))[0])
    while left > 0 and len(levels[-1]):
        k = len(levels)
        ahead = int(onward.sizes(levels[-1]).sum())
        if ahead > left + n:
            fresh = _backward(backward, dist, k - 1)
        else:
            reached = onward.at(levels[-1])
            reached = reached[dist[reached] < 0]
            dist[reached] = k
            fresh = np.flatnonzero(dist == k) if 8 * len(reached) > n else np.unique(reached)
        dist[fresh] = k
        left -= int(backward.sizes(fresh).sum())
        levels.append(fresh)
    return dist, levels if len(levels[-1]) else levels[:-1]


def _backward(backward: Side, dist: np.ndarray, level: int) -> np.ndarray:
    """The vertices not reached yet that an edge from ``level`` leads to."""
    open_ = np.flatnonzero(dist < 0)
    open_ = open_[backward.sizes(open_) > 0]
    found = []
    for k in range(FIRST_LOOKS):
        open_ = open_[backward.sizes(open_) > k]
        hit = dist[backward.ends[backward.first[open_] + k]] == level
        found.append(open_[hit])
        open_ = open_[~hit]
    open_ = open_[backward.sizes(open_) > FIRST_LOOKS]
    if len(open_):
        sizes = backward.sizes(open_)
        hit = np.logical_or.reduceat(dist[backward.at(open_)] == level, np.cumsum(sizes) - sizes)
        found.append(open_[hit])
    return np.sort(np.concatenate(found))


def distances(nodes: DataFrame, proj: DataFrame) -> DataFrame:
    """(src, dst, hops) of every pair with a path, each vertex to itself included."""
    shared = _shared(nodes, proj)
    if shared is None:
        return _levels(nodes, proj)

    def run(batches):
        ids, onward, backward = shared.value
        for batch in batches:
            for s in pc.index_in(batch.column(0), value_set=ids).to_pylist():
                dist, _ = _walk(onward, backward, s)
                t = np.flatnonzero(dist >= 0)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.full(len(t), s))), ids.take(pa.array(t)), pa.array(dist[t].astype(np.int64))], ["src", "dst", "hops"])

    kind = nodes.schema["id"].dataType.simpleString()
    return _sources(nodes).mapInArrow(run, f"src {kind}, dst {kind}, hops long")


def _sources(nodes: DataFrame) -> DataFrame:
    return nodes.select("id").where("id IS NOT NULL").distinct().repartition(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id")


def _levels(nodes: DataFrame, proj: DataFrame) -> DataFrame:
    """The same from joins, one level a round."""
    scratch = Scratch(nodes.sparkSession, "levels")
    step = proj.select(F.col("src").alias("via"), "dst")
    level = scratch.write(nodes.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0).cast("long").alias("hops")).distinct(), "0")
    seen, k = Grown(scratch, "seen"), 0
    seen.add(level)
    while not level.isEmpty():
        k += 1
        found = level.select("src", F.col("dst").alias("via")).join(step, "via").select("src", "dst").distinct()
        level = scratch.write(found.join(seen.table(), ["src", "dst"], "left_anti").withColumn("hops", F.lit(k).cast("long")), str(k))
        seen.add(level)
    return seen.table()


def betweenness(nodes: DataFrame, proj: DataFrame) -> DataFrame:
    """(id, betweenness), directed, divided by (n - 1)(n - 2); 0 below three vertices."""
    n = nodes.select("id").distinct().count()
    if n < 3:
        return nodes.select("id").distinct().select("id", F.lit(0.0).alias("betweenness"))
    shared = _shared(nodes, proj)
    kind = nodes.schema["id"].dataType.simpleString()
    found = _dependencies(nodes, proj) if shared is None else _sources(nodes).mapInArrow(_brandes(shared), f"id {kind}, x double")
    total = found.groupBy("id").agg(F.sum(F.col("x").cast("decimal(38,18)")).cast("double").alias("x"))
    return nodes.select("id").distinct().join(total, "id", "left").select("id", (F.coalesce("x", F.lit(0.0)) / ((n - 1) * (n - 2))).alias("betweenness"))


def _brandes(shared):
    """Dependencies of each vertex, summed over a task's sources."""

    def run(batches):
        ids, onward, backward = shared.value
        n = len(ids)
        total = np.zeros(n)
        for batch in batches:
            for s in pc.index_in(batch.column(0), value_set=ids).to_pylist():
                dist, levels = _walk(onward, backward, s)
                paths, share = np.zeros(n), np.zeros(n)
                paths[s] = 1
                steps = []
                for k in range(1, len(levels)):
                    steps.append(_step(onward, backward, dist, levels, k))
                    v, w = steps[-1]
                    _add(paths, w, paths[v])
                for v, w in reversed(steps[1:]):
                    _add(share, v, paths[v] / paths[w] * (1 + share[w]))
                total += share
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(k)), pa.array(total[k])], ["id", "x"])

    return run


def _add(out: np.ndarray, at: np.ndarray, x: np.ndarray) -> None:
    """Add each ``x`` at its place, in the way that is faster for so many."""
    if 8 * len(at) > len(out):
        out += np.bincount(at, x, len(out))
    else:
        np.add.at(out, at, x)


def _step(onward: Side, backward: Side, dist: np.ndarray, levels: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The edges (v, w) from level ``k - 1`` to level ``k``, looked for from the end with fewer edges."""
    ahead, back = onward.sizes(levels[k - 1]), backward.sizes(levels[k])
    if ahead.sum() <= back.sum():
        w = onward.at(levels[k - 1])
        keep = dist[w] == k
        return np.repeat(levels[k - 1], ahead)[keep], w[keep]
    v = backward.at(levels[k])
    keep = dist[v] == k - 1
    return v[keep], np.repeat(levels[k], back)[keep]


def _dependencies(nodes: DataFrame, proj: DataFrame) -> DataFrame:
    """The same from joins, one level a round: path counts down, dependencies back up."""
    scratch = Scratch(nodes.sparkSession, "dependencies")
    hop = proj.select(F.col("src").alias("via"), "dst")
    level = scratch.write(nodes.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("paths")).distinct(), "0")
    seen, levels = Grown(scratch, "seen"), [level]
    seen.add(level.select("src", "dst"))
    while True:
        step = level.select("src", F.col("dst").alias("via"), "paths").join(hop, "via").groupBy("src", "dst").agg(F.sum("paths").alias("paths")).join(seen.table(), ["src", "dst"], "left_anti")
        level = scratch.write(step, str(len(levels)))
        if level.isEmpty():
            break
        seen.add(level.select("src", "dst"))
        levels.append(level)
    below = levels[-1].withColumn("share", F.lit(0.0))
    out = Grown(scratch, "out")
    out.add(nodes.select("id", F.lit(0.0).alias("x")).limit(0))
    for k in range(len(levels) - 2, 0, -1):
        up = below.select("src", "dst", ((1 + F.col("share")) / F.col("paths")).alias("y")).join(hop, "dst").groupBy("src", F.col("via").alias("dst")).agg(F.sum("y").alias("y"))
        below = scratch.write(levels[k].join(up, ["src", "dst"], "left").select("src", "dst", "paths", (F.col("paths") * F.coalesce("y", F.lit(0.0))).alias("share")), f"up{k}")
        out.add(below.select(F.col("dst").alias("id"), F.col("share").alias("x")))
    return out.table()


def compactness(nodes: DataFrame, proj: DataFrame) -> DataFrame:
    """One row: compactness and stratum of the directed graph (G15).  A pair without a path costs N."""
    n = nodes.select("id").distinct().count()
    if n <= 1:
        return nodes.sparkSession.createDataFrame([(0.0, 0.0)], "compactness double, stratum double")
    shared = _shared(nodes, proj)
    if shared is None:
        far = _levels(nodes, proj).where("src <> dst")
        ends = far.select(F.col("src").alias("id"), F.col("hops").alias("o"), F.lit(0).alias("i"), F.lit(1).alias("pairs")).union(far.select("dst", F.lit(0), "hops", F.lit(0)))
    else:
        ends = _sources(nodes).mapInArrow(_sums(shared), f"id {nodes.schema['id'].dataType.simpleString()}, o long, i long, pairs long")
    status = ends.groupBy("id").agg(F.sum("o").alias("o"), F.sum("i").alias("i"), F.sum("pairs").alias("pairs"))
    sums = status.agg(F.coalesce(F.sum("o"), F.lit(0)).alias("cost"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"), F.coalesce(F.sum(F.abs(F.col("i") - F.col("o"))), F.lit(0)).alias("ap"))
    every = n * n - n
    cost = F.col("cost") + (every - F.col("pairs")) * n
    linear = n * n / 2 if n % 2 == 0 else (n * n - 1) / 2
    return sums.select(((every * n - cost) / (every * (n - 1))).cast("double").alias("compactness"), F.least(F.col("ap") / linear, F.lit(1.0)).alias("stratum"))


def _sums(shared):
    """For each of a task's sources the sum and count of its distances, for each vertex the sum of those to it."""

    def run(batches):
        ids, onward, backward = shared.value
        into = np.zeros(len(ids), np.int64)
        for batch in batches:
            own = []
            for s in pc.index_in(batch.column(0), value_set=ids).to_pylist():
                dist, _ = _walk(onward, backward, s)
                np.maximum(dist, 0, out=dist)
                into += dist
                own.append((s, int(dist.sum(dtype=np.int64)), int(np.count_nonzero(dist))))
            at, o, pairs = (np.array(x, np.int64) for x in zip(*own, strict=True)) if own else (np.zeros(0, np.int64),) * 3
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), pa.array(o), pa.array(np.zeros_like(o)), pa.array(pairs)], ["id", "o", "i", "pairs"])
        k = np.flatnonzero(into)
        none = np.zeros(len(k), np.int64)
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(k)), pa.array(none), pa.array(into[k]), pa.array(none)], ["id", "o", "i", "pairs"])

    return run


def _histogram(shared):
    """How many distances of each length a task's sources have."""

    def run(batches):
        ids, onward, backward = shared.value
        counts = np.zeros(0, np.int64)
        for batch in batches:
            for s in pc.index_in(batch.column(0), value_set=ids).to_pylist():
                sizes = np.array([len(x) for x in _walk(onward, backward, s)[1]], np.int64)
                counts = np.pad(counts, (0, max(0, len(sizes) - len(counts))))
                counts[: len(sizes)] += sizes
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(1, len(counts))), pa.array(counts[1:])], ["hops", "n"])

    return run


def path_lengths(nodes: DataFrame, proj: DataFrame) -> DataFrame:
    """One row: mean, median, diameter and count of the undirected finite distances between different vertices."""
    near = Scratch(nodes.sparkSession, "closure").write(closure(proj), "near")
    shared = _shared(nodes, near, both_ways=True)
    if shared is None:
        counts = _levels(nodes, near).where("src <> dst").groupBy("hops").agg(F.count(F.lit(1)).alias("n"))
    else:
        counts = _sources(nodes).mapInArrow(_histogram(shared), "hops long, n long").groupBy("hops").agg(F.sum("n").alias("n"))
    rows = sorted((r["hops"], r["n"]) for r in counts.collect())  # one row for each distance
    total = sum(n for _, n in rows)

    def at(place: int) -> int:
        for d, n in rows:
            place -= n
            if place < 0:
                return d
        return 0

    median = (at((total - 1) // 2) + at(total // 2)) / 2 if total else 0.0
    mean = sum(d * n for d, n in rows) / total if total else 0.0
    return nodes.sparkSession.createDataFrame([(mean, median, max((d for d, _ in rows), default=0), total)], "characteristic_path_length double, median_path_length double, diameter long, reachable_pairs long")
