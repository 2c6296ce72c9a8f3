"""Breadth-first operators: hops from roots, reachability, shortest paths.

A round joins the frontier with the edges and keeps what was not seen; each round's result
is written to the shared folder.  What was seen is read from few tables (:class:`Grown`), so the
plan of a round hardly grows.  A graph that is still open after some rounds and has few enough
edges is walked to its end by one task: a round of jobs for each level of a deep one costs far more.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import Grown, Scratch

#: Rounds before one task walks the rest, and the edges that it may get.
JOINED_ROUNDS, WALK_EDGES = 12, 5_000_000


def hops(proj: DataFrame, roots: DataFrame, nodes: DataFrame | None = None, max_rounds: int | None = None) -> DataFrame:
    """(id, hops) of every vertex that some root reaches (G2).  No roots, no rows.

    One level a round; the rows of all levels so far are read by the anti-join alone.
    """
    scratch = Scratch(proj.sparkSession, "hops")
    edges = scratch.write(proj.select(F.col("src").alias("id"), "dst"), "edges")
    start = roots.select("id").distinct()
    if nodes is not None:
        start = start.join(nodes.select("id"), "id", "left_semi")
    level, seen, k = scratch.write(start.withColumn("hops", F.lit(0)), "0"), Grown(scratch, "seen"), 0
    seen.add(level)
    while max_rounds is None or k < max_rounds:
        if k == JOINED_ROUNDS and edges.count() <= WALK_EDGES:
            rest = scratch.write(_walked(edges, seen.table(), k, max_rounds), "rest")
            seen.add(rest)
            break
        k += 1
        found = edges.join(level.select("id"), "id", "left_semi").select(F.col("dst").alias("id")).distinct().join(seen.table().select("id"), "id", "left_anti")
        level = scratch.write(found.withColumn("hops", F.lit(k)), str(k))
        if level.isEmpty():
            break
        seen.add(level)
    scratch.drop("edges")
    return seen.table()


def _walked(edges: DataFrame, seen: DataFrame, last: int, max_rounds: int | None) -> DataFrame:
    """The hops of what is first reached after level ``last`` of ``seen(id, hops)``, by one task over all ``edges(id, dst)``."""
    kind = edges.schema["id"].dataType.simpleString()

    def run(batches):
        table = pa.Table.from_batches(list(batches))
        if not table.num_rows:
            return
        places = pc.unique(pa.chunked_array([*table["id"].chunks, *table["dst"].chunks], table.schema.field("id").type)).drop_null()
        known = table.filter(pc.is_valid(table["hops"]))
        links = table.filter(pc.and_(pc.is_valid(table["id"]), pc.is_valid(table["dst"])))
        s, t = (pc.index_in(links[c], value_set=places).to_numpy().astype(np.int64) for c in ("id", "dst"))
        order = np.argsort(s, kind="stable")
        first, t = np.searchsorted(s[order], np.arange(len(places) + 1)), t[order]
        dist = np.full(len(places), -1, np.int64)
        known = known.filter(pc.is_valid(known["id"]))
        dist[pc.index_in(known["id"], value_set=places).to_numpy().astype(np.int64)] = known["hops"].to_numpy()
        level, k = np.flatnonzero(dist == last), last
        while len(level) and (max_rounds is None or k < max_rounds):
            k += 1
            sizes = first[level + 1] - first[level]
            reached = t[np.arange(sizes.sum()) + np.repeat(first[level] - (np.cumsum(sizes) - sizes), sizes)]
            level = np.unique(reached[dist[reached] < 0])
            dist[level] = k
        fresh = np.flatnonzero(dist > last)
        yield pa.RecordBatch.from_arrays([places.take(pa.array(fresh)), pa.array(dist[fresh].astype(np.int32))], ["id", "hops"])

    rows = edges.select("id", "dst", F.lit(None).cast("int").alias("hops")).unionByName(seen.select("id", F.lit(None).cast(kind).alias("dst"), F.col("hops").cast("int")))
    return rows.coalesce(1).mapInArrow(run, f"id {kind}, hops int")


def reachability(nodes: DataFrame, dist: DataFrame) -> DataFrame:
    """(id, reachable) from the rows of :func:`hops`."""
    return nodes.select("id").join(dist.select("id", F.lit(True).alias("r")), "id", "left").select("id", F.coalesce("r", F.lit(False)).alias("reachable"))


def far_from_root(dist: DataFrame, exempt: DataFrame, threshold: int = 6) -> DataFrame:
    """Reached vertices at ``threshold`` hops or more that are not exempt."""
    return dist.where(F.col("hops") >= threshold).join(exempt.select("id"), "id", "left_anti")


def shortest_path(proj: DataFrame, src, dst) -> list:
    """Vertices of the shortest path; of equal ones, the one found first when neighbours are visited in order.

    Vertices of a level are found in the order of (their parent's place, their id), which is
    the order of their paths: so each takes the smallest path to it.  Empty if there is none.
    """
    spark, kind = proj.sparkSession, proj.schema["src"].dataType.simpleString()
    scratch = Scratch(spark, "path")
    edges = scratch.write(proj.select(F.col("src").alias("id"), "dst"), "edges")
    level = scratch.write(spark.range(1).select(F.lit(src).cast(kind).alias("id"), F.array(F.lit(src).cast(kind)).alias("path")), "0")
    seen, k = Grown(scratch, "seen"), 0
    seen.add(level.select("id"))
    while True:
        hit = level.where(F.col("id") == F.lit(dst)).first()
        if hit is not None:
            return list(hit["path"])
        k += 1
        found = edges.join(level, "id").groupBy("dst").agg(F.min("path").alias("path")).select(F.col("dst").alias("id"), F.concat("path", F.array("dst")).alias("path"))
        level = scratch.write(found.join(seen.table(), "id", "left_anti"), str(k))
        if level.isEmpty():
            return []
        seen.add(level.select("id"))
