"""Graph construction and the operators that need no iteration.

Every operator takes ``nodes(id)`` and ``proj(src, dst)``: distinct edges without loops.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import Scratch


def projection(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Distinct document edges without loops."""
    return edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src <> dst").distinct()


def closure(proj: DataFrame) -> DataFrame:
    """Undirected neighbours, both ways."""
    return proj.select("src", "dst").union(proj.select("dst", "src")).distinct()


def degrees(nodes: DataFrame, proj: DataFrame) -> DataFrame:
    """(id, in_degree, out_degree), 0 where there is no edge (G1): one aggregation over both edge ends."""
    ends = proj.select(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")).union(proj.select("src", F.lit(0), F.lit(1)))
    every = nodes.select("id", F.lit(0).alias("i"), F.lit(0).alias("o")).union(ends)
    return every.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


def tier(exempt: Column, in_degree: Column, out_degree: Column, threshold: int = 3) -> Column:
    """Structure ladder (G4): exempt, isolated, dead-end, under-linked, else linked."""
    return (
        F.when(exempt, "exempt").when((in_degree == 0) & (out_degree == 0), "isolated").when(out_degree == 0, "dead-end")
        .when(in_degree < threshold, "under-linked").otherwise("linked")
    )


def backlinks(proj: DataFrame) -> DataFrame:
    """(id, backlinks): sorted documents that link to each."""
    return proj.groupBy(F.col("dst").alias("id")).agg(F.sort_array(F.collect_set("src")).alias("backlinks"))


def condensation(proj: DataFrame, scc: DataFrame) -> DataFrame:
    """Edges between strong components, distinct, no loops."""
    a, b = (scc.select(F.col("id").alias(e), F.col("component").alias(f"{e}_c")) for e in ("src", "dst"))
    return proj.join(a, "src").join(b, "dst").where("src_c <> dst_c").select(F.col("src_c").alias("src"), F.col("dst_c").alias("dst")).distinct()


def top_n(scores: DataFrame, n: int, score: str = "score") -> DataFrame:
    """Largest scores, ties by id; all for n <= 0."""
    ranked = scores.orderBy(F.desc(score), "id")
    return ranked.limit(n) if n > 0 else ranked


def gaps(component: DataFrame, min_size: int = 2, cap: int = 1000) -> tuple[DataFrame, bool]:
    """Pairs of weak components of ``max(2, min_size)`` members or more, by their ids, the first ``cap``; and whether more exist.

    A pair's rank follows from its members' ranks, so only components that a kept pair can
    name take part in the join.
    """
    sizes = component.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= max(2, min_size))
    first = sizes.select("component").orderBy("component").limit(cap + 2)
    pairs = first.alias("x").join(first.alias("y"), F.expr("x.component < y.component")).select(F.col("x.component").alias("a"), F.col("y.component").alias("b"))
    found = pairs.orderBy("a", "b").limit(cap + 1)
    more = found.count() > cap
    return found.orderBy("a", "b").limit(cap), more


def link_prediction(proj: DataFrame, min_shared: int = 2, max_fanout: int = 256, cap: int = 1000) -> tuple[DataFrame, bool, int]:
    """Unlinked pairs by shared neighbours (G21, G22): a, b, shared, coupling, co_citation, adamic_adar; truncated; hubs skipped.

    Neighbours with more than ``max_fanout`` links are left out before the self-join, which
    bounds each neighbour's pairs.
    """
    near = closure(proj)
    degree = near.groupBy("src").agg(F.count(F.lit(1)).alias("d"))
    hubs = degree.where(F.col("d") > max_fanout).count()
    few = near.join(degree.where(F.col("d").between(2, max_fanout)), "src").select(F.col("src").alias("c"), F.col("dst").alias("v"), "d")
    pairs = few.alias("x").join(few.alias("y"), F.expr("x.c = y.c AND x.v < y.v")).groupBy(F.col("x.v").alias("a"), F.col("y.v").alias("b"))
    shared = pairs.agg(F.count(F.lit(1)).alias("shared"), F.sum((1 / F.log(F.col("x.d").cast("double"))).cast("decimal(30,18)")).cast("double").alias("adamic_adar")).where(F.col("shared") >= min_shared)
    shared = shared.join(near.select(F.col("src").alias("a"), F.col("dst").alias("b")), ["a", "b"], "left_anti")
    kept = shared.orderBy(F.desc("adamic_adar"), F.desc("shared"), "a", "b").limit(cap + 1)
    truncated = hubs > 0 or kept.count() > cap
    kept = kept.orderBy(F.desc("adamic_adar"), F.desc("shared"), "a", "b").limit(cap)
    return kept.join(common(kept, proj, "src", "dst", "coupling"), ["a", "b"], "left").join(common(kept, proj, "dst", "src", "co_citation"), ["a", "b"], "left").select(
        "a", "b", "shared", F.coalesce("coupling", F.lit(0)).alias("coupling"), F.coalesce("co_citation", F.lit(0)).alias("co_citation"), "adamic_adar"
    ), truncated, hubs


def common(pairs: DataFrame, proj: DataFrame, own: str, other: str, name: str) -> DataFrame:
    """(a, b, name): neighbours that a and b have in common, reached from ``own`` to ``other``."""
    one, two = (proj.select(F.col(own).alias(e), F.col(other).alias("_via")) for e in "ab")
    return pairs.select("a", "b").join(one, "a").join(two, ["b", "_via"]).groupBy("a", "b").agg(F.count(F.lit(1)).alias(name))


def clustering(proj: DataFrame) -> DataFrame:
    """One row: mean local clustering coefficient over vertices with two neighbours or more.

    A triangle is found once, from its edges ordered by (degree, id): no vertex is the
    source of many of those, so the wedge join stays small.
    """
    near = closure(proj)
    degree = near.groupBy("src").agg(F.count(F.lit(1)).alias("d"))
    a, b = (degree.select(F.col("src").alias(e), F.col("d").alias(f"d_{e}")) for e in ("src", "dst"))
    up = near.join(a, "src").join(b, "dst").where("struct(d_src, src) < struct(d_dst, dst)").select("src", "dst")
    wedge = up.alias("x").join(up.alias("y"), F.expr("x.src = y.src AND x.dst < y.dst")).select(F.col("x.src").alias("u"), F.col("x.dst").alias("v"), F.col("y.dst").alias("w"))
    closed = near.select(F.col("src").alias("v"), F.col("dst").alias("w"))
    corners = wedge.join(closed, ["v", "w"]).select(F.explode(F.array("u", "v", "w")).alias("src")).groupBy("src").agg(F.count(F.lit(1)).alias("t"))
    local = degree.where("d >= 2").join(corners, "src", "left").select((2 * F.coalesce("t", F.lit(0)) / (F.col("d") * (F.col("d") - 1))).cast("decimal(30,18)").alias("c"))
    return local.agg(F.coalesce(F.avg("c").cast("double"), F.lit(0.0)).alias("clustering"))


def document_view(nodes: DataFrame, *parts: DataFrame) -> DataFrame:
    """One row for each document, left-joined by id with the results given."""
    out = nodes
    for part in parts:
        out = out.join(part, "id", "left")
    return out


def ranked_split(scores: DataFrame, n: int = 20) -> DataFrame:
    """(id, place, primary): documents by authority, in-degree, id; the first ``n`` are primary (K4, K5)."""
    spark, order = scores.sparkSession, [F.desc("authority"), F.desc("in_degree"), F.col("id")]
    # ranges of the order, written so that they stay as they are; places are counted inside each
    ranged = scores.select("id", "authority", "in_degree").repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order)
    ranged = Scratch(spark, "ranked").write(ranged.withColumn("_range", F.spark_partition_id()), "ranges")
    before, total = [], 0
    for r in ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("k")).orderBy("_range").collect():  # a row for each range
        before.append((r["_range"], total))
        total += r["k"]
    starts = spark.createDataFrame(before, "_range int, _before long")
    place = F.col("_before") + F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    placed = ranged.join(F.broadcast(starts), "_range").select("id", place.cast("int").alias("place"))
    return placed.withColumn("primary", F.col("place") <= n)
