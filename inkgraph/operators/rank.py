"""PageRank and HITS by rounds of join and aggregation.

Sums are taken over fixed-point decimals: they are exact, so a result does not depend on how
rows are dealt out, and partial sums still combine before the shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import Scratch


def exact_sum(x: Column) -> Column:
    return F.coalesce(F.sum(x.cast("decimal(38,18)")).cast("double"), F.lit(0.0))


def _length(rows: DataFrame, name: str, scale: float = 1.0) -> float:
    """The Euclidean length of a column, 1 for a zero vector; squares are of shares of ``scale``."""
    share = F.col(name) / scale
    return math.sqrt(rows.agg(exact_sum(share * share)).first()[0]) * scale or 1.0


def pagerank(nodes: DataFrame, proj: DataFrame, damping: float = 0.85, tolerance: float | None = 1e-6, max_rounds: int = 100) -> DataFrame:
    """(id, score) (G11): dangling mass goes to all; it stops when the summed change is below N times the tolerance."""
    spark, scratch = nodes.sparkSession, Scratch(nodes.sparkSession, "pagerank")
    out = proj.groupBy("src").agg(F.count(F.lit(1)).alias("d"))
    base = scratch.write(nodes.select("id").distinct().join(out.withColumnRenamed("src", "id"), "id", "left"), "base")
    edges = scratch.write(proj.select("src", "dst"), "edges")
    n = base.count()
    if n <= 1:
        return base.select("id", F.lit(1.0).alias("score"))
    now, dangling = base.withColumn("score", F.lit(1.0 / n)), base.where("d IS NULL").count() / n
    for k in range(1, max_rounds + 1):
        sent = edges.join(now.where("d IS NOT NULL").select(F.col("id").alias("src"), (F.col("score") / F.col("d")).alias("x")), "src").groupBy(F.col("dst").alias("id")).agg(exact_sum(F.col("x")).alias("got"))
        step = now.join(sent, "id", "left").select("id", "d", F.col("score").alias("was"), ((1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + F.lit(dangling / n))).alias("score"))
        after = scratch.write(step, str(k))
        change, dangling = after.agg(exact_sum(F.abs(F.col("score") - F.col("was"))), exact_sum(F.when(F.col("d").isNull(), F.col("score")))).first()
        now = after.select("id", "d", "score")
        if k > 1:
            scratch.drop(str(k - 1))
        if tolerance is not None and change < n * tolerance:
            break
    return spark.read.schema(after.schema).parquet(f"{scratch.path}/{k}").select("id", "score")


def hits(nodes: DataFrame, proj: DataFrame, tolerance: float | None = 1e-8, max_rounds: int = 100) -> DataFrame:
    """(id, hub, authority) (G10): hubs from the new authorities, both of unit length; zero vectors stay."""
    scratch = Scratch(nodes.sparkSession, "hits")
    edges = scratch.write(proj.select("src", "dst"), "edges")
    now = scratch.write(nodes.select("id").distinct().select("id", F.lit(1.0).alias("hub"), F.lit(1.0).alias("authority")), "0")
    for k in range(1, max_rounds + 1):
        auth = edges.join(now.select(F.col("id").alias("src"), "hub"), "src").groupBy(F.col("dst").alias("id")).agg(exact_sum(F.col("hub")).alias("a"))
        auth = scratch.write(auth, f"a{k}")
        # hubs of length 1 bound later sums; the first are counts of links, of any size
        size = _length(auth, "a", (auth.agg(F.max("a")).first()[0] or 1.0) if k == 1 else 1.0)
        auth = auth.select("id", (F.col("a") / size).alias("a"))
        hub = edges.join(auth.select(F.col("id").alias("dst"), "a"), "dst").groupBy(F.col("src").alias("id")).agg(exact_sum(F.col("a")).alias("h"))
        raw = scratch.write(now.join(auth, "id", "left").join(hub, "id", "left").select("id", F.col("hub").alias("hub0"), F.col("authority").alias("authority0"), F.coalesce("a", F.lit(0.0)).alias("authority"), F.coalesce("h", F.lit(0.0)).alias("h")), f"h{k}")
        long_ = _length(raw, "h")
        step = raw.select("id", "hub0", "authority0", "authority", (F.col("h") / long_).alias("hub"))
        d_auth, d_hub = step.agg(exact_sum(F.pow(F.col("authority") - F.col("authority0"), 2.0)), exact_sum(F.pow(F.col("hub") - F.col("hub0"), 2.0))).first()
        scratch.drop(f"a{k}")
        if k > 1:
            scratch.drop(f"h{k - 1}")
        now = step.select("id", "hub", "authority")
        if tolerance is not None and math.sqrt(d_auth) + math.sqrt(d_hub) < tolerance:
            break
    return now
