"""How much an anchor says about its target."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def scored(links: DataFrame, candidates: DataFrame, key: list[str]) -> DataFrame:
    """Links with ``score`` and ``suggestion``: the best candidate by token similarity, the first on ties.

    ``links``: key columns, anchor, target; ``candidates``: key columns, ord, text.  An anchor
    without tokens, or a phrase that says nothing, scores 0.
    """
    anchor = T.effective_anchor(F.col("anchor"), F.col("target"))
    mine = links.withColumn("_anchor", anchor).withColumn("_tokens", T.tokens(F.col("_anchor")))
    best = candidates.withColumn("_candidate", T.tokens(F.col("text"))).where(F.size("_candidate") > 0)
    both = mine.join(best, key, "left")
    value = F.when(T.is_scent_free(F.col("_anchor")) | (F.size("_tokens") == 0) | F.col("_candidate").isNull(), F.lit(0.0)).otherwise(T.jaccard(F.col("_tokens"), F.col("_candidate")))
    groups = [c for c in links.columns]
    out = both.withColumn("_score", value).groupBy(*groups).agg(F.max(F.struct(F.col("_score"), (-F.col("ord")).alias("o"), F.col("text"))).alias("_best"))
    return out.select(*groups, F.col("_best._score").alias("score"), F.col("_best.text").alias("suggestion"))


def low_scent(links: DataFrame, candidates: DataFrame, key: list[str], threshold: float = T.LOW_SCENT) -> DataFrame:
    """Scored links below the threshold; code labels and stable identifiers are never among them."""
    plain = links.where(~F.coalesce(T.is_code_label(F.col("anchor")) | T.names_identifier(F.col("anchor"), F.col("target")), F.lit(False)))
    return scored(plain, candidates, key).where(F.col("score") < threshold)
