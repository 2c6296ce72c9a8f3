"""Exact dedup by a heavy-hitter split.

1. Every row gets the SHA-256 of its normalised text (A-Z lower-cased, null as empty).
2. Each partition runs a Misra-Gries summary over its digests.  The summed summaries
   name every digest of more than ``2 N / (counters + 1)`` rows among their ``counters``
   largest, so the broadcast holds ``counters`` rows at most, whatever the input.
3. The candidates are verified: an exact count and the winner (largest id) of each.
   Rows of a heavy digest that lose to the winner are settled where they are read.
4. Heavy winners and all remaining rows are dealt out by digest, as usual; no digest
   brings more than ``2 N / (counters + 1)`` rows there.

Defined cases: null and empty texts are equal; a null id loses to any id; of repeated
rows with the winning id one stays; an empty table gives an empty result; very long texts are
hashed whole; columns of the
input that share a result column's name are replaced by it in :func:`exact_dedup` and kept
as they are by :func:`survivors`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import BinaryType

from ..plans.lineage import Scratch
from .text import pack, pick

COUNTERS = 1024


@arrow_udf(BinaryType())
def text_digest(text: pa.Array) -> pa.Array:
    """SHA-256 of the text with A-Z lower-cased; ``bytes.lower`` touches ASCII only."""
    raw = text.cast(pa.binary()).to_pylist()
    return pa.array([hashlib.sha256((x or b"").lower()).digest() for x in raw], pa.binary())


def misra_gries(batches: Iterator[pa.Array], counters: int) -> dict:
    """Mergeable Misra-Gries summary: at most ``counters`` values, each undercounted by
    ``rows / (counters + 1)`` at most."""
    held: dict = {}
    for values in batches:
        for x in pc.value_counts(values).to_pylist():
            held[x["values"]] = held.get(x["values"], 0) + x["counts"]
        if len(held) > counters:
            cut = sorted(held.values(), reverse=True)[counters]
            held = {k: n - cut for k, n in held.items() if n > cut}
    return held


def heavy_hitters(digests: DataFrame, counters: int) -> DataFrame:
    """Candidate digests, ``counters`` rows at most: a superset of those above 2 N / (counters + 1) rows."""

    def summarise(batches):
        held = misra_gries((b.column(0) for b in batches), counters)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["digest", "n"])

    return (
        digests.select("digest").mapInArrow(summarise, "digest binary, n long")
        .groupBy("digest").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "digest").limit(counters).select("digest")
    )


def _verified(digests: DataFrame, counters: int, scratch: Scratch) -> DataFrame:
    found = heavy_hitters(digests, counters)
    return scratch.write(
        digests.join(F.broadcast(found), "digest").groupBy("digest").agg(F.max("id").alias("heavy_id"), F.count(F.lit(1)).alias("heavy_n")).where("heavy_n > 1 AND heavy_id IS NOT NULL"),
        "heavy",
    )


def _digests(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(pick(df, id_col).alias("id"), text_digest(pick(df, text_col)).alias("digest"))


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """One row for each input row: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``."""
    scratch = Scratch(df.sparkSession, "exact-dedup")
    digests = scratch.write(_digests(df, id_col, text_col), "digests")
    joined = digests.join(F.broadcast(_verified(digests, counters, scratch)), "digest", "left")
    lost = F.coalesce(F.col("id") < F.col("heavy_id"), F.lit(False))
    settled = joined.where(lost).select("digest", "id", F.col("heavy_id").alias("keep_id"), F.col("heavy_n").alias("group_size"), F.lit(False).alias("kept"))
    group = Window.partitionBy("digest")
    rest = joined.where(~lost).select(
        "digest", "id",
        F.max("id").over(group).alias("keep_id"),
        F.coalesce("heavy_n", F.count(F.lit(1)).over(group)).alias("group_size"),
        (F.row_number().over(group.orderBy(F.desc_nulls_last("id"))) == 1).alias("kept"),
    )
    return settled.unionByName(rest).select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def survivors(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """The rows that stay, with the input's columns.

    Losing copies of heavy digests are dropped before the shuffle; of the rest, each task
    sends the best row it has for a digest (Spark's window group limit).
    """
    scratch = Scratch(df.sparkSession, "exact-dedup")
    digests = scratch.write(_digests(df, id_col, text_col), "digests")
    rows = df.select(pack(df), pick(df, id_col).alias("id"), text_digest(pick(df, text_col)).alias("digest"))
    joined = rows.join(F.broadcast(_verified(digests, counters, scratch)), "digest", "left")
    best = Window.partitionBy("digest").orderBy(F.desc_nulls_last("id"))
    return (
        joined.where(~F.coalesce(F.col("id") < F.col("heavy_id"), F.lit(False)))
        .withColumn("_place", F.row_number().over(best)).where("_place = 1").select("_row.*")
    )
