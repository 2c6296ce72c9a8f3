"""Link graphs and path catalogs derived from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.lineage import Scratch


def _handoff(spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    """Edges between the keys of consecutive lines of an order."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    a = lines.select("l_orderkey", (F.col("l_linenumber") + 1).alias("l_linenumber"), F.col(key).alias("src"))
    b = lines.select("l_orderkey", "l_linenumber", F.col(key).alias("dst"))
    # written once: operators read it round by round
    return Scratch(spark, "handoff").write(a.join(b, ["l_orderkey", "l_linenumber"]).where("src <> dst").select("src", "dst").distinct(), "edges")


def supplier_handoff(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("id")), _handoff(spark, sf_dir, "l_suppkey")


def part_handoff(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id")), _handoff(spark, sf_dir, "l_partkey")


def order_succession(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Each order to the next one of its customer: many chains, one for each customer."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    after = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    edges = orders.select(F.col("o_orderkey").alias("src"), after.alias("dst")).where("dst IS NOT NULL")
    return orders.select(F.col("o_orderkey").alias("id")), Scratch(spark, "succession").write(edges, "edges")


def user_succession(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Each user to the user of the event after a purchase.

    The next event is found within buckets of an hour and the first event of the next bucket
    that has one, so no task sorts the whole stream.
    """
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", "event_id", "user_id", "event_type", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000).alias("hour"))
    inside = events.withColumn("next", F.lead("user_id").over(Window.partitionBy("hour").orderBy("ts", "event_id")))
    first = events.groupBy("hour").agg(F.min_by("user_id", F.struct("ts", "event_id")).alias("first"))
    after = first.withColumn("after", F.lead("first").over(Window.orderBy("hour"))).select("hour", "after")
    edges = inside.join(after, "hour").where("event_type = 'purchase'").select(F.col("user_id").alias("src"), F.coalesce("next", "after").alias("dst"))
    return events.select(F.col("user_id").alias("id")).distinct(), edges.where("src <> dst").distinct()


def roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of nation 0."""
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").where("s_nationkey = 0").select(F.col("s_suppkey").alias("id"))


def page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document ids from page URLs: ``host/path.md``, host without its first label."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    host = F.regexp_extract("url", "^[a-z]+://[^./]+[.]([^/?#]*)", 1)
    path = F.regexp_replace(F.regexp_extract("url", "^[a-z]+://[^/?#]*/([^?#]*)", 1), r"(/|[.]html)$", "")
    return pages.select(F.concat(host, F.lit("/"), path, F.lit(".md")).alias("doc_id")).distinct()


def page_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, ord, href, anchor, title) of the links of every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))
    links = pages.select("page_id", "title", F.posexplode(F.expr("regexp_extract_all(html, '<a href=\"([^\"]*)\">[^<]*</a>', 0)")).alias("ord", "a"))
    return links.select("page_id", (F.col("ord") + 1).alias("ord"), F.regexp_extract("a", 'href="([^"]*)"', 1).alias("href"), F.regexp_extract("a", ">([^<]*)<", 1).alias("anchor"), "title")
