"""Reference resolution as joins.

Catalog lookups that compare every reference with every document become equi-joins: a
document is listed under each of its trailing path suffixes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as T
from ..model import INDEX_NAMES


def directories(docs: DataFrame) -> DataFrame:
    """(dir, children, index_doc): direct children sorted, the smallest index document."""
    base = F.lower(T.base_name(F.col("doc_id")))
    return docs.select("doc_id", T.dir_name(F.col("doc_id")).alias("dir")).groupBy("dir").agg(
        F.sort_array(F.collect_set("doc_id")).alias("children"), F.min(F.when(base.isin(*INDEX_NAMES), F.col("doc_id"))).alias("index_doc"))


def suffixes(docs: DataFrame) -> DataFrame:
    """(doc_id, suffix): every trailing run of whole path segments."""
    parts = F.split("doc_id", "/")
    places = F.sequence(F.lit(1), F.size(parts))
    return docs.select("doc_id", F.explode(F.transform(places, lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).alias("suffix"))


def forms(target: Column) -> Column:
    """The names a wikilink target may have: as written, and with ``.md`` unless it has a Markdown extension."""
    return F.when(P.is_markdown(target), F.array(target)).otherwise(F.array(target, F.concat(target, F.lit(".md"))))


def wikilinks(refs: DataFrame, docs: DataFrame, aliases: DataFrame, policy: str = "longest-suffix") -> DataFrame:
    """``refs(ref, target)`` -> (ref, health, doc, candidates): document, alias, directory, in that order."""
    cleaned = P.clean(F.replace("target", F.lit("\\"), F.lit("/")))
    asked = refs.select("ref", "target", F.explode(forms(cleaned)).alias("form"))
    if policy == "exact":
        found = asked.join(docs.select("doc_id", F.col("doc_id").alias("form")), "form")
    elif policy == "basename":
        found = asked.withColumn("form", T.base_name(F.col("form"))).join(docs.select("doc_id", T.base_name(F.col("doc_id")).alias("form")), "form")
    else:
        found = asked.join(suffixes(docs).withColumnRenamed("suffix", "form"), "form")
    by_name = found.groupBy("ref").agg(F.sort_array(F.collect_set("doc_id")).alias("named"))
    by_alias = refs.join(aliases.select(F.col("alias").alias("target"), "doc_id"), "target").groupBy("ref").agg(F.sort_array(F.collect_set("doc_id")).alias("aliased"))
    folders = refs.select("ref", cleaned.alias("dir")).join(directories(docs), "dir").select("ref", "dir", "index_doc", "children")
    joined = refs.join(by_name, "ref", "left").join(by_alias, "ref", "left").join(folders, "ref", "left")
    many = F.when(F.size("named") >= 1, F.col("named")).otherwise(F.col("aliased"))
    count = F.coalesce(F.size(many), F.lit(0))
    return joined.select(
        "ref",
        F.when(count == 1, "valid").when(count > 1, "ambiguous").when(F.col("dir").isNotNull(), "valid").otherwise("broken").alias("health"),
        F.when(count == 1, many[0]).when(count == 0, F.col("index_doc")).alias("doc"),
        F.when(count > 1, many).otherwise(F.array().cast("array<string>")).alias("candidates"),
        F.when((count == 0) & F.col("dir").isNotNull(), F.col("dir")).alias("directory"),
        F.when((count == 0) & F.col("dir").isNotNull(), F.col("children")).otherwise(F.array().cast("array<string>")).alias("children"),
    )


def content_prefix(origin: Column, roots: tuple[str, ...]) -> Column:
    """The first content root, in order, that the origin is under."""
    out = F.lit(None).cast("string")
    for root in sorted(roots, reverse=True):
        out = F.when(F.startswith(origin, F.lit(root.rstrip("/") + "/")), root.rstrip("/")).otherwise(out)
    return out


def relative(refs: DataFrame, docs: DataFrame, assets: DataFrame, content_roots: tuple[str, ...] = ()) -> DataFrame:
    """``refs(ref, origin, target)`` -> (ref, health, doc, directory, children): document, directory, asset, broken."""
    origin = F.col("origin")
    placed = refs.select("ref", P.normalise(T.dir_name(origin), F.col("target"), content_prefix(origin, content_roots)).alias("path"))
    joined = (
        placed.join(docs.select("doc_id", F.col("doc_id").alias("path")), "path", "left")
        .join(directories(docs).withColumnRenamed("dir", "path").withColumn("is_dir", F.lit(True)), "path", "left")
        .join(assets.select(F.col("path"), F.lit(True).alias("asset")).distinct(), "path", "left")
    )
    is_dir = F.col("doc_id").isNull() & F.col("is_dir")
    asset = F.coalesce("asset", F.lit(False)) & ~P.is_markdown(F.col("path"))
    return joined.select(
        "ref", F.when(F.col("doc_id").isNotNull() | F.coalesce(is_dir, F.lit(False)), "valid").when(asset, "non-note").otherwise("broken").alias("health"),
        F.coalesce("doc_id", "index_doc").alias("doc"), F.when(is_dir, F.col("path")).alias("directory"),
        F.when(is_dir, F.col("children")).otherwise(F.array().cast("array<string>")).alias("children"),
    )


def with_fragments(found: DataFrame, refs: DataFrame, anchors: DataFrame) -> DataFrame:
    """Check fragments of valid document targets (J11): section, literal anchor, or broken-anchor.

    ``refs(ref, fragment)``, ``anchors(doc_id, anchor, kind)`` with kind section or literal.
    """
    known = anchors.groupBy(F.col("doc_id").alias("doc"), F.col("anchor").alias("fragment")).agg(F.max(F.col("kind") == "section").alias("is_section"))
    joined = found.join(refs.select("ref", "fragment"), "ref").join(known, ["doc", "fragment"], "left")
    checked = (F.col("health") == "valid") & F.col("directory").isNull() & (F.coalesce("fragment", F.lit("")) != "")
    health = F.when(checked & F.col("is_section").isNull(), "broken-anchor").otherwise(F.col("health"))
    kind = (
        F.when(health.isin("broken", "ambiguous", "unresolved"), "none").when(health == "non-note", "asset").when(F.col("directory").isNotNull(), "directory")
        .when(checked & F.col("is_section"), "section").otherwise("document")
    )
    kind = F.when(health == "broken-anchor", "none").otherwise(kind)
    return joined.withColumn("target_kind", kind).withColumn("anchor", F.when(checked & F.col("is_section").isNotNull(), F.col("fragment")).otherwise(F.lit(""))).withColumn("health", health).drop("is_section")
