"""Format conformance of a bundle (C1-C6): front matter and type, log headings, index files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def violations(documents: DataFrame, sections: DataFrame) -> DataFrame:
    """(doc_id, line, rule, reason): rule missing-frontmatter, missing-type or reserved-structure."""
    base = F.lower(T.base_name(F.col("doc_id")))
    docs = documents.select("doc_id", base.alias("base"), T.dir_name(F.col("doc_id")).alias("dir"), "fm", "fm_present", "fm_parsed", F.parse_json("extra").alias("extra"), "extra")
    docs = docs.toDF("doc_id", "base", "dir", "fm", "fm_present", "fm_parsed", "more", "extra")
    concept = docs.where(~F.col("base").isin("index.md", "log.md"))
    state = F.when(~F.col("fm_present"), "absent").when(~F.col("fm_parsed"), "unparseable")
    first = concept.where(state.isNotNull()).select("doc_id", F.lit(1).alias("line"), F.lit("missing-frontmatter").alias("rule"), state.alias("reason"))
    said = F.get_json_object("extra", "$.type")
    kind = F.schema_of_variant(F.try_variant_get("more", "$.type", "variant"))
    wrong = (
        F.when(F.startswith(kind, F.lit("ARRAY")), "a list").when(F.startswith(kind, F.lit("OBJECT")), "a mapping").when(kind == "BOOLEAN", "a boolean").when(kind != "STRING", "a number")
    )
    reason = F.when(said.isNull(), "no type").when(wrong.isNotNull(), F.concat(F.lit("type is "), wrong)).when(F.trim(said) == "", "type is empty")
    second = concept.where(F.col("fm_present") & F.col("fm_parsed")).select("doc_id", F.lit(1).alias("line"), F.lit("missing-type").alias("rule"), reason.alias("reason")).where("reason IS NOT NULL")
    logs = docs.where("base = 'log.md'").select("doc_id").join(sections.where("level = 2"), "doc_id").where(~T.is_date_shape(F.trim("text")))
    third = logs.select("doc_id", F.col("start_line").alias("line"), F.lit("reserved-structure").alias("rule"), F.concat(F.lit("heading is no date: "), "text").alias("reason"))
    index = docs.where("base = 'index.md' AND fm_present")
    typed = F.array_join(F.array_compact(F.array(*[F.nullif(F.col(f"fm.{k}"), F.lit("")) for k in ("description", "name", "parent", "status", "date")])), "") != ""
    listed = F.size("fm.tags") + F.size("fm.aliases") + F.size("fm.related") > 0
    others = F.size(F.filter(F.coalesce(F.json_object_keys("extra"), F.array()), lambda k: k != "okf_version")) > 0
    reason = F.when(F.col("dir") != ".", "front matter in an index below the root").when(~F.col("fm_parsed"), "front matter does not parse").when(typed | listed | others, "front matter holds more than okf_version")
    fourth = index.select("doc_id", F.lit(1).alias("line"), F.lit("reserved-structure").alias("rule"), reason.alias("reason")).where("reason IS NOT NULL")
    return first.unionByName(second).unionByName(third).unionByName(fourth)


def version(documents: DataFrame) -> str | None:
    """The version that the root's index declares."""
    row = documents.where("lower(doc_id) = 'index.md'").select(F.get_json_object("extra", "$.okf_version").alias("v")).first()
    return row["v"] if row else None
