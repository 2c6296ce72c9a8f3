"""Queries over a Markdown corpus that is built from the pages table: one file for each page.

The corpus takes its shape from the page numbers alone, so SQL can derive every parse result,
reference, edge and finding from them.  Page ``k`` of ``n`` is ``g<k mod 7>/d<k>.md``, the first
seven are ``README.md`` of their folder; one in ten has no front matter.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..docgraph import DocGraph
from ..functions import text as T
from ..model import Config
from ..operators import conformance as V
from ..operators import findings as N
from ..operators import resolve as J
from ..sources import markdown as M

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(oracle: str):
    """Register a query and its SQL under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = oracle
        return f

    return add


def _say(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(files, assets): a Markdown file for each page, a picture for each second one."""
    k = F.col("page_id")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id")
    path = _say("g", k % 7, "/", F.when(k < 7, "README.md").otherwise(_say("d", k, ".md")))
    front = F.when(k % 10 == 9, "").otherwise(_say("---\ntitle: Title ", k, "\naliases: [alias", k, "]\nparent: README.md\ntype: note\n---\n"))
    body = _say(
        "# Heading ", k, "\n\n## Setup\n\nFirst [the part ", k, "](d", k + 7, ".md) and [the setup](d", k + 14, ".md#setup) here.\n\nThen [[d", k + 1, "]] and [[alias", k + 2, "]] and [click here](d", k + 7,
        ".md#none).\n\n### Setup\n\nSee [site](https://example.com/", k, "), [own](#setup-1), ![pic](img", k, ".png) and [folder](../g", (k + 1) % 7, ").\n")
    docs = pages.select(path.alias("doc_id"), F.concat(front, body).cast("binary").alias("content"), F.lit("2024-01-01").cast("timestamp").alias("mod_time"))
    return docs, pages.where(k % 2 == 0).select(_say("g", k % 7, "/img", k, ".png").alias("path"))


def corpus(spark: SparkSession, sf_dir: str, config: Config = Config()) -> DocGraph:
    docs, assets = files(spark, sf_dir)
    return DocGraph(spark, docs, assets, config)


def _path(k: str) -> str:
    return f"('g' || (({k}) % 7) || '/' || CASE WHEN ({k}) < 7 THEN 'README.md' ELSE 'd' || ({k}) || '.md' END)"


DOCS = f"""c AS (SELECT count(*) AS n FROM pages), k AS (SELECT page_id AS k, {_path('page_id')} AS doc, CASE WHEN page_id % 10 = 9 THEN 0 ELSE 6 END AS off, n FROM pages, c)"""
SECTIONS = """s AS (SELECT k, doc, 0 AS ord, 1 AS level, 'Heading ' || k AS text, 'heading-' || k AS slug, -1 AS parent_ord, off + 1 AS start_line, off + 11 AS end_line FROM k
 UNION ALL SELECT k, doc, 1, 2, 'Setup', 'setup', 0, off + 3, off + 11 FROM k UNION ALL SELECT k, doc, 2, 3, 'Setup', 'setup-1', 1, off + 9, off + 11 FROM k)"""
# every reference of a page: ord, type, line, whether its target is there, the target's page, fragment, anchor text
REFS = """r AS (SELECT k, doc AS origin, n, off, 0 AS ord, 'relative-link' AS type, off + 5 AS line, CASE WHEN k + 7 < n THEN 'valid' ELSE 'broken' END AS health, k + 7 AS t, '' AS frag, 'the part ' || k AS anchor FROM k
 UNION ALL SELECT k, doc, n, off, 1, 'relative-link', off + 5, CASE WHEN k + 14 < n THEN 'valid' ELSE 'broken' END, k + 14, 'setup', 'the setup' FROM k
 UNION ALL SELECT k, doc, n, off, 2, 'wikilink', off + 7, CASE WHEN k + 1 >= 7 AND k + 1 < n THEN 'valid' ELSE 'broken' END, k + 1, '', 'd' || (k + 1) FROM k
 UNION ALL SELECT k, doc, n, off, 3, 'wikilink', off + 7, CASE WHEN k + 2 < n AND (k + 2) % 10 <> 9 THEN 'valid' ELSE 'broken' END, k + 2, '', 'alias' || (k + 2) FROM k
 UNION ALL SELECT k, doc, n, off, 4, 'relative-link', off + 7, CASE WHEN k + 7 < n THEN 'broken-anchor' ELSE 'broken' END, k + 7, 'none', 'click here' FROM k
 UNION ALL SELECT k, doc, n, off, 5, 'external', off + 11, 'external', NULL, '', 'site' FROM k
 UNION ALL SELECT k, doc, n, off, 6, 'anchor', off + 11, 'valid', k, 'setup-1', 'own' FROM k
 UNION ALL SELECT k, doc, n, off, 7, 'image-embed', off + 11, CASE WHEN k % 2 = 0 THEN 'non-note' ELSE 'broken' END, NULL, '', 'pic' FROM k
 UNION ALL SELECT k, doc, n, off, 8, 'relative-link', off + 11, CASE WHEN (k + 1) % 7 < n THEN 'valid' ELSE 'broken' END, (k + 1) % 7, '', 'folder' FROM k)"""
EDGES = """e AS (SELECT r.origin || CASE WHEN line = r.off + 11 THEN '#setup-1' ELSE '#setup' END AS src, d.doc || CASE WHEN frag <> '' THEN '#' || frag ELSE '' END AS dst, r.origin AS src_doc, d.doc AS dst_doc, type, anchor AS anchor_text, line
  FROM r JOIN k d ON d.k = r.t WHERE health = 'valid' AND ord < 8
 UNION ALL SELECT r.origin || '#setup-1', d.doc, r.origin, d.doc, type, '', 0 FROM r JOIN k d ON d.k % 7 = r.t WHERE health = 'valid' AND ord = 8)"""
STRICT = """e AS (SELECT r.origin AS src_doc, d.doc AS dst_doc FROM r JOIN k d ON d.k = r.t WHERE health = 'valid')"""
PROJ = "p AS (SELECT DISTINCT src_doc AS src, dst_doc AS dst FROM e WHERE src_doc <> dst_doc)"
TIERS = """g AS (SELECT doc AS id, (SELECT count(*) FROM p WHERE dst = doc) AS i, (SELECT count(*) FROM p WHERE src = doc) AS o, k < 7 AS root FROM k),
 tier AS (SELECT id, i, o, CASE WHEN root THEN 'exempt' WHEN i = 0 AND o = 0 THEN 'isolated' WHEN o = 0 THEN 'dead-end' WHEN i < 3 THEN 'under-linked' ELSE 'linked' END AS tier FROM g)"""
TARGET = """CASE ord WHEN 0 THEN 'd' || (k + 7) || '.md' WHEN 1 THEN 'd' || (k + 14) || '.md' WHEN 2 THEN 'd' || (k + 1) WHEN 3 THEN 'alias' || (k + 2) WHEN 4 THEN 'd' || (k + 7) || '.md' WHEN 5 THEN 'https://example.com/' || k WHEN 6 THEN ''
 WHEN 7 THEN 'img' || k || '.png' ELSE '../g' || ((k + 1) % 7) END"""


# --- parser ---------------------------------------------------------------------------


@query(f"""WITH {DOCS} SELECT doc AS doc_id, CASE WHEN off = 6 THEN 'Title ' || k ELSE 'Heading ' || k END AS title, 'Heading ' || k AS description, off = 6 AS fm_present, off = 6 AS fm_parsed,
 CASE WHEN off = 6 THEN 'alias' || k ELSE '' END AS aliases, CASE WHEN off = 6 THEN 'README.md' ELSE '' END AS parent, CASE WHEN off = 6 THEN 'note' END AS type, CAST(3 AS BIGINT) AS sections, CAST(9 AS BIGINT) AS refs FROM k""")
def corpus_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed documents: front matter, titles, descriptions."""
    docs = M.documents(files(spark, sf_dir)[0])
    return docs.select("doc_id", "title", "description", "fm_present", "fm_parsed", F.array_join("fm.aliases", ",").alias("aliases"), "fm.parent", F.get_json_object("extra", "$.type").alias("type"),
                       F.size("sections").cast("long").alias("sections"), F.size("refs").cast("long").alias("refs"))


@query(f"WITH {DOCS}, {SECTIONS} SELECT doc AS doc_id, ord, level, text, slug, parent_ord, CAST(start_line AS INTEGER) AS start_line, CAST(end_line AS INTEGER) AS end_line FROM s")
def corpus_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Section tree with slugs and lines."""
    return M.sections(M.documents(files(spark, sf_dir)[0])).select("doc_id", "ord", "level", "text", "slug", "parent_ord", "start_line", F.col("end_line"))


@query(f"WITH {DOCS}, {REFS} SELECT origin, ord AS ref_ord, type, CAST(line AS INTEGER) AS line, {TARGET} AS raw_target, frag AS fragment, anchor AS anchor_text FROM r")
def corpus_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References as they are written."""
    return M.raw_refs(M.documents(files(spark, sf_dir)[0])).select("origin", "ref_ord", "type", "line", "raw_target", "fragment", "anchor_text")


@query(f"WITH {DOCS}, {SECTIONS} SELECT doc AS doc_id, slug AS anchor, 'section' AS kind FROM s")
def corpus_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.anchors(M.documents(files(spark, sf_dir)[0]))


@query(f"WITH {DOCS} SELECT 'alias' || k AS alias, doc AS doc_id FROM k WHERE off = 6")
def alias_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.aliases(M.documents(files(spark, sf_dir)[0]))


@query(f"WITH {DOCS} SELECT CAST(3 * count(*) AS BIGINT) AS headings FROM k")
def heading_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.heading_count(M.documents(files(spark, sf_dir)[0]))


@query(f"WITH {DOCS} SELECT 'g' || (k % 7) AS doc_id, count(*) AS n FROM k GROUP BY 1 HAVING count(*) > 1")
def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that more than one document has, where all of a folder share one."""
    return M.duplicate_ids(files(spark, sf_dir)[0].select(T.dir_name(F.col("doc_id")).alias("doc_id")))


# --- resolution and edges -------------------------------------------------------------


@query(f"""WITH {DOCS}, {REFS} SELECT r.origin, ord AS ref_ord, health, CASE WHEN health IN ('valid', 'broken-anchor') THEN d.doc END AS doc, CASE WHEN ord = 8 AND health = 'valid' THEN 'g' || r.t END AS directory,
 CASE WHEN health = 'external' THEN 'external' WHEN health = 'non-note' THEN 'asset' WHEN health <> 'valid' THEN 'none' WHEN ord = 8 THEN 'directory' WHEN frag <> '' THEN 'section' ELSE 'document' END AS target_kind,
 CASE WHEN health = 'valid' THEN frag ELSE '' END AS anchor FROM r LEFT JOIN k d ON d.k = r.t""")
def corpus_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resolved references: documents, aliases, folders, pictures, fragments, own anchors."""
    return corpus(spark, sf_dir).refs.select("origin", "ref_ord", "health", "doc", "directory", "target_kind", "anchor")


@query(f"WITH {DOCS}, {REFS}, {EDGES} SELECT src, dst, src_doc, dst_doc, type, anchor_text, CAST(line AS INTEGER) AS line FROM e")
def corpus_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference edges from the section that a link stands in; a folder's link goes to all its documents."""
    return corpus(spark, sf_dir).edges


@query(f"WITH {DOCS}, {REFS}, {EDGES} SELECT src, dst, type FROM e WHERE line > 0 UNION ALL SELECT r.origin || '#setup-1', d.doc, 'relative-link' FROM r JOIN k d ON d.k = r.t WHERE ord = 8 AND health = 'valid'")
def corpus_edges_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same where a folder's link goes to its index document alone."""
    return corpus(spark, sf_dir, Config(strict=True)).edges.select("src", "dst", "type")


@query(f"WITH {DOCS}, {SECTIONS} SELECT CASE WHEN ord = 0 THEN doc WHEN ord = 1 THEN doc || '#heading-' || k ELSE doc || '#setup' END AS src, doc || '#' || slug AS dst FROM s")
def corpus_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).contains


@query(f"WITH {DOCS}, {REFS}, {EDGES}, {PROJ} SELECT src, dst FROM p")
def corpus_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).projection


@query(f"WITH {DOCS}, {REFS}, {EDGES} SELECT DISTINCT src_doc AS src, dst_doc AS dst FROM e WHERE src_doc <> dst_doc AND type = 'wikilink'")
def corpus_wikilink_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The projection where only wikilinks count as navigation."""
    return corpus(spark, sf_dir, Config(nav_types=("wikilink",))).projection


@query(f"WITH {DOCS}, {REFS} SELECT DISTINCT origin AS src, {TARGET} || CASE WHEN frag <> '' THEN '#' || frag ELSE '' END AS target FROM r WHERE health IN ('broken', 'broken-anchor')")
def corpus_broken_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).broken_edges


@query(f"WITH {DOCS} SELECT doc AS id, CASE WHEN k >= 7 THEN {_path('k % 7')} END AS parent FROM k")
def corpus_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).hierarchy


@query(f"WITH {DOCS} SELECT doc AS id FROM k WHERE k < 7 OR regexp_matches(doc, '^g3/d1[0-9]*[.]md$')")
def corpus_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index documents and configured globs."""
    return corpus(spark, sf_dir, Config(roots=("g3/d1*.md",))).roots


@query(f"""WITH {DOCS}, q AS (SELECT k, doc, n, k % 3 AS m FROM k) SELECT k AS ref, CASE WHEN (m = 0 AND k + 7 < n) OR (m = 1 AND k >= 7) THEN 'valid' ELSE 'broken' END AS health,
 CASE WHEN m = 0 AND k + 7 < n THEN {_path('k + 7')} WHEN m = 1 AND k >= 7 THEN doc END AS doc FROM q""")
def content_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets from the root, under the content root of the document that holds them."""
    docs = files(spark, sf_dir)[0].select("doc_id")
    k = F.col("page_id")
    roots = tuple(f"g{x}" for x in range(7))
    target = F.when(k % 3 == 0, _say("/d", k + 7, ".md")).when(k % 3 == 1, _say("/./d", k, ".md")).otherwise("/../../x.md")
    refs = spark.read.parquet(f"{sf_dir}/pages.parquet").select(k.alias("ref"), _say("g", k % 7, "/any.md").alias("origin"), target.alias("target"))
    return J.relative(refs, docs, spark.createDataFrame([], "path string"), roots).select("ref", "health", "doc")


def _by_policy(spark: SparkSession, sf_dir: str, policy: str) -> DataFrame:
    k = F.col("page_id")
    target = F.when(k % 3 == 0, _say("g", k % 7, "/d", k)).when(k % 3 == 1, _say("x/d", k, ".md")).otherwise("README")
    refs = spark.read.parquet(f"{sf_dir}/pages.parquet").select(k.alias("ref"), target.alias("target"))
    found = J.wikilinks(refs, files(spark, sf_dir)[0].select("doc_id"), spark.createDataFrame([], "alias string, doc_id string"), policy)
    return found.select("ref", "health", "doc", F.size("candidates").cast("long").alias("candidates"))


@query(f"WITH {DOCS} SELECT k AS ref, CASE WHEN k % 3 = 0 AND k >= 7 THEN 'valid' ELSE 'broken' END AS health, CASE WHEN k % 3 = 0 AND k >= 7 THEN doc END AS doc, CAST(0 AS BIGINT) AS candidates FROM k")
def exact_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_policy(spark, sf_dir, "exact")


@query(f"""WITH {DOCS}, f AS (SELECT least(n, 7) AS f FROM c) SELECT k AS ref, CASE WHEN k % 3 = 2 AND f > 1 THEN 'ambiguous' WHEN k % 3 = 2 OR k >= 7 THEN 'valid' ELSE 'broken' END AS health,
 CASE WHEN k % 3 < 2 AND k >= 7 THEN doc END AS doc, CAST(CASE WHEN k % 3 = 2 AND f > 1 THEN f ELSE 0 END AS BIGINT) AS candidates FROM k, f""")
def basename_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_policy(spark, sf_dir, "basename")


# --- structure and findings -----------------------------------------------------------


@query(f"WITH {DOCS}, {REFS}, {STRICT}, {PROJ}, {TIERS} SELECT id, CAST(i AS BIGINT) AS in_degree, CAST(o AS BIGINT) AS out_degree, tier FROM tier")
def corpus_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir, Config(strict=True)).tiers.select("id", "in_degree", "out_degree", "tier")


@query(f"""WITH {DOCS}, {REFS}, t AS (SELECT *, {TARGET} || CASE WHEN frag <> '' THEN '#' || frag ELSE '' END AS target FROM r WHERE health IN ('broken', 'broken-anchor'))
SELECT CASE health WHEN 'broken' THEN 'broken-link' ELSE health END || ':' || origin || ':' || line || ':' || target AS id, CASE health WHEN 'broken' THEN 'broken-link' ELSE health END AS kind, 'error' AS severity,
 origin AS document, CAST(line AS INTEGER) AS line, target, type AS link_type, CASE WHEN health = 'broken-anchor' THEN {_path('t')} END AS target_document FROM t""")
def reference_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = N.reference_findings(corpus(spark, sf_dir).refs)
    return found.select("id", "kind", "severity", "document", "line", F.col("details")["target"].alias("target"), F.col("details")["linkType"].alias("link_type"), F.col("details")["targetDocument"].alias("target_document"))


_WALK = f"""h(id, d) AS (SELECT doc, 0 FROM k WHERE k < 7 UNION SELECT p.dst, h.d + 1 FROM h JOIN p ON p.src = h.id WHERE h.d < 40), m AS (SELECT id, min(d) AS d FROM h GROUP BY id)"""


@query(f"""WITH RECURSIVE {DOCS}, {REFS}, {STRICT}, {PROJ}, {TIERS}, {_WALK}
SELECT 'orphan:' || id AS id, 'orphan' AS kind, 'warning' AS severity FROM tier WHERE tier = 'isolated' UNION ALL SELECT 'under-linked:' || id, 'under-linked', 'info' FROM tier WHERE tier = 'under-linked'
UNION ALL SELECT 'dead-end:' || id, 'dead-end', 'info' FROM tier WHERE tier = 'dead-end' UNION ALL SELECT 'unreachable:' || id, 'unreachable', 'warning' FROM tier WHERE id NOT IN (SELECT id FROM m) AND tier <> 'isolated'
UNION ALL SELECT 'far-from-root:' || id, 'far-from-root', 'info' FROM m JOIN tier USING (id) WHERE d >= 6 AND tier <> 'exempt'""")
def structure_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structure findings of the whole report."""
    g = corpus(spark, sf_dir, Config(strict=True))
    return N.report(g, kinds=("orphan", "under-linked", "dead-end", "unreachable", "far-from-root")).select("id", "kind", "severity")


@query(f"""WITH {DOCS}, {REFS}, t AS (SELECT DISTINCT origin, line, {TARGET}, frag, health FROM r WHERE health IN ('broken', 'broken-anchor'))
SELECT CASE health WHEN 'broken' THEN 'broken-link' ELSE health END AS kind, 'error' AS severity, count(*) AS n FROM t GROUP BY 1""")
def finding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.counts(N.reference_findings(corpus(spark, sf_dir).refs))


@query(f"""WITH {DOCS}, {REFS} SELECT 'dead-link:' || origin || ':' || line || ':https://example.com/' || k AS id, CAST(404 AS VARCHAR) AS status FROM r WHERE ord = 5 AND k % 3 = 0""")
def dead_link_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, k = corpus(spark, sf_dir), F.col("page_id")
    checked = spark.read.parquet(f"{sf_dir}/pages.parquet").select(_say("https://example.com/", k).alias("url"), (k % 3 > 0).alias("ok"), F.when(k % 3 > 0, 200).otherwise(404).alias("status"), F.lit(False).alias("blocked"))
    return N.dead_link_findings(g.refs, checked).select("id", F.col("details")["statusCode"].alias("status"))


@query("""WITH l AS (SELECT l_orderkey || '-' || l_linenumber AS doc, CASE l_returnflag WHEN 'R' THEN 'low-scent-anchor' WHEN 'A' THEN 'suggested-link' ELSE 'bridge' END AS kind, l_discount, l_tax, l_linenumber FROM lineitem),
o AS (SELECT doc, kind, row_number() OVER (PARTITION BY kind ORDER BY CASE kind WHEN 'low-scent-anchor' THEN round(l_discount, 6) ELSE -round(l_tax, 6) END, -l_linenumber, doc, kind || ':' || doc) AS place FROM l)
SELECT kind || ':' || doc AS id FROM o WHERE kind = 'bridge' OR kind = 'suggested-link' AND place <= 20 OR kind = 'low-scent-anchor' AND place <= 50""")
def capped_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repair list's default choice: advisory kinds are capped, others are not."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("doc", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    found = None
    for flag, kind in (("R", "low-scent-anchor"), ("A", "suggested-link"), ("N", "bridge")):
        some = lines.where(F.col("l_returnflag") == flag)
        rows = N._rows(some, kind, "info", [F.col("doc")], F.col("doc"), F.lit(0), F.lit(""), F.lit(""), {"scentScore": T.fixed6(F.col("l_discount")), "adamicAdar": T.fixed6(F.col("l_tax")), "sharedNeighbours": F.col("l_linenumber")})
        found = rows if found is None else found.unionByName(rows)
    return N.select(found).select("id")


@query("""WITH p AS (SELECT p_partkey AS k FROM part), f AS (SELECT k, CASE WHEN k % 3 = 0 THEN 'drafts/d' || k || '.md' WHEN k % 3 = 1 THEN 'a/x.md' ELSE 'a/keep' || k || '.md' END AS doc, CASE WHEN k % 2 = 0 THEN 'info' ELSE 'error' END AS severity FROM p)
SELECT k FROM f WHERE severity = 'error' OR NOT (starts_with(doc, 'drafts/') OR doc = 'a/x.md' OR regexp_matches(doc, '^a/keep[0-9]*5[.]md$') AND doc <> 'a/keep125.md')""")
def excluded_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Advisory findings about excluded documents go: folders, names at any depth, and what is taken back in."""
    k = F.col("p_partkey")
    doc = F.when(k % 3 == 0, _say("drafts/d", k, ".md")).when(k % 3 == 1, "a/x.md").otherwise(_say("a/keep", k, ".md"))
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(k.alias("k"), doc.alias("document"), F.when(k % 2 == 0, "info").otherwise("error").alias("severity"), F.lit("bridge").alias("kind"), F.create_map(F.lit("target"), F.lit("x")).alias("details"))
    return N.select(rows, everything=True, exclude=("drafts/", "x.md", "keep*5.md", "!keep125.md")).select("k")


# --- anchor texts ---------------------------------------------------------------------

_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)


def _tokens(x: str) -> str:
    return f"list_sort(list_distinct([w FOR w IN regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{Nd}}]+') IF strlen(w) > 1 AND w NOT IN ({_STOP})]))"


@query(f"""WITH {DOCS}, {SECTIONS}, {REFS}, {EDGES}, title AS (SELECT doc, CASE WHEN off = 6 THEN 'Title ' || k ELSE 'Heading ' || k END AS title FROM k),
cand AS (SELECT doc AS dst, 0 AS o, title AS x FROM title UNION ALL SELECT doc, ord + 1, text FROM s UNION ALL SELECT doc || '#' || slug, 0, text FROM s UNION ALL SELECT s.doc || '#' || slug, 1, title FROM s JOIN title USING (doc)),
l AS (SELECT DISTINCT src_doc, dst_doc, line, anchor_text, dst FROM e WHERE line > 0 AND NOT (length(regexp_extract(dst_doc, '/([^/]*)[.]md$', 1)) > 1 AND regexp_matches(regexp_extract(dst_doc, '/([^/]*)[.]md$', 1), '[0-9]')
  AND list_contains({_tokens('anchor_text')}, lower(regexp_extract(dst_doc, '/([^/]*)[.]md$', 1))))),
z AS (SELECT l.*, o, x, {_tokens('anchor_text')} AS u, {_tokens('x')} AS v FROM l JOIN cand ON cand.dst = l.dst),
w AS (SELECT src_doc, dst_doc, line, anchor_text, dst, CASE WHEN lower(trim(anchor_text)) IN ({", ".join(f"'{x}'" for x in T.SCENT_FREE)}) OR len(u) = 0 THEN 0.0 ELSE len(list_intersect(u, v)) / len(list_distinct(list_concat(u, v))) END AS score, o, x FROM z WHERE len(v) > 0),
y AS (SELECT *, row_number() OVER (PARTITION BY src_doc, dst_doc, line, anchor_text, dst ORDER BY score DESC, o, x DESC) AS place FROM w)
SELECT src_doc AS source, dst_doc AS target, CAST(line AS INTEGER) AS line, anchor_text AS anchor, round(score, 6) AS score, x AS suggestion FROM y WHERE place = 1 AND score < 0.2""")
def corpus_low_scent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links whose text says little about their target, against titles and headings."""
    return corpus(spark, sf_dir).scent.select("source", "target", "line", "anchor", F.round("score", 6).alias("score"), "suggestion")


# --- conformance ----------------------------------------------------------------------


@query("""WITH q AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE o_orderpriority END AS text FROM orders)
SELECT k || '/log.md' AS doc_id, CAST(k % 50 AS INTEGER) AS line, 'heading is no date: ' || text AS reason FROM q WHERE k % 4 <> 0
UNION ALL SELECT 'index.md', 1, 'front matter holds more than okf_version'""")
def conformance_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log headings that are no dates, and an index at the root that says too much."""
    orders, k = spark.read.parquet(f"{sf_dir}/orders.parquet"), F.col("o_orderkey")
    none = F.struct(*[F.lit("").alias(c) for c in ("title", "description", "name", "parent", "status", "date")], *[F.array().cast("array<string>").alias(c) for c in ("tags", "aliases", "related")])
    logs = orders.select(_say(k, "/log.md").alias("doc_id"), none.alias("fm"), F.lit("{}").alias("extra"), F.lit(False).alias("fm_present"), F.lit(False).alias("fm_parsed"))
    top = spark.range(1).select(F.lit("index.md").alias("doc_id"), none.alias("fm"), F.lit('{"okf_version": "1", "more": 2}').alias("extra"), F.lit(True).alias("fm_present"), F.lit(True).alias("fm_parsed"))
    text = F.when(k % 4 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.col("o_orderpriority"))
    sections = orders.select(_say(k, "/log.md").alias("doc_id"), F.lit(2).alias("level"), text.alias("text"), (k % 50).cast("int").alias("start_line"))
    return V.violations(logs.unionByName(top), sections).select("doc_id", "line", "reason")


@query(f"""WITH {DOCS}, {REFS}, {EDGES}, {PROJ} SELECT dst AS id, string_agg(src, ',' ORDER BY src) AS backlinks FROM p GROUP BY dst""")
def corpus_backlinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).backlinks.select("id", F.array_join("backlinks", ",").alias("backlinks"))
