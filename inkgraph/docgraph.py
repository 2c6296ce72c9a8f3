"""A documentation corpus as DataFrames: scan, parse, resolve, build, analyse."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import paths as P
from .functions import text as T
from .model import LINK_TYPES, NAVIGATIONAL, ROOT_NAMES, Config
from .operators import components as C
from .operators import graph as G
from .operators import paths as A
from .operators import rank as R
from .operators import reach as B
from .operators import resolve as J
from .operators import scent as S
from .plans.lineage import Scratch
from .sources import markdown as M
from .sources import scan


# From how many documents on a low compactness is told, and what is low.
LOW_COMPACTNESS_DOCS, LOW_COMPACTNESS = 10, 0.1
# Into how many parts a folder's links are dealt.
SALTS = 32


@dataclass
class DocGraph:
    """Tables and results of one corpus; each is made when first asked for and written once."""

    spark: SparkSession
    files: DataFrame
    assets: DataFrame
    config: Config = Config()
    notices: tuple[tuple[str, str, str], ...] = ()

    @classmethod
    def from_path(cls, spark: SparkSession, root: str, config: Config = Config()) -> DocGraph:
        listing = scan.list_tree(root, config)
        assets = spark.createDataFrame([(a,) for a in listing.assets], "path string")
        return cls(spark, scan.files(spark, listing), assets, config, tuple(listing.notices))

    @cached_property
    def scratch(self) -> Scratch:
        return Scratch(self.spark, "docgraph")

    def analysis_notices(self) -> list[tuple[str, str, str]]:
        """What limits the results (N10, I1): ids of several files, no roots, malformed globs, cut lists, low compactness."""
        out = [("analysis", r["doc_id"], f"{r['n']} files give this id") for r in M.duplicate_ids(self.documents).orderBy("doc_id").collect()]
        empty = self.documents.isEmpty()
        if not empty and not self.has_roots:
            out.append(("analysis", ".", "no roots were found; reachability is not told"))
        out += [("analysis", glob, "the root pattern is malformed and matches nothing") for glob in self.config.roots if P.glob_regex(glob) is None]
        if self.gaps[1]:
            out.append(("analysis", ".", "only the first knowledge gaps are listed"))
        if self.suggestions[1] or self.suggestions[2]:
            out.append(("analysis", ".", "only some suggested links are listed: the list is capped, or neighbours with very many links were passed over"))
        if not empty and self.documents.count() >= LOW_COMPACTNESS_DOCS and (compactness := self.navigability.first()["compactness"] or 0.0) < LOW_COMPACTNESS:
            out.append(("analysis", ".", f"compactness is {compactness:.3f}: few documents can be reached from one another"))
        return out

    # --- tables -----------------------------------------------------------------------

    @cached_property
    def documents(self) -> DataFrame:
        return self.scratch.write(M.documents(self.files), "documents")

    @cached_property
    def nodes(self) -> DataFrame:
        return self.documents.select(F.col("doc_id").alias("id"))

    @cached_property
    def sections(self) -> DataFrame:
        return M.sections(self.documents)

    @cached_property
    def refs(self) -> DataFrame:
        """Every reference with its target and health."""
        docs = self.documents.select("doc_id")
        raw = M.raw_refs(self.documents).withColumn("ref", F.struct("origin", "ref_ord")).withColumn("target", F.col("raw_target"))
        none, empty = F.lit(None).cast("string"), F.array().cast("array<string>")
        # folders are told by name alone: their documents are joined where they are asked for
        plain = J.relative(raw.where(F.col("type").isin("relative-link", "image-embed", "frontmatter-related")), docs, self.assets, self.config.content_roots).withColumn("candidates", empty).drop("children")
        wiki = J.wikilinks(raw.where(F.col("type").isin("wikilink", "transclusion")), docs, M.aliases(self.documents), self.config.policy).drop("children")
        own = raw.where("type = 'anchor'").select("ref", F.when(F.col("fragment") == "", "broken").otherwise("valid").alias("health"), F.col("origin").alias("doc"), none.alias("directory"), empty.alias("candidates"))
        away = raw.where("type = 'external'").select("ref", F.lit("external").alias("health"), none.alias("doc"), none.alias("directory"), empty.alias("candidates"))
        found = plain.unionByName(wiki).unionByName(own)
        checked = J.with_fragments(found, raw, M.anchors(self.documents)).unionByName(
            away.withColumn("fragment", F.lit("")).withColumn("target_kind", F.lit("external")).withColumn("anchor", F.lit("")))
        rest = raw.select("ref", "origin", "ref_ord", "raw_target", F.col("fragment").alias("raw_fragment"), "type", "line", "anchor_text")
        return self.scratch.write(checked.drop("fragment").join(rest, "ref").withColumnRenamed("raw_fragment", "fragment").drop("ref"), "refs")

    @cached_property
    def members(self) -> DataFrame:
        """(directory, dst): the documents right in each folder."""
        return self.documents.select(T.dir_name(F.col("doc_id")).alias("directory"), F.col("doc_id").alias("dst")).distinct()

    def _expanded(self, links: DataFrame, *key: str) -> DataFrame:
        """Each link once for every document of its folder.

        A folder's links are dealt over ``SALTS`` by ``key``, its documents are repeated for each,
        so a large folder is many tasks' work; no row holds a folder's documents.
        """
        parts = 4 * int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = links.withColumn("_salt", F.pmod(F.xxhash64(*key), F.lit(SALTS)).cast("int")).repartition(parts, "directory", "_salt")
        docs = self.members.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).repartition(parts, "directory", "_salt")
        return dealt.join(docs.hint("merge"), ["directory", "_salt"]).drop("_salt")

    @cached_property
    def edges(self) -> DataFrame:
        """Reference edges with section ends (B2-B4): src, dst, src_doc, dst_doc, type, anchor_text, line."""
        good = self.refs.where("health = 'valid'")
        lines = self.sections.where("slug <> ''").select(F.col("doc_id").alias("origin"), "ord", "slug", "start_line", "end_line")
        at = good.select("origin", "ref_ord", "line").join(lines, "origin").where("line BETWEEN start_line AND end_line").groupBy("origin", "ref_ord").agg(F.max_by("slug", "ord").alias("src_slug"))
        good = good.join(at, ["origin", "ref_ord"], "left")
        src = F.when(F.col("src_slug").isNotNull(), F.concat("origin", F.lit("#"), "src_slug")).otherwise(F.col("origin"))
        direct = good.where("doc IS NOT NULL AND directory IS NULL").select(
            src.alias("src"), F.when(F.col("target_kind") == "section", F.concat("doc", F.lit("#"), "anchor")).otherwise(F.col("doc")).alias("dst"),
            F.col("origin").alias("src_doc"), F.col("doc").alias("dst_doc"), "type", "anchor_text", "line")
        folders = good.where("directory IS NOT NULL")
        if self.config.strict:
            expanded = folders.where("doc IS NOT NULL").select(src.alias("src"), F.col("doc").alias("dst"), F.col("origin").alias("src_doc"), F.col("doc").alias("dst_doc"), "type", F.lit("").alias("anchor_text"), F.lit(0).alias("line"))
        else:
            expanded = folders.select(src.alias("src"), "origin", "ref_ord", "directory", "type")
            expanded = self._expanded(expanded, "origin", "ref_ord").select("src", "dst", F.col("origin").alias("src_doc"), F.col("dst").alias("dst_doc"), "type", F.lit("").alias("anchor_text"), F.lit(0).alias("line"))
        return direct.unionByName(expanded)

    @cached_property
    def contains(self) -> DataFrame:
        """Document to section and section to subsection (B1); sections without a slug are passed through."""
        return M.contains(self.documents)

    @cached_property
    def _links(self) -> tuple[DataFrame, DataFrame]:
        """Navigational links between documents: distinct (src, dst), and distinct (src, directory) that stand for a folder's documents."""
        good = self.refs.where("health = 'valid'").where(F.col("type").isin(*self.config.nav_types))
        direct = good.where("doc IS NOT NULL" if self.config.strict else "doc IS NOT NULL AND directory IS NULL")
        folders = good.where(F.lit(not self.config.strict)).where("directory IS NOT NULL").select(F.col("origin").alias("src"), "directory").distinct()
        return G.projection(direct, "origin", "doc"), folders

    @cached_property
    def projection(self) -> DataFrame:
        """Distinct document edges (B5), not written: a document is in one folder, so only the direct links are compared."""
        direct, folders = self._links
        alone = direct.withColumn("directory", T.dir_name(F.col("dst"))).join(folders, ["src", "directory"], "left_anti").select("src", "dst")
        return alone.unionByName(self._expanded(folders, "src").select("src", "dst").where("src <> dst"))

    @cached_property
    def proj(self) -> DataFrame:
        return self.scratch.write(self.projection, "proj")

    @cached_property
    def backlinks(self) -> DataFrame:
        """(id, backlinks): sorted documents that link to each.

        Who links to a folder is put together once for each folder and sent to its documents in
        ``SALTS`` parts; links that name a document are added to its own row.
        """
        parts = 4 * int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        direct, folders = self._links
        alone = direct.withColumn("directory", T.dir_name(F.col("dst"))).join(folders, ["src", "directory"], "left_anti")
        own = alone.groupBy(F.col("dst").alias("id")).agg(F.collect_list("src").alias("own"))
        shared = self.scratch.write(folders.groupBy("directory").agg(F.sort_array(F.collect_list("src")).alias("shared")), "folder-links")
        docs = self.members.withColumnRenamed("dst", "id").join(own, "id", "left").withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).repartition(parts, "directory", "_salt")
        dealt = shared.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).repartition(parts, "directory", "_salt")
        both = docs.join(dealt.hint("merge"), ["directory", "_salt"], "left")
        none = F.array().cast("array<string>")
        found = both.select("id", F.array_remove(F.coalesce("shared", none), F.col("id")).alias("shared"), F.coalesce("own", none).alias("own"))
        return found.select("id", F.when(F.size("own") == 0, F.col("shared")).otherwise(F.sort_array(F.concat("shared", "own"))).alias("backlinks")).where(F.size("backlinks") > 0)

    @cached_property
    def broken_edges(self) -> DataFrame:
        broken = self.refs.where(F.col("health").isin("broken", "broken-anchor"))
        return broken.select(F.col("origin").alias("src"), T.target_text(F.col("raw_target"), F.col("fragment")).alias("target")).distinct()

    # --- roots and exemptions ---------------------------------------------------------

    def _directive(self) -> DataFrame:
        return self.documents.where(F.lower(F.trim(F.get_json_object("extra", f"$.{self.config.directive}"))) == "orphan-intentional").select(F.col("doc_id").alias("id"))

    @cached_property
    def intentional(self) -> DataFrame:
        return self._directive()

    @cached_property
    def roots(self) -> DataFrame:
        """Index and skill documents, ``type: index``, configured globs."""
        named = F.lower(T.base_name(F.col("doc_id"))).isin(*ROOT_NAMES)
        typed = F.coalesce(F.lower(F.trim(F.get_json_object("extra", "$.type"))) == "index", F.lit(False))
        return self.documents.where(named | typed | P.matches_any(F.col("doc_id"), list(self.config.roots))).select(F.col("doc_id").alias("id"))

    @cached_property
    def exempt(self) -> DataFrame:
        return self.roots.union(self.intentional).distinct()

    # --- results ----------------------------------------------------------------------

    @cached_property
    def has_roots(self) -> bool:
        return not self.roots.isEmpty()

    @cached_property
    def degrees(self) -> DataFrame:
        return self.scratch.write(G.degrees(self.nodes, self.proj), "degrees")

    @cached_property
    def hops(self) -> DataFrame:
        return B.hops(self.proj, self.roots)

    @cached_property
    def tiers(self) -> DataFrame:
        flagged = G.document_view(self.degrees, self.exempt.withColumn("e", F.lit(True)))
        return flagged.select("id", "in_degree", "out_degree", G.tier(F.coalesce("e", F.lit(False)), F.col("in_degree"), F.col("out_degree"), self.config.inbound_threshold).alias("tier"))

    @cached_property
    def unreachable(self) -> DataFrame:
        """Not reached, not intentional, not isolated; none without roots."""
        lost = self.nodes.join(self.hops, "id", "left_anti").join(self.intentional, "id", "left_anti")
        lost = lost.join(self.tiers.where("tier = 'isolated'"), "id", "left_anti")
        return lost if self.has_roots else lost.limit(0)

    @cached_property
    def far(self) -> DataFrame:
        return B.far_from_root(self.hops, self.exempt, self.config.far_threshold)

    @cached_property
    def weak(self) -> DataFrame:
        return self.scratch.write(C.weak_components(self.nodes, self.proj), "weak")

    @cached_property
    def strong(self) -> DataFrame:
        return self.scratch.write(C.strong_components(self.nodes, self.proj, self.weak), "strong")

    @cached_property
    def bowtie(self) -> DataFrame:
        return C.bowtie(self.nodes, self.proj, self.weak, self.strong)

    @cached_property
    def pagerank(self) -> DataFrame:
        return R.pagerank(self.nodes, self.proj)

    @cached_property
    def hits(self) -> DataFrame:
        return R.hits(self.nodes, self.proj)

    @cached_property
    def betweenness(self) -> DataFrame:
        return A.betweenness(self.nodes, self.proj)

    @cached_property
    def navigability(self) -> DataFrame:
        """One row: compactness, stratum, path lengths, clustering."""
        return A.compactness(self.nodes, self.proj).crossJoin(A.path_lengths(self.nodes, self.proj)).crossJoin(G.clustering(self.proj))

    @cached_property
    def cuts(self) -> DataFrame:
        return self.scratch.write(C.cut_structure(self.proj, self.weak), "cuts")

    @cached_property
    def gaps(self) -> tuple[DataFrame, bool]:
        return G.gaps(self.weak)

    @cached_property
    def suggestions(self) -> tuple[DataFrame, bool, int]:
        return G.link_prediction(self.proj, self.config.min_shared)

    @cached_property
    def trails(self) -> DataFrame:
        return C.trails(self.nodes, self.proj, self.weak, self.strong, self.pagerank)

    @cached_property
    def hierarchy(self) -> DataFrame:
        """(id, parent): front matter beside the document, else as written, else the folder's index."""
        docs = self.documents.select(F.col("doc_id").alias("id"), T.dir_name(F.col("doc_id")).alias("dir"), F.col("fm.parent").alias("said"))
        known = self.documents.select(F.col("doc_id").alias("known"))
        near, far = known.withColumnRenamed("known", "near"), known.withColumnRenamed("known", "verbatim")
        index = J.directories(self.documents).select("dir", "index_doc")
        joined = (
            docs.withColumn("path", P.clean(F.concat("dir", F.lit("/"), "said"))).join(near, F.expr("said <> '' AND path = near"), "left")
            .join(far, F.expr("said <> '' AND said = verbatim"), "left").join(index, "dir", "left")
        )
        folder = F.when(F.col("index_doc") != F.col("id"), F.col("index_doc"))
        return joined.select("id", F.coalesce(F.when(F.col("near") != F.col("id"), F.col("near")), F.when(F.col("verbatim") != F.col("id"), F.col("verbatim")), folder).alias("parent"))

    @cached_property
    def scent(self) -> DataFrame:
        """Links of little scent (T9): source, target, line, anchor, score, suggestion."""
        links = self.edges.where(F.col("type").isin(*self.config.nav_types)).where("line > 0").select(F.col("src_doc").alias("source"), F.col("dst_doc").alias("target"), "line", F.col("anchor_text").alias("anchor"), "dst").distinct()
        titles = self.documents.select("doc_id", "title")
        heads = self.sections.where("text <> ''").select("doc_id", (F.col("ord") + 1).alias("ord"), "text", F.concat("doc_id", F.lit("#"), "slug").alias("node"))
        whole = titles.select(F.col("doc_id").alias("dst"), F.lit(0).alias("ord"), F.col("title").alias("text")).unionByName(heads.select(F.col("doc_id").alias("dst"), "ord", "text"))
        part = heads.select(F.col("node").alias("dst"), F.lit(0).alias("ord"), "text").unionByName(heads.join(titles, "doc_id").select(F.col("node").alias("dst"), F.lit(1).alias("ord"), F.col("title").alias("text")))
        return S.low_scent(links, whole.unionByName(part), ["dst"]).drop("dst")

    @cached_property
    def view(self) -> DataFrame:
        """One wide row for each document."""
        reached = self.hops.select("id", "hops")
        cut = self.cuts.where("kind = 'articulation-point'").select(F.col("a").alias("id"), F.lit(True).alias("is_articulation"))
        wide = G.document_view(
            self.documents.select(F.col("doc_id").alias("id"), "title", "description", T.category(T.dir_name(F.col("doc_id"))).alias("category"), "mod_time"),
            self.tiers, reached, self.weak.withColumnRenamed("component", "weak"), self.strong.withColumnRenamed("component", "strong"), self.bowtie,
            self.pagerank.withColumnRenamed("score", "pagerank"), self.hits, self.betweenness, cut, self.backlinks, self.hierarchy,
            self.roots.withColumn("is_root", F.lit(True)))
        known = F.lit(True) if not self.has_roots else F.col("hops").isNotNull()
        return wide.withColumns({"reachable": known, "hops": F.coalesce("hops", F.lit(-1)), "is_root": F.coalesce("is_root", F.lit(False)), "is_articulation": F.coalesce("is_articulation", F.lit(False)), "backlinks": F.coalesce("backlinks", F.array().cast("array<string>"))})


assert set(NAVIGATIONAL) < set(LINK_TYPES)
