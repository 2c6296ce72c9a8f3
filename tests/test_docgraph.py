import json
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from inkgraph import cli
from inkgraph.api import Queries, UnknownDocument
from inkgraph.docgraph import DocGraph
from inkgraph.functions import text as T
from inkgraph.model import Config
from inkgraph.operators import conformance, external
from inkgraph.operators import findings as N
from inkgraph.operators import resolve as J
from inkgraph.sinks import render
from inkgraph.sources import scan

TREE = {
    "README.md": "# Home\n\n[the guide](docs/guide.md) and [[overview]]\n![logo](assets/logo.png)\n[click here](docs/guide.md#setup)\n",
    "docs/guide.md": "---\naliases: [manual]\n---\n# User Guide\n\n## Setup\n\n[home](../README.md) [bad](nope.md) [frag](guide.md#none) [self](#setup)\n",
    "docs/overview.md": "# Overview\n\n[[manual]] [[notes]] [[missing]] [up](../../etc/passwd)\n[the decisions](adr) [ext](https://example.com/x)\n",
    "docs/adr/README.md": "# Decisions\n", "docs/adr/0001-first.md": "# First Decision\n\n[ADR 0001](0001-first.md)\n", "a/notes.md": "# Notes\n", "b/notes.md": "# Notes\n\n[lonely](../a/notes.md)\n",
    "CHANGELOG.md": "---\ninkgraph: orphan-intentional\n---\n# Changes\n", "draft-x.md": "# Draft\n", "assets/logo.png": "", "node_modules/skip.md": "# No\n", ".inkgraphignore": "draft-*.md\n",
}


def write(root, tree):
    for name, text in tree.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return str(root)


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    return write(tmp_path_factory.mktemp("docs"), TREE)


@pytest.fixture(scope="module")
def g(spark, root):
    return DocGraph.from_path(spark, root)


def health(g):
    return {(r["origin"], r["raw_target"], r["fragment"]): (r["health"], r["doc"]) for r in g.refs.collect()}


def test_resolution(g):
    found = health(g)
    assert found[("README.md", "overview", "")] == ("valid", "docs/overview.md") and found[("README.md", "assets/logo.png", "")] == ("non-note", None)
    assert found[("docs/guide.md", "nope.md", "")][0] == "broken" and found[("docs/guide.md", "guide.md", "none")] == ("broken-anchor", "docs/guide.md") and found[("docs/guide.md", "", "setup")] == ("valid", "docs/guide.md")
    assert found[("docs/overview.md", "manual", "")] == ("valid", "docs/guide.md") and found[("docs/overview.md", "notes", "")][0] == "ambiguous" and found[("docs/overview.md", "missing", "")][0] == "broken"
    assert found[("docs/overview.md", "../../etc/passwd", "")][0] == "broken" and found[("docs/overview.md", "adr", "")] == ("valid", "docs/adr/README.md") and found[("docs/overview.md", "https://example.com/x", "")][0] == "external"


def test_projection_and_strict(g, spark, root):
    edges = {tuple(r) for r in g.proj.collect()}
    assert ("docs/overview.md", "docs/adr/0001-first.md") in edges and ("docs/overview.md", "docs/adr/README.md") in edges
    strict = DocGraph.from_path(spark, root, Config(strict=True))
    assert ("docs/overview.md", "docs/adr/0001-first.md") not in {tuple(r) for r in strict.proj.collect()}
    assert {r["dst"] for r in g.edges.where("src_doc = 'README.md'").collect()} == {"docs/guide.md", "docs/guide.md#setup", "docs/overview.md"}
    assert {tuple(r) for r in g.contains.where("src LIKE 'docs/guide%'").collect()} == {("docs/guide.md", "docs/guide.md#user-guide"), ("docs/guide.md#user-guide", "docs/guide.md#setup")}


def test_findings_and_renderers(g, tmp_path):
    found = N.report(g).cache()
    kinds = {r["kind"]: r["n"] for r in found.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert kinds["broken-link"] == 3 and kinds["broken-anchor"] == 1 and kinds["ambiguous"] == 1 and kinds["low-scent-anchor"] >= 1
    assert "CHANGELOG.md" not in {r["document"] for r in found.where("kind IN ('orphan', 'unreachable')").collect()}
    scent = {(r["document"], r["details"]["anchorText"]) for r in found.where("kind = 'low-scent-anchor'").collect()}
    assert ("README.md", "click here") in scent and ("docs/adr/0001-first.md", "ADR 0001") not in scent
    out = render.bundle(g)
    graph = json.loads(out["graph.json"])
    assert len(graph["nodes"]) == 8 and graph["schemaVersion"] == 7 and {"from": "README.md", "to": "docs/guide.md", "type": "reference", "health": "valid"} in graph["edges"]
    assert len(json.loads(out["findings.json"])["findings"]) == found.count() == len(ET.fromstring(out["junit.xml"].split("\n", 1)[1]))
    assert "User Guide" in out["llms.txt"] and "## Setup" in out["llms-full.txt"] and "aliases" not in out["llms-full.txt"] and out["graph.dot"].startswith("digraph")
    render.write_all(str(tmp_path), out)
    assert (tmp_path / "graph.json").exists()
    with pytest.raises(ValueError):
        render.write_all(str(tmp_path), {"../x": ""})
    assert N.select(found, errors_only=True).count() == 4 and N.select(found, kinds=("ambiguous",)).count() == 1
    with pytest.raises(ValueError):
        N.select(found, kinds=("orphan",), everything=True)
    assert N.select(found, caps={"low-scent-anchor": 1}).where("kind = 'low-scent-anchor'").count() == 1


def test_queries(g):
    q = Queries(g)
    assert q.what_links_to("docs/guide.md") == {"document": "docs/guide.md", "backlinks": ["README.md", "docs/overview.md"], "count": 2}
    assert q.path_between("README.md", "docs/adr/README.md")["path"] == ["README.md", "docs/overview.md", "docs/adr/README.md"] and not q.path_between("a/notes.md", "README.md")["found"]
    assert q.get_section("docs/guide.md#setup")["title"] == "Setup" and q.list_orphans()["rootsIndeterminate"] is False
    with pytest.raises(UnknownDocument):
        q.what_links_to("no.md")
    assert q.suggest_links() == [] and len(q.critical_docs()["betweenness"]) == 8


def test_exit_codes():
    assert N.exit_code({}, True) == 0 and N.exit_code({"broken-link": 1}, False) == 1 and N.exit_code({"ambiguous": 1}, False) == 0 and N.exit_code({"ambiguous": 1}, True) == 1
    assert N.exit_code({"dead-end": 1}, True) == 0 and N.exit_code({"dead-end": 1}, True, "warning") == 1 and N.exit_code({}, False, conformant=False) == 1 and N.exit_code({"dead-link": 3, "knowledge-gap": 1}, True) == 0


def test_cli(spark, root, tmp_path, capsys):
    assert cli.main(["check", root, "--out", str(tmp_path / "o")], spark) == 1 and (tmp_path / "o/junit.xml").exists()
    assert cli.main(["nonsense"], spark) == 2 and cli.main(["version"], spark) == 0
    clean = write(tmp_path / "clean", {"README.md": "# A\n\n[bee page](b.md)\n", "b.md": "# Bee Page\n\n[the a](README.md)\n"})
    assert cli.main(["check", clean], spark) == 0
    capsys.readouterr()
    assert cli.main(["graph", clean, "--format", "mermaid"], spark) == 0 and capsys.readouterr().out.startswith("graph LR")


def test_scan(tmp_path):
    write(tmp_path, {"a.md": "x", "b.MDX": "x", "c.txt": "x", "sub/.git/x.md": "x", "sub/y.md": "y", ".git/z.md": "z", "big.md": "x" * 50, "out/r.md": "r", "d/e.markdown": "e"})
    (tmp_path / "link.md").symlink_to(tmp_path / "a.md")
    found = scan.list_tree(str(tmp_path), Config(max_file_bytes=20, output_dir=str(tmp_path / "out")))
    assert [f[0] for f in found.files] == ["a.md", "b.MDX", "d/e.markdown"] and sorted(n[0] for n in found.notices) == ["nested-repository", "skipped-oversize", "skipped-symlink"]
    assert [n[0] for n in scan.list_tree(str(tmp_path), Config(max_files=1)).notices].count("truncated") == 1


def test_conformance(spark, tmp_path):
    tree = {"index.md": "---\nokf_version: '0.1'\n---\n# Root\n", "ok.md": "---\ntype: note\n---\n", "none.md": "# x\n", "bad.md": "---\n: [\n---\n", "list.md": "---\ntype: [a]\n---\n", "num.md": "---\ntype: 3\n---\n", "empty.md": "---\ntype: ' '\n---\n", "map.md": "---\ntype: {a: b}\n---\n",
            "absent.md": "---\nother: x\n---\n", "log.md": "# Log\n## 2024-01-02\n## soon\n", "sub/index.md": "---\ntitle: x\n---\n", "sub/log.md": "## 2024-13-99\n", "bool.md": "---\ntype: yes\n---\n"}
    g = DocGraph.from_path(spark, write(tmp_path, tree), Config(okf=True))
    got = {r["doc_id"]: (r["rule"], r["reason"]) for r in conformance.violations(g.documents, g.sections).collect()}
    assert got == {"none.md": ("missing-frontmatter", "absent"), "bad.md": ("missing-frontmatter", "unparseable"), "list.md": ("missing-type", "type is a list"), "map.md": ("missing-type", "type is a mapping"), "num.md": ("missing-type", "type is a number"), "bool.md": ("missing-type", "type is a boolean"),
                   "empty.md": ("missing-type", "type is empty"), "absent.md": ("missing-type", "no type"), "log.md": ("reserved-structure", "heading is no date: soon"), "sub/index.md": ("reserved-structure", "front matter in an index below the root")}
    assert conformance.version(g.documents) == "0.1" and N.conformance_findings(g).count() == len(got)


@pytest.mark.parametrize(("policy", "want"), [("exact", {"guide": "valid", "docs/guide": "broken", "b/x.md": "valid", "x": "broken"}), ("longest-suffix", {"guide": "ambiguous", "docs/guide": "valid", "b/x.md": "ambiguous", "x": "ambiguous"}), ("basename", {"guide": "ambiguous", "docs/guide": "ambiguous", "b/x.md": "ambiguous", "x": "ambiguous"})])
def test_policies(spark, policy, want):
    docs = spark.createDataFrame([("guide.md",), ("a/docs/guide.md",), ("b/x.md",), ("a/b/x.md",)], "doc_id string")
    refs = spark.createDataFrame([(k, t) for k, t in enumerate(want)], "ref int, target string")
    got = J.wikilinks(refs, docs, spark.createDataFrame([], "alias string, doc_id string"), policy)
    assert {r["target"]: r["health"] for r in got.join(refs, "ref").collect()} == want


def test_scent_functions(spark):
    df = spark.createDataFrame([("guide.md § Setup Steps", "docs/guide.md"), ("other § Setup", "docs/guide.md"), ("§ Top", "x.md"), ("`code`", "x.md"), ("ADR 0010", "adr/0010-choice.md"), ("adr/0010-choice.md", "adr/0010-choice.md"), ("Read  More", "x.md"), ("é the Über-Guide", "x.md")], "a string, t string")
    got = df.select(T.effective_anchor(F.col("a"), F.col("t")), T.is_code_label(F.col("a")), T.names_identifier(F.col("a"), F.col("t")), T.is_scent_free(F.col("a")), T.tokens(F.col("a"))).collect()
    assert [r[0] for r in got[:3]] == ["Setup Steps", "other § Setup", "Top"] and [r[1] for r in got].count(True) == 1 and [r[2] for r in got] == [False] * 4 + [True] + [False] * 3
    assert got[6][3] and not got[7][3] and got[7][4] == ["guide", "é", "über"]


def test_external_guard():
    names = {"ok.example": ["93.184.216.34"], "in.example": ["10.0.0.1"], "mix.example": ["93.184.216.34", "127.0.0.1"], "six.example": ["::ffff:127.0.0.1"], "nat.example": ["100.64.0.1"]}
    ok = lambda u, **k: external.allowed(u, names.__getitem__, **k)
    assert ok("https://ok.example/x") and not any(ok(f"https://{h}/") for h in ("in.example", "mix.example", "six.example", "nat.example")) and not ok("ftp://ok.example/") and not ok("https://ok.example", deny=("example",)) and not ok("https://ok.example", allow=("other",))
    answers = {("a", "HEAD"): (405, None), ("a", "GET"): (200, None), ("r", "HEAD"): (302, "a"), ("loop", "HEAD"): (301, "loop"), ("gone", "HEAD"): (404, None)}
    get = lambda u, m: answers[(u, m)]
    assert [external.ask(u, get, lambda _: True)[0] for u in ("a", "r", "loop", "gone")] == [True, True, False, False] and external.ask("a", get, lambda _: False) == (False, None, True)


def test_stream(spark, tmp_path):
    from inkgraph.streaming.watch import watch_edges

    seen = []
    for batch in ([("a", "b"), ("a", "a")], [("b", "c"), ("a", "b")]):
        spark.createDataFrame(batch, "src string, dst string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        watch_edges(spark, str(tmp_path / "in"), str(tmp_path / "table"), str(tmp_path / "check"), lambda proj, k: seen.append(proj.count())).awaitTermination()
    assert seen == [1, 2]


def test_manifest_tells_what_its_lists_hold(g):
    graph = json.loads(render.graph_json(render.View(g)))
    assert list(graph)[:5] == ["schemaVersion", "tool", "generatedNote", "summary", "nodes"]
    assert set(graph["nodes"][0]) == {
        "id", "kind", "title", "path", "description", "category", "inDegree", "outDegree", "component", "hubScore", "authorityScore", "reachable", "orphan", "intentionalOrphan", "underLinked", "deadEnd", "bowtie", "betweenness",
        "isArticulation", "pageRank", "hopsFromRoot"}
    said = graph["summary"]
    for key, rows in (("documents", "nodes"), ("edges", "edges"), ("orphans", "orphans"), ("unreachable", "unreachable"), ("brokenLinks", "brokenLinks"), ("brokenAnchors", "brokenAnchors"), ("ambiguous", "ambiguous"), ("bridges", "bridges")):
        assert said[key] == len(graph[rows]), key
    assert said["brokenLinks"] == 3 and graph["brokenAnchors"][0]["expectedSlug"] == "none" and graph["ambiguous"][0]["candidates"] == ["a/notes.md", "b/notes.md"]
    assert graph["rootSet"] == ["README.md", "docs/adr/README.md"] and graph["reachability"] == {"indeterminate": False}
    assert sum(graph["bowtie"][k] for k in ("core", "in", "out", "tendril", "disconnected")) == said["documents"]


def test_notices(spark, tmp_path):
    lone = write(tmp_path / "lone", {f"d{k}.md": f"# Doc {k}\n" for k in range(11)})
    told = [detail for _, _, detail in DocGraph.from_path(spark, lone, Config(roots=("[x",))).analysis_notices()]
    assert any("no roots" in x for x in told) and any("malformed" in x for x in told) and any("compactness is 0.000" in x for x in told)


def test_serve(g):
    import io

    from inkgraph.serve import serve

    asked = [{"method": "initialize", "id": 1}, {"method": "notifications/initialized"}, {"method": "tools/list", "id": 2}, {"method": "tools/call", "id": 3, "params": {"name": "what-links-to", "arguments": {"document": "docs/guide.md"}}},
             {"method": "tools/call", "id": 4, "params": {"name": "what-links-to", "arguments": {"document": "no.md"}}}, {"method": "tools/call", "id": 5, "params": {"name": "path-between", "arguments": {"from": "README.md"}}}, {"method": "x", "id": 6}]
    out = io.StringIO()
    serve(Queries(g), io.StringIO("\n".join([*map(json.dumps, asked), "no json", ""])), out)
    said = {r["id"]: r for r in map(json.loads, out.getvalue().splitlines())}
    assert set(said) == {1, 2, 3, 4, 5, 6, None} and len(said[2]["result"]["tools"]) == 7
    assert json.loads(said[3]["result"]["content"][0]["text"])["backlinks"] == ["README.md", "docs/overview.md"] and said[4]["result"]["isError"]
    assert said[5]["error"]["code"] == -32602 and said[6]["error"]["code"] == -32601 and said[None]["error"]["code"] == -32700


def test_summary_is_the_default_verb(spark, root, capsys):
    assert cli.main([root, "--color", "never"], spark) == 0
    assert "broken-link" in capsys.readouterr().out
