import pytest

from inkgraph.functions.paths import glob_regex, ignore_rules, is_ignored
from inkgraph.sources import config
from inkgraph.sources import markdown as M


def refs(text):
    return [(r["type"], r["raw_target"], r["fragment"], r["line"]) for r in M.parse("t.md", text.encode())["refs"]]


@pytest.mark.parametrize(("heading", "slug"), [
    ("Getting Started", "getting-started"), ("Hello, World!", "hello-world"), ("Cats & Dogs", "cats--dogs"), ("Café Crème", "caf-crme"), ("🚀 Launch Day", "-launch-day"), ("[x](guide.md)", "xguidemd"), ("!!!", "heading"), ("`credential_store`", "credential_store"), ("snake_case", "snake-case"),
])
def test_slug(heading, slug):
    assert M.parse("t.md", f"# {heading}\n".encode())["sections"][0]["slug"] == slug


def test_repeated_slugs():
    found = [s["slug"] for s in M.parse("t.md", b"# Dup\n## Dup\n### Dup\n# `a_b`\n# `a_b`\n# Own {#my-id}\n# Mdx {/* #other */}\n")["sections"]]
    assert found == ["dup", "dup-1", "dup-2", "a_b", "a_b-1", "my-id", "other"]


def test_references():
    text = "# Title\n\nA [relative](other.md) link.\nAn [anchored](other.md#sec) link.\nA [same-page](#title) anchor.\nAn [external](https://example.com) link.\nAn ![image](img/pic.png) embed.\nAn autolink <https://auto.example>.\n"
    assert refs(text) == [("relative-link", "other.md", "", 3), ("relative-link", "other.md", "sec", 4), ("anchor", "", "title", 5), ("external", "https://example.com", "", 6), ("image-embed", "img/pic.png", "", 7), ("external", "https://auto.example", "", 8)]


@pytest.mark.parametrize(("text", "want"), [
    ("x [[guide]] y", ("wikilink", "guide", "")), ("[[docs/guide]]", ("wikilink", "docs/guide", "")), ("[[guide|the guide]]", ("wikilink", "guide", "")), ("[[guide#setup|See]]", ("wikilink", "guide", "setup")),
    ("![[guide#setup]]", ("transclusion", "guide", "setup")), ("[[#self]]", ("anchor", "", "self")), ("[[  guide  #  setup  ]]", ("wikilink", "guide", "setup")),
    ("[a [b] c](x.md)", ("relative-link", "x.md", "")), ("[t][ref]\n\n[ref]: y.md", ("relative-link", "y.md", "")), ("[ref]\n\n[ref]: <z z.md> 'title'", ("relative-link", "z z.md", "")), ("[t](p(1).md \"x\")", ("relative-link", "p(1).md", "")),
    ("///host/p is text, [p](///host/p)", ("external", "///host/p", "")), ("[f](FILE://x)", ("external", "FILE://x", "")), ("[r](/root.md)", ("relative-link", "/root.md", "")), ("- item [in list](l.md)", ("relative-link", "l.md", "")), ("> quote [in](q.md)", ("relative-link", "q.md", "")),
])
def test_one_reference(text, want):
    assert [r[:3] for r in refs("# H\n\n" + text + "\n")] == [want]


@pytest.mark.parametrize("text", ["[[", "[[]]", "[[a|", "[single]", "text [[ more", "[[|display]]", "a ] b [[ c", "[[guide\nstuff]]", "`[code](x.md)`", "```\n[f](x.md)\n```", "    [i](x.md)", "\\[e](x.md)", "<!-- [c](x.md) -->", "~~~\n[[x]]\n```\n~~~"])
def test_no_reference(text):
    assert refs("# H\n\n" + text + "\n") == []


def test_image_in_link_and_anchor_text():
    row = M.parse("t.md", b"[![alt *text*](i.png) more](page.md)\n\n[[t|the alias]]\n")
    assert [(r["type"], r["raw_target"], r["anchor_text"]) for r in row["refs"]] == [("relative-link", "page.md", "alt text more"), ("image-embed", "i.png", "alt text"), ("wikilink", "t", "the alias")]


def test_sections():
    row = M.parse("t.md", b"---\ntitle: T\n---\n# A\n\n## B\ntext\n\nSet\next\n===\n## C #\n")
    assert [(s["text"], s["level"], s["parent_ord"], s["start_line"], s["end_line"]) for s in row["sections"]] == [("A", 1, -1, 4, 8), ("B", 2, 0, 6, 8), ("Set\next", 1, -1, 9, 12), ("C", 2, 2, 12, 12)]
    assert row["title"] == "T"


@pytest.mark.parametrize(("text", "present", "parsed", "title"), [
    ("---\ntitle: T\nTags: x\nextra: [1, {a: 2}]\n---\n# B\n", True, True, "T"), ("+++\ntitle = 'T'\n+++\n", True, True, "T"), ("+++\ntitle = \"open\nbad ==== v\n+++\n\n# Back\n", True, False, "Back"),
    ("---\n: [\n---\n# Back\n", True, False, "Back"), ("---\nno end\n", False, False, "t.md"), ("# Only\n", False, False, "Only"), ("", False, False, "t.md"), ("---\n" + "a: b\n" * 20000 + "---\n# Big\n", True, False, "Big"), ("---\n---\n", True, True, "t.md"),
])
def test_front_matter(text, present, parsed, title):
    row = M.parse("t.md", text.encode())
    assert (row["fm_present"], row["fm_parsed"], row["title"]) == (present, parsed, title)


def test_front_matter_values():
    row = M.parse("t.md", b"---\naliases: home\nname: foo\nrelated: [a.md, 3]\ndate: 2024-01-02\nstatus: true\nType: index\n---\n")
    assert row["fm"]["aliases"] == ["home"] and row["fm"]["related"] == ["a.md", "3"] and row["fm"]["date"] == "2024-01-02" and row["fm"]["status"] == "true" and row["extra"] == '{"Type": "index"}'


def test_component_anchors():
    text = '<Heading id="one">\n\n```\n<Heading id="no">\n```\n<!--\n<Heading id="no">\n-->\n    <Heading id="no">\n<Heading as={x}\n  id=\'two\'>\n<Heading id={v}>\n<Heading id="a" id="b">\ntext <Heading id="no">\n'
    assert M.parse("t.md", text.encode())["anchors"] == ["one", "two"]


def test_globs():
    import re

    table = [("*.md", "a.md", True), ("*.md", "d/a.md", False), ("d/?.md", "d/a.md", True), ("[a-c]x", "bx", True), ("[^a-c]x", "bx", False), ("\\*", "*", True), ("[]", None, None), ("a[", None, None), ("[a-]", None, None)]
    for glob, path, want in table:
        found = glob_regex(glob)
        assert (found is None) if path is None else bool(re.search(found, path)) is want, glob


def test_ignore_rules():
    rules = ignore_rules(["# note", "draft-*.md", "!draft-keep.md", "build/", "/top.md", "a/**/z.md", "**/deep.md", "\\#lit.md", "x[0-9].md", "  "])
    table = {"draft-a.md": True, "d/draft-a.md": True, "draft-keep.md": False, "build/x.md": True, "d/build/x.md": True, "build.md": False, "top.md": True, "d/top.md": False, "a/z.md": True, "a/b/c/z.md": True, "q/deep.md": True, "#lit.md": True, "x1.md": True, "xx.md": False}
    assert {p: is_ignored(p, rules) for p in table} == table


def test_config():
    assert config.decode("version: 1\nroots: ['docs/*.md']\ninboundThreshold: 2\n") == ({"roots": ("docs/*.md",), "inbound_threshold": 2}, [])
    assert config.decode("") == ({}, []) and len(config.decode("okf: true\nnope: 1\n")[1]) == 2
    for bad in ("version: 0", "version: 2", "version: one", "version: true", "roots: x", "version: [", "- a", "text", "version: 1\ninboundThreshold: -1", "version: 1\nstructureFindingsSeverity: loud", "version: 1\nroots: [1]", "a: &a [x]\nb: [" + "*a, " * 2000 + "]"):
        with pytest.raises(config.ConfigError):
            config.decode(bad)


COMPONENTS = [
    ('<Heading id="a">x</Heading>', ["a"]), ("   <Heading level={2} id='b' />", ["b"]), ("    <Heading id='no'/>", []), ("\t<Heading id='no'/>", []), ("text <Heading id='no'/>", []), ("<Headings id='no'>", []),
    ("<Heading id={no}>", []), ("<Heading id>", []), ("<Heading id=''>", []), ("<Heading id=' x'>", []), ("<Heading id='a' id='b'>", []), ("<Heading\n  style={{a: {b: 1}}}\n  id='deep'\n>", ["deep"]), ("<Heading style={{a: 1}\n} id='no'>", []),
    ("<Heading data-id='x' id='y'>", ["y"]), ("```\n<Heading id='no'>\n```\n<Heading id='yes'>", ["yes"]), ("<!--\n<Heading id='no'>\n-->\n<Heading id='yes'>", ["yes"]), ("<!-- a --> <!--\n<Heading id='no'>\n-->", []),
    ("{/*\n<Heading id='no'>\n*/}\n<Heading id='yes'>", ["yes"]), ("{/* one */} text\n<Heading id='yes'>", ["yes"]), ("a `code\n<Heading id='no'>\nend` b\n<Heading id='yes'>", ["yes"]), ("a ``x` y``\n<Heading id='yes'>", ["yes"]),
    ("export const a = 'open\n<Heading id='no'>\n", []), ("it's prose\n<Heading id='yes'>", ["yes"]), ("const a = 'it\\'s'\n<Heading id='yes'>", ["yes"]), ("<Heading id='a'> <!--\n<Heading id='no'>\n-->", ["a"]),
    ("<Heading x='" + "y" * 20000 + "' id='far'>", []), ("<Heading bad=1 id='no'>\n<Heading id='yes'>", ["yes"]), ("<Heading title='a<b' id='no'>", []), ("~~~\n```\n<Heading id='no'>\n~~~", []),
]


def test_component_anchors():
    for text, ids in COMPONENTS:
        assert M.literal_anchors(text.split("\n")) == ids, text
