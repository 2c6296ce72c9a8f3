"""No license rule is longer than the words it is tried on."""

from re import _parser as parser

from inkgraph.llm import licenses as L

GRANTS = [
    ("licensed under the terms of the creative commons attribution non commercial share alike international public license 4 0", "cc-by-nc-sa-4.0"),
    ("licensed only under the terms of the common development and distribution public license version v1 0 or any later version", "cddl-1.0"),
    ("licensed under the terms of the creative commons attribution non commercial no derivatives international public license 4 0", "cc-by-nc-nd-4.0"),
    ("licensed under the terms of the gnu lesser general public license version 2 1 or any later version", "lgpl-2.1"),
]


def spaces(pattern):
    """The most spaces that a parsed pattern can match."""
    n = 0
    for op, a in pattern:
        op = str(op)
        if op == "LITERAL":
            n += a == 32
        elif op == "SUBPATTERN":
            n += spaces(a[3])
        elif op == "BRANCH":
            n += max(map(spaces, a[1]))
        elif op in ("MAX_REPEAT", "MIN_REPEAT"):
            n += spaces(a[2]) and spaces(a[2]) * int(a[1])
        else:
            assert op in ("ASSERT_NOT", "IN"), op
    return n


def test_reach_holds_the_longest_rule_and_a_word():
    assert max(spaces(parser.parse(pattern)) + 1 for _, pattern, *_ in L.rules()) == L.REACH - 1 > 30


def test_long_grants_keep_their_span(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(GRANTS)], "doc_id int, text string")
    for r in L.scan(df).collect():
        text, label = GRANTS[r["doc_id"]]
        d = r["detections"][0]
        assert (d["start"], d["end"], d["label"], d["priority"], d["confidence"]) == (0, len(text.split()), label, 4, 1.0)


def shortest(pattern):
    """The words of one of a parsed pattern's shortest matches."""
    out = ""
    for op, a in pattern:
        op = str(op)
        if op == "LITERAL":
            out += chr(a)
        elif op == "SUBPATTERN":
            out += shortest(a[3])
        elif op == "BRANCH":
            out += min((shortest(x) for x in a[1]), key=len)
        elif op in ("MAX_REPEAT", "MIN_REPEAT"):
            out += shortest(a[2]) * a[0]
        elif op == "IN":
            out += "x" if str(a[0][0]) == "CATEGORY" else chr(a[0][1])
    return out


def variants(pattern):
    """Matches that take each branch at the top once."""
    pattern = list(pattern)
    for k, (op, a) in enumerate(pattern):
        inner = a[3] if str(op) == "SUBPATTERN" else []
        for op2, b in inner:
            if str(op2) == "BRANCH":
                for x in b[1]:
                    yield shortest(pattern[:k]) + shortest(x) + shortest(pattern[k + 1 :])
    yield shortest(pattern)


def test_every_rule_is_found_behind_its_gate(spark):
    """Whatever a rule matches has a keyword, starts with a gate word and is detected with its span, or by a rule of at least its rank."""
    texts = [(k, t) for k, (_, pattern, *_) in enumerate(L.rules()) for t in variants(parser.parse(pattern))]
    rules = L.rules()
    for k, t in texts:
        assert t.split()[0] in rules[k][0], (rules[k], t)
        assert any(word in f" {t} " for word in L.KEYWORDS), (rules[k], t)
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id int, text string")
    for r in L.scan(df).collect():
        k, t = texts[r["doc_id"]]
        assert any(d["start"] == 0 and d["end"] == len(t.split()) and d["priority"] >= rules[k][3] for d in r["detections"]), (t, r["detections"])
