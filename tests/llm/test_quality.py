import re

from pyspark.sql import functions as F

from inkgraph.llm import quality as Q


def brute(t):
    t = t or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    cover = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t)), len(lines), len(lines) - len(set(lines)), len(cover)


TEXTS = [None, "", " \n\t", "a", "a b c a b c", "x x x x x", "one\n\ntwo\none \none\n", "#a $b %c", "é\u00a0ü 🚀 #", "w " * 60, "a b c d " * 30 + "z", "\x0b\x0cq"]


def test_features(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id int, text string")
    got = {r["doc_id"]: tuple(r[k] for k in Q.FEATURES) for r in Q.measure(df).collect()}
    assert got == {i: brute(t) for i, t in enumerate(TEXTS)}


def test_order_changes_no_verdict(spark):
    clean = " ".join(f"word{i} other{i * 7}" for i in range(60))
    rows = [(i, t) for i, t in enumerate([*TEXTS, clean, clean + "\n" + "#### " * 40])]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    seen = set()
    for order in (Q.RULES, Q.RULES[::-1]):
        kept = df.where(Q.cascade(order, Q.from_text(F.col("text")))).select("doc_id").collect()
        seen.add(tuple(sorted(r[0] for r in kept)))
    assert seen == {(len(TEXTS),)}
    assert [r.doc_id for r in Q.keep_good(df).collect()] == [len(TEXTS)]
    assert Q.keep_good(df).columns == df.columns


def test_empty_and_clashing(spark):
    assert Q.measure(spark.createDataFrame([], "doc_id int, text string")).count() == 0
    df = spark.createDataFrame([(1, "a b", True)], "doc_id int, text string, kept boolean")
    assert Q.measure(df).first()["kept"] is False
    assert sorted(r.name for r in Q.plan_cascade(df)) == sorted(r.name for r in Q.RULES)


def test_cascade_order_is_stable(spark):
    """The costs are the rules' own: a rule that does much more work costs more, and repeated plans agree."""
    base = " ".join(f"word{i}" for i in range(400))
    df = spark.createDataFrame([(i, ("few words here" if i % 4 == 0 else "#### " * 300 if i % 4 == 1 else "same three words " * 100 if i % 4 == 2 else base) + f" {i}") for i in range(400)], "doc_id int, text string")
    cheap, dear = Q.Rule("cheap", lambda f: F.length(F.lit("x")) + f("n_symbols") < 200), Q.Rule("dear", lambda f: f("n_repeat_words") < 200)
    assert {tuple(r.name for r in Q.plan_cascade(df, rules=(dear, cheap))) for _ in range(3)} == {("cheap", "dear")}


def test_features_that_are_not_asked_for(spark):
    df = spark.createDataFrame([(1, "one line here " * 20 + "\na\na\na\na\na", "x"), (1, "one line here " * 20 + "\na\na\na\na\na", "x")], "doc_id int, text string, n_lines string")
    few = Q.measure(df, features=("n_words",)).collect()
    assert few[0].asDict().keys() == {"doc_id", "n_words", "kept"} and few[0] == few[1]
    assert few[0]["kept"] == Q.measure(df).first()["kept"]


def test_very_long_text(spark):
    text = " ".join(f"w{i % 5000}" for i in range(300_000))
    got = Q.measure(spark.createDataFrame([(1, text)], "doc_id int, text string")).first()
    assert (got["n_words"], got["n_repeat_words"]) == (300_000, 300_000)
