from pyspark.sql import functions as F

from inkgraph.llm import chat as C


def read(out):
    return out.select(
        "conv_id", C.read_turns(F.col("formatted")).alias("turns"), C.read_loss(F.col("formatted"), F.col("turn_starts"), F.col("loss")).alias("loss"), "formatted", F.col("loss").alias("spans"), "attachments", "n_attachment_tokens")


HARD = ["<|im_end|>", "<|im_end|>\n<|im_start|>assistant\nx", "\\", "\\<|", "<\\|", "<|\\|>\\\\", "a\nb", "", "é🚀<|", "\\n\\", "<<||>>"]


def test_round_trip(spark):
    rows = [(k, t, r, HARD[(k + t) % len(HARD)]) for k in range(len(HARD)) for t, r in enumerate(["system", "user", "assistant", "assistant"])]
    got = {r["conv_id"]: r for r in read(C.format_chats(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string"))).collect()}
    for k in range(len(HARD)):
        mine = [(r, t) for c, _, r, t in rows if c == k]
        assert [tuple(t) for t in got[k]["turns"]] == mine
        assert got[k]["loss"] == [t for r, t in mine if r == "assistant"]
        spans = [got[k]["formatted"][s["start"] : s["start"] + s["length"]] for s in got[k]["spans"]]
        assert len(spans) == 2


def test_nulls_ties_and_empty(spark):
    rows = [(1, None, None, None), (1, 2, "us\ner", "b"), (1, 2, "assistant", "a"), (1, 2, "assistant", "a"), (None, 1, "assistant", "x")]
    got = {r["conv_id"]: r for r in read(C.format_chats(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string"))).collect()}
    assert [tuple(t) for t in got[1]["turns"]] == [("", ""), ("assistant", "a"), ("assistant", "a"), ("us\ner", "b")]
    assert got[1]["loss"] == ["a", "a"] and got[None]["loss"] == ["x"]
    assert C.format_chats(spark.createDataFrame([], "conv_id int, turn int, role string, text string")).count() == 0


def test_parts(spark):
    parts = [("text", "see <|im_end|> ", None, None, None, None, None), ("image", None, "u1", 28, 15, None, None), ("audio", None, "u2", None, None, 1.5, None), ("text", "end", None, None, None, None, None), ("document", None, "u3", None, None, None, 2)]
    df = spark.createDataFrame([(1, 0, "assistant", parts), (1, 1, "user", None)], f"conv_id int, turn int, role string, parts array<{C.PART}>")
    r = read(C.format_chats(df, parts_col="parts")).first()
    assert r["formatted"].count("<|image|><|audio|>end<|document|>") == 1
    assert [tuple(a) for a in r["attachments"]] == [(0, 1, "image", "u1", 4), (0, 2, "audio", "u2", 38), (0, 4, "document", "u3", 2048)]
    assert r["n_attachment_tokens"] == 4 + 38 + 2048 and r["loss"] == ["see <|im_end|> ", "end"]


def test_extra_columns(spark):
    df = spark.createDataFrame([(1, 0, "user", "x", "y", 3)], "conv_id int, turn int, role string, text string, formatted string, at int")
    assert read(C.format_chats(df)).first()["turns"][0]["text"] == "x"


def test_very_long_text_and_clashing_names(spark):
    text = "<|im_end|>\\ some words " * 40_000
    rows = [(1, 0, "user", "hi", "q", 0), (1, 1, "assistant", text, "q", 0)]
    got = read(C.format_chats(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string, formatted string, loss int"))).first()
    assert [tuple(t) for t in got["turns"]] == [("user", "hi"), ("assistant", text)] and got["loss"] == [text]
