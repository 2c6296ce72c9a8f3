"""The pipeline, row by row, against plain Python: rules, equal texts, all pairs of shingle sets, the library's tokens."""

import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def good(t):
    ws, t = words(t), t or ""
    grams = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    seen = {g: grams.count(g) for g in set(grams)}
    repeats = len({i + k for i, g in enumerate(grams) if seen[g] > 1 for k in range(3)})
    lines = [x for x in t.split("\n") if words(x)]
    chars = sum(map(len, ws))
    return len(ws) >= 50 and 2 * repeats <= len(ws) and 10 * len(re.findall(r"[#*$%&|<>]", t)) <= len(ws) and 2.5 * len(ws) <= chars <= 12 * len(ws) and 2 * (len(lines) - len(set(lines))) <= len(lines)


def shingles(t):
    w = words(t.translate(LOWER))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def survivors(rows):
    """(id, text) after the three filtering stages."""
    rows = [r for r in rows if good(r[1])]
    last = {}
    for i, t in rows:
        key = t.translate(LOWER)
        if key not in last or (i is not None and (last[key][0] is None or i > last[key][0])):
            last[key] = (i, t)
    rows = list(last.values())
    sets, chief = [shingles(t) for _, t in rows], list(range(len(rows)))

    def root(k):
        while chief[k] != k:
            k = chief[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and sets[i]:
                chief[root(i)] = root(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    return [r for k, r in enumerate(rows) if r[0] is None or r[0] == least[root(k)]]


def planted(seed=3):
    r = random.Random(seed)
    vocabulary = [f"word{k}" for k in range(400)]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    rows = []
    for k in range(8):
        base = text(r.randrange(60, 300)).split()
        for edits in (0, 0, 1, 2, 6, 15):
            w = list(base)
            for _ in range(edits):
                w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
            rows.append(" ".join(w) if edits else " ".join(w).upper() if k % 2 else " ".join(w))
    rows += [text(20), "few words", "", None, "# " * 100 + text(60), "same three words " * 60, text(70) + "\n" + "\n".join(["a line that repeats itself"] * 9), text(12_000)]
    ids = list(range(100, 100 + len(rows)))
    r.shuffle(ids)
    return [*zip(ids, rows, strict=True), (None, text(80)), (7, text(90))]


def run(spark, tmp_path, rows):
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    return corpus_pipeline.run(spark, str(tmp_path))


def test_rows_against_plain_python(spark, tmp_path):
    rows = planted()
    out = run(spark, tmp_path, rows).collect()
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for i, t in survivors(rows):
        ids = [*library.encode(t, add_special_tokens=False).ids, 0]
        want += [(str(i), k, at, len(part := ids[at : at + 2048]), zlib.crc32(np.array(part, "<u4").tobytes())) for k, at in enumerate(range(0, len(ids), 2048))]
    assert sorted((str(p["doc_id"]), p["piece"], p["start"], p["length"], p["ids_crc32"]) for p in out) == sorted(want)
    sequences = {}
    for p in out:
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) == -(-sum(p["length"] for p in out) // 2048)


def test_stages_keep_the_columns(spark, tmp_path):
    rows = planted(4)
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], COLUMNS)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.schema == docs.schema
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.schema(docs.schema).parquet(str(tmp_path / name))
    assert sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=str) == sorted(survivors(rows), key=str)


def test_extra_and_clashing_columns(spark, tmp_path):
    rows = planted(5)
    docs = spark.createDataFrame([(i, t, b"x", 1, True, "q") for i, t in rows], "doc_id long, text string, digest binary, n_words int, kept boolean, length string")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.schema == docs.schema
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.schema(docs.schema).parquet(str(tmp_path / name))
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).select("doc_id").distinct().count() == len({i for i, _ in survivors(rows)})


@pytest.mark.parametrize("rows", [[], [(None, None)], [(1, "same text"), (1, "same text")]])
def test_nothing_left(spark, tmp_path, rows):
    out = run(spark, tmp_path, rows)
    assert out.count() == 0 and {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(out.columns)
