import hashlib
import random

import pyarrow as pa
import pytest

from inkgraph.llm import exact_dedup as E

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(LOWER), []).append(i)
    out = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        digest = hashlib.sha256(t.encode()).hexdigest()
        kept = False
        for i in ids:
            out.append((i, keep, len(ids), i == keep and not kept, digest))
            kept = kept or i == keep
    return sorted(out, key=str)


def run(spark, rows, counters):
    got = E.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"), counters=counters)
    return sorted((tuple(r) for r in got.collect()), key=str)


@pytest.mark.parametrize("counters", [1, 2, 1024])
def test_matches_brute_force(spark, counters):
    r = random.Random(counters)
    rows = [(i, r.choice(["a", "A", "b", "É", "é", None, "", "long " * 500, str(i), "hot", "HOT", "hot"])) for i in range(300)]
    r.shuffle(rows)
    assert run(spark, rows, counters) == brute(rows)


@pytest.mark.parametrize("counters", [1, 1024])
def test_nulls_repeats_and_empty(spark, counters):
    rows = [(5, "x"), (5, "x"), (None, "x"), (None, "alone"), (1, None), (2, "")]
    assert run(spark, rows, counters) == brute(rows)
    assert run(spark, [], counters) == []


def test_misra_gries_bound():
    r = random.Random(3)
    values = [b"hot"] * 400 + [str(r.randrange(500)).encode() for _ in range(600)]
    r.shuffle(values)
    held = E.misra_gries((pa.array(values[k : k + 97]) for k in range(0, 1000, 97)), 5)
    assert len(held) <= 5 and 400 - 1000 / 6 <= held[b"hot"] <= 430


def test_survivors_keep_columns_and_one_row(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "A", "y"), (2, "A", "y"), (3, None, None), (None, "", "q")], "doc_id long, text string, keep_id string")
    for counters in (1, 1024):
        got = E.survivors(df, counters=counters)
        assert got.columns == df.columns
        assert sorted(map(tuple, got.collect()), key=str) == [(2, "A", "y"), (3, None, None)]
    assert E.survivors(df.limit(0)).count() == 0


def test_very_long_texts_and_clashing_names(spark):
    long_ = "word " * 400_000
    rows = [(1, long_, b"d", True), (2, long_.upper(), None, None), (3, long_ + "x", b"", False)]
    df = spark.createDataFrame(rows, "doc_id long, text string, digest binary, kept boolean")
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in E.exact_dedup(df).collect()}
    assert got == {1: (2, 2, False), 2: (2, 2, True), 3: (3, 1, True)}
    left = E.survivors(df)
    assert left.schema == df.schema and sorted(r["doc_id"] for r in left.collect()) == [2, 3]
