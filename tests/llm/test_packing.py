import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from inkgraph.llm import packing as K

PATH = P.path("word_bpe_49k.json")


def test_tokens_match_library():
    with open(PATH, "rb") as f:
        mine = K.WordTokenizer(f.read())
    library, r = Tokenizer.from_file(PATH), random.Random(6)
    texts = ["", "ΑΣ Σ", "<|endoftext|> a", "don't 12 ²x\u00a0y\x85z\x1c"]
    texts += ["".join(r.choice("aAbBÉéßΣσİiı'sS tT'll’.,!?12٣²é \n\t🚀#<|>") for _ in range(r.randrange(40))) for _ in range(500)]
    texts += ["".join(chr(r.choice([r.randrange(32, 0x3000), r.randrange(0x3000, 0xD7FF), r.randrange(0x10000, 0x1FFFF)])) for _ in range(8)) for _ in range(300)]
    for t, got in zip(texts, mine.encode(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, t


@pytest.mark.parametrize("limits", [(64, 64, 64 * 64), (64, 3, 64 * 64), (64, 9, 5000), (50, 2, 2500)])
@pytest.mark.parametrize("scoring", K.SCORINGS)
def test_plan_keeps_every_capacity(limits, scoring):
    r = random.Random(str(limits))
    histogram = {}
    for _ in range(500):
        size = r.choice([1, 2, 3, 50, r.randrange(1, 51)])
        histogram[size] = histogram.get(size, 0) + 1
    plan = K.plan_packing(histogram, *limits, scoring)
    bins = {}
    for k in range(len(plan.rank)):
        last = plan.rank[k + 1] if k + 1 < len(plan.rank) and plan.length[k + 1] == plan.length[k] else histogram[int(plan.length[k])]
        for j in range(last - plan.rank[k]):
            bins.setdefault(int(plan.seq[k]) + j, []).append((int(plan.offset[k]), int(plan.length[k])))
    assert len(bins) == plan.n_sequences and sum(map(len, bins.values())) == sum(histogram.values())
    for rows in bins.values():
        at = 0
        for offset, size in sorted(rows):
            assert offset == at
            at += size
        assert at <= limits[0] and len(rows) <= limits[1] and sum(n * n for _, n in rows) <= limits[2]


def bins_of(plan, histogram):
    """The lengths in each sequence, in order of their offsets."""
    bins = {}
    for k in range(len(plan.rank)):
        last = plan.rank[k + 1] if k + 1 < len(plan.rank) and plan.length[k + 1] == plan.length[k] else histogram[int(plan.length[k])]
        for j in range(last - plan.rank[k]):
            bins.setdefault(int(plan.seq[k]) + j, []).append((int(plan.offset[k]), int(plan.length[k])))
    return {k: [n for _, n in sorted(rows)] for k, rows in bins.items()}


def one_by_one(histogram, limits, scoring):
    """Best fit, a piece at a time."""
    bins = []
    for size in sorted(histogram, reverse=True):
        ask = (size, 1, size * size)
        for _ in range(histogram[size]):
            best = None
            for k, (left, _) in enumerate(bins):
                if all(a <= b for a, b in zip(ask, left, strict=True)):
                    score = (sum(w * ((b - a) / c) ** 2 for w, a, b, c in zip(scoring.weights, ask, left, limits, strict=True)) if scoring.kind == "norm"
                             else -sum(w * (a / c) * (b / c) for w, a, b, c in zip(scoring.weights, ask, left, limits, strict=True)))
                    if best is None or score < best[0] - 1e-12:
                        best = score, k
            if best is None:
                bins.append((limits, []))
                best = 0, len(bins) - 1
            left, held = bins[best[1]]
            bins[best[1]] = tuple(b - a for a, b in zip(ask, left, strict=True)), [*held, size]
    return [held for _, held in bins]


@pytest.mark.parametrize("limits", [(64, 64, 64 * 64), (64, 5, 3000), (64, 9, 2600)])
@pytest.mark.parametrize("scoring", [*K.SCORINGS, K.Scoring("dot", (1.0, 1.0, 1.0))])
def test_plan_is_best_fit_piece_by_piece(limits, scoring):
    for seed in range(5):
        r = random.Random(seed)
        histogram = {}
        for _ in range(150):
            size = r.choice([1, 2, 7, r.randrange(1, 50)])
            histogram[size] = histogram.get(size, 0) + 1
        got = bins_of(K.plan_packing(histogram, *limits, scoring), histogram)
        assert sorted(map(tuple, got.values())) == sorted(map(tuple, one_by_one(histogram, limits, scoring)))


def test_every_part_of_the_vector_decides():
    """Plans differ when the weight of documents or of attention does, even where the tokens alone bind."""
    histogram, limits = {k: 1 + k % 5 for k in range(1, 60)}, (64, 64, 64 * 64)
    plans = {tuple(sorted(map(tuple, bins_of(K.plan_packing(histogram, *limits, K.Scoring("norm", w)), histogram).values()))) for w in ((1.0, 0.0, 0.0), (1.0, 1.0, 0.0), (1.0, 0.0, 1.0))}
    assert len(plans) == 3
    assert all(min(s.weights) > 0 for s in K.SCORINGS)


def test_piece_over_every_capacity_stands_alone():
    plan = K.plan_packing({10: 2, 3: 2}, 8, 4, 100, K.SCORINGS[0])
    assert sorted(bins_of(plan, {10: 2, 3: 2}).values()) == [[3, 3], [10], [10]]


def test_pack(spark):
    r = random.Random(7)
    rows = [(i, " ".join(f"word{r.randrange(50)}" for _ in range(r.choice([0, 1, 5, 30, 200])))) for i in range(200)] + [(None, None), (7, ""), (7, ""), (8, "x " * 5000)]
    df = spark.createDataFrame([(*x, 0, "q") for x in rows], "doc_id long, text string, length int, piece string")
    out = K.pack(df, K.share(spark, PATH), capacity=128, keep_ids=True).collect()
    library = Tokenizer.from_file(PATH)
    expected = sorted((str(i), tuple(library.encode(t or "", add_special_tokens=False).ids + [0])) for i, t in rows)
    docs, bins = {}, {}
    for p in out:
        assert p["length"] == len(p["ids"]) // 4 and p["ids_crc32"] == zlib.crc32(bytes(p["ids"]))
        bins.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
        docs.setdefault((str(p["doc_id"]), p["piece"]), []).append(p)
    total = sorted((i, sum(p["length"] for (d, _), ps in docs.items() if d == i for p in ps)) for i in {d for d, _ in docs})
    want = {}
    for i, ids in expected:
        want[i] = want.get(i, 0) + len(ids)
    assert total == sorted(want.items())
    for rows_ in bins.values():
        at = 0
        for offset, size in sorted(rows_):
            assert offset == at
            at += size
        assert at <= 128
    assert len(bins) <= 1.1 * sum(p["length"] for p in out) / 128 + 1
    assert K.pack(df.limit(0), K.share(spark, PATH)).count() == 0
