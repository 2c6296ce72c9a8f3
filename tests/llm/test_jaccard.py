import random
import re

import numpy as np
import pytest

from inkgraph.llm import jaccard as J

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sets_of(rows, width):
    out = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        out.append({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    return out


def brute(rows, width, percent):
    sets, chief = sets_of(rows, width), list(range(len(rows)))

    def root(k):
        while chief[k] != k:
            k = chief[k]
        return k

    for i, x in enumerate(sets):
        for j in range(i):
            if x and sets[j] and 100 * len(x & sets[j]) >= percent * len(x | sets[j]):
                chief[root(i)] = root(j)
    groups = {}
    for k in range(len(rows)):
        groups.setdefault(root(k), []).append(rows[k][0])
    return sorted((rows[k][0], len(sets[k]), min(groups[root(k)])) for k in range(len(rows)))


def noisy(r, base, edits):
    w = base.split()
    for _ in range(edits):
        w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
    return " ".join(w)


def corpus(seed):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(40)]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    passage, rows = text(30), []
    for size in (12, 30, 60, 120, 300):
        base = text(size)
        rows += [noisy(r, base, e) for e in (0, 0, 1, 1, 2, 3, 4, 6)] + [base.upper(), base + " x", "y " + base]
    rows += [passage + " " + text(r.randrange(5, 40)) for _ in range(60)] + [text(r.randrange(1, 12)) for _ in range(40)] + [None, "", " ", "a", "A", "a b", "a b c"]
    hub = text(100)
    rows += [noisy(r, hub, 1) for _ in range(50)]
    ids = list(range(len(rows)))
    r.shuffle(ids)
    return list(zip(ids, rows, strict=True))


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80)])
@pytest.mark.parametrize("frequent", [2, 16])
def test_matches_brute_force(spark, monkeypatch, width, percent, frequent):
    monkeypatch.setattr(J, "MIN_FREQUENT", frequent)
    monkeypatch.setattr(J, "BLOCK", 16)
    rows = corpus(width * frequent)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, J.jaccard_components(df, width=width, percent=percent).collect())) == brute(rows, width, percent)


def test_signatures_meet():
    """Similar sets share a signature, whatever tokens are frequent."""
    r = np.random.default_rng(8)
    for percent in (80, 90):
        for n in (2, 5, 9, 10, 33, 64, 200):
            for share in (0.0, 0.3, 0.9, 1.0):
                universe = np.unique(r.integers(1, 2**63, 3 * n, dtype=np.uint64))
                common = set(universe[r.random(len(universe)) < share].tolist())
                x = r.choice(universe, n, replace=False)
                for gone in range(n):
                    y = np.concatenate((x[gone:], r.choice(np.setdiff1d(universe, x), min(gone, n), replace=False)))
                    if 100 * (n - gone) < percent * len(np.union1d(x, y)):
                        break
                    a, b = (np.sort(s) for s in (x, y))
                    if np.array_equal(a, b):
                        continue
                    found = [J.signatures(s, np.array([t in common for t in s.tolist()], bool), percent) for s in (a, b)]
                    sigs = [{(k, v) for k, part in enumerate(x[:2]) for v in part.tolist()} for x in found]
                    assert len(sigs[0] & sigs[1]) >= min(x[2] for x in found), (percent, n, share, gone)


def test_bounds_hold():
    r = np.random.default_rng(9)
    for n in (1, 20, 500, 30_000):
        x = np.unique(r.integers(1, 2**63, n, dtype=np.uint64))
        y = np.unique(np.concatenate((x[: n // 2], r.integers(1, 2**63, n, dtype=np.uint64))))
        both, true = np.union1d(x, y), len(np.intersect1d(x, y))
        for cells in (J.coarse(90), J.coarse(80), J.FINE):
            tables = J._by_width([J.sketch(x, cells), J.sketch(y, cells)])
            width = min(tables)
            left, right = (J._folded(np.frombuffer(J.sketch(s, cells), np.uint64)[None], width) for s in (x, y))
            percent = 100 * true // len(both)
            may, bound = J.may_link(left, right, np.array([len(x)]), np.array([len(y)]), percent)
            assert may[0] and bound[0] >= true / len(both)


def test_similar_sizes_are_at_most_a_band_apart():
    for percent in (50, 80, 90, 99):
        width = np.log(100 / percent) * 1.001
        n = np.arange(1, 5000)
        least = -(-percent * n // 100)
        assert (np.floor(np.log(n) / width) - np.floor(np.log(least) / width) <= 1).all()


def test_close_pairs_are_all_there():
    r = np.random.default_rng(10)
    sets = []
    for size in (3, 40, 63, 64, 65, 130, 700):
        base = r.integers(1, 2**63, size, dtype=np.uint64)
        sets += [np.unique(np.concatenate((base[k:], r.integers(1, 2**63, k, dtype=np.uint64)))) for k in range(max(2, size // 6))]
    n, component = np.array([len(s) for s in sets]), np.arange(len(sets)) // 2
    got = {tuple(sorted(p)) for left, right, _ in J.close_pairs(component, n, [J.sketch(s, J.FINE) for s in sets], 80) for p in zip(left.tolist(), right.tolist(), strict=True)}
    for i in range(len(sets)):
        for j in range(i):
            shared = len(np.intersect1d(sets[i], sets[j]))
            if component[i] != component[j] and 100 * shared >= 80 * (n[i] + n[j] - shared):
                assert (j, i) in got
    assert all(component[i] != component[j] for i, j in got)


def test_output_is_linear():
    """A spanning forest has fewer pairs than components, the limited rounds no more than ``limit`` a member of the smaller."""
    n, component = 300, np.arange(300) // 3
    every = [np.array(x) for x in zip(*((i, j, 1 - abs(i - j) / 1000) for i in range(n) for j in range(i) if component[i] != component[j]), strict=True)]
    parts = [tuple(x[k : k + 5000] for x in every) for k in range(0, len(every[0]), 5000)]
    assert len(J.spanning(component, iter(parts))) == 99
    got = J.best_partners(component, component, iter(parts), 4, np.zeros(0, np.int64))
    assert len(got) <= 4 * n and max(np.bincount([p for p, _ in got])) == 4
    tried = np.array([min(p, q) * n + max(p, q) for p, q in got], np.int64)
    assert not set(got) & set(J.best_partners(component, component, iter(parts), 4, tried))


@pytest.mark.parametrize("partners", [1, 16])
def test_many_near_misses(spark, monkeypatch, partners):
    """Groups full of pairs just above and below the threshold, of which few are links."""
    monkeypatch.setattr(J, "PARTNERS", partners)
    monkeypatch.setattr(J, "BLOCK", 32)
    r = random.Random(31)
    base = [f"b{k}" for k in range(100)]
    rows = []
    for k in range(120):
        words = list(base)
        for at in r.sample(range(100), r.choice((1, 2, 2, 3, 3, 4))):
            words[at] = f"x{k}y{at}"
        rows.append((k, " ".join(words)))
    rows += [(1000 + k, " ".join(f"z{j}" for j in range(3000)) + " tail" * k) for k in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for width, percent in ((3, 90), (5, 80)):
        assert sorted(map(tuple, J.jaccard_components(df, width=width, percent=percent).collect())) == brute(rows, width, percent)


def test_extra_columns_and_repeats(spark):
    rows = [(1, "a b c d e f g", 5, b"x"), (1, "a b c d e f g", 5, b"x"), (2, "A B C D E F G", None, None), (None, "a b c d e f g", 1, None), (3, None, 0, b"")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_shingles long, digest binary")
    got = sorted(map(tuple, J.jaccard_components(df).collect()), key=str)
    assert got == sorted([(1, 5, 1), (1, 5, 1), (2, 5, 1), (None, 5, 1), (3, 0, 3)], key=str)


def test_unique_text_with_a_shared_id_stays(spark):
    base = " ".join(f"w{k}" for k in range(100))
    rows = [(1, base), (2, base + " z"), (2, "a text of its own that no other row has")]
    got = J.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect())) == [rows[0], rows[2]]


def test_one_of_each(spark):
    base = " ".join(f"w{k}" for k in range(100))
    rows = [(3, base, "p"), (1, base + " z", "q"), (2, "other words stand here alone", "r"), (None, base, "s"), (4, None, None), (4, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = J.one_of_each(df)
    assert got.columns == df.columns
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted([rows[1], rows[2], rows[3], rows[4], rows[5]], key=str)
    assert J.one_of_each(df.limit(0)).count() == 0
    assert J.jaccard_components(df.limit(0)).count() == 0


def test_bitmap(spark):
    at = spark.createDataFrame([(0,), (1,), (32767,), (32768,), (2**24 - 1,), (5,), (5,)], "at long")
    bits = J.bitmap(at, "at")
    probe = np.array([0, 1, 2, 5, 32766, 32767, 32768, 32769, 2**24 - 2, 2**24 - 1])
    assert J._has(bits, probe).tolist() == [True, True, False, True, False, True, True, False, False, True]


def test_very_long_texts(spark):
    words = [f"w{k}" for k in range(150_000)]
    rows = [(1, " ".join(words)), (2, " ".join(["x", *words[:-40], "y"])), (3, " ".join(words[:100_000])), (4, " ".join(words[50_000:]))]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (149_998, 1), 2: (149_960, 1), 3: (99_998, 3), 4: (99_998, 4)}
