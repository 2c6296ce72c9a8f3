"""N-gram Jaccard self-join by token-combination prefixes, and its components.

A document is the set of its word shingles as 64-bit hashes (its tokens).  Equal sets are
one class; the join works on classes, named by a 128-bit digest of the set.

Prefixes.  Tokens are in one global order: rare ones by hash, then frequent ones by hash.
Two sets of Jaccard similarity ``t`` share all but ``n - ceil(t n)`` tokens of either one.
So a prefix in which at least ``n - ceil(t n) + 1`` tokens would have to be missing, if no
signature was shared, has to share one:

* a rare token is a signature by itself and counts 1;
* frequent tokens fall into subclasses by hash; every pair of one subclass in the prefix is a
  signature, and a subclass of ``c`` tokens counts ``c - 1``.  The prefix is extended until
  the count suffices.  The number of subclasses depends on a size band (a power of two), so
  the pairs stay in proportion to the set; sets near a band's end use both bands.

Prefixes are ``SHARED - 1`` tokens longer than that, so similar sets share ``SHARED`` signatures.
Two sets that meet in groups of two alone are a candidate only if they share as many; most
pairs that share a single token by chance end there, before anything is compared.  The same
holds where two of a larger group are the only ones of like size.

Frequent are tokens that stand in more than ``MIN_FREQUENT`` prefixes by hash alone, counted
over all documents.  They are known by a bitmap of their hashes, ``2**FREQUENT_BITS`` bits
however many there are; a token taken for frequent wrongly is so for every document, and costs
time, never a result.

Clusters.  In each signature's group all members meet one pivot (for pairs of frequent tokens,
one for each salt, and the salts' pivots meet).  Members that met the same pivot and passed a
bound are together for now, and groups of such members wait.  In the other groups, members
that are not together meet where their group is, those of like size alone (a member goes to the band of
its size and to the next), in blocks of about ``BLOCK`` rows, so that a large group is many
tasks' work; of the pairs that the bound lets pass, a block hands on a spanning forest.
The components of all these pairs are the clusters: both ends of any link are in one of them.

Links.  A cluster's members meet once, in blocks, under a finer bound.  First a block hands on
the spanning forest of the pairs with the highest bounds.  These are verified on the whole
sets, and their links are the components so far.  Then, until nothing is left, a member of the
smaller of two components hands on its best pairs that were not tried yet, ``PARTNERS`` at
first and eight times as many each time.  So no round's output grows with the square of a
group, and the loop ends only when every pair that can link two components has been verified.

The bound: a sketch holds the parities of the counts of a set's tokens by hash cell, so two sets
differ in no fewer tokens than there are cells of different parity.  The number of cells is a
power of two and, within clusters, at least ``FINE`` times the set's size; outside, 8 times the
tokens in which two similar sets of that size can differ.  The larger of two sketches folds to
the smaller.

Defined cases: a text with fewer words than a shingle has one token, its whole word sequence;
a text without words has none and no link; null texts are empty; a null id is a document
that names no component; repeated rows are in one class; an empty table gives no rows; very
long texts have long sketches and are never cut; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import BooleanType

from ..operators.components import component_of
from ..plans.lineage import Scratch
from .text import pack, pick

MIN_FREQUENT = 16
FREQUENT_BITS = 24
SHARED = 3
SALTS = 16
BLOCK = 2048
FINE = 8
PARTNERS = 16
SLICE_BYTES = 1 << 18
COUNTED = 1 << 19
BITS = 24

# --- tokens ---------------------------------------------------------------------------

_random = np.random.default_rng(20240229)
_BYTE = _random.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_STEPS = [int(x) | 1 for x in _random.integers(1, 2**63, 64, dtype=np.uint64)]
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def token_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    sizes = np.array([len(x) + 1 for x in texts], np.int64)
    data = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    space = _SPACE[data]
    edge = np.diff(np.concatenate(([True], space)).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    forward, back = _power(len(data) + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * forward[: len(data)], dtype=np.uint64)))
    words = mix((total[ends] - total[starts]) * back[starts])
    first = np.searchsorted(starts, np.concatenate(([0], np.cumsum(sizes))))  # each text's first word
    counts = np.diff(first)
    n = len(words) - width + 1
    if n > 0:
        shingles = np.zeros(n, np.uint64)
        for k in range(width):
            shingles += mix(words[k : k + n] + np.uint64(_STEPS[k])) * np.uint64(_STEPS[width + k])
        shingles = mix(shingles)
        owner = np.repeat(np.arange(len(texts)), counts)[:n]
        whole = np.arange(n) + width <= first[owner + 1]
        order = np.lexsort((shingles[whole], owner[whole]))
        shingles, owner = shingles[whole][order], owner[whole][order]
        new = np.ones(len(shingles), bool)
        new[1:] = (shingles[1:] != shingles[:-1]) | (owner[1:] != owner[:-1])
        shingles, owner = shingles[new], owner[new]
        bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    else:
        shingles, bounds = np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    out = [shingles[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    for i in np.flatnonzero((counts > 0) & (counts < width)):
        few = words[first[i] : first[i + 1]]
        value = np.array([len(few)], np.uint64)
        for k in range(len(few)):
            value = mix(value + few[k : k + 1] * np.uint64(_STEPS[40 + k % 20]))
        out[i] = value
    return out


def _slices(batch: pa.RecordBatch):
    """(row numbers, texts as bytes), about ``SLICE_BYTES`` together."""
    rows, run, size = [], [], 0
    for i, x in enumerate(batch.column("text").cast(pa.binary())):
        rows.append(i)
        run.append(x.as_py() or b"")
        size += len(run[-1])
        if size >= SLICE_BYTES:
            yield rows, run
            rows, run, size = [], [], 0
    if rows:
        yield rows, run


def _digest(tokens: np.ndarray) -> bytes | None:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest() if len(tokens) else None


def coarse(percent: int) -> float:
    """Cells a token: 8 for each token in which two sets of one size and of this similarity differ."""
    return 16 * (100 - percent) / (100 + percent)


def sketch(tokens: np.ndarray, cells: float = FINE) -> bytes:
    """The parities of the counts of tokens by hash cell, as bits; a power of two, ``cells`` a token or more, and 64 at least."""
    m = 1 << max(6, (int(np.ceil(cells * len(tokens))) - 1).bit_length())
    return np.packbits(np.bincount((tokens >> np.uint64(20)).astype(np.int64) & (m - 1), minlength=m) & 1).tobytes()


def _folded(table: np.ndarray, width: int) -> np.ndarray:
    """Sketches of fewer cells from those of more: the cells of a hash modulo half as many are two halves' parities together."""
    while table.shape[1] > width:
        half = table.shape[1] // 2
        table = table[:, :half] ^ table[:, half:]
    return table


def may_link(left: np.ndarray, right: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(whether sets of ``n`` and ``m`` tokens can be similar enough, the upper bound of their similarity), row by row, from sketches of one width."""
    differ = np.bitwise_count(left ^ right).sum(1, dtype=np.int64)
    shared = np.minimum((n + m - differ) // 2, np.minimum(n, m))
    return 100 * shared >= percent * (n + m - shared), shared / np.maximum(n + m - shared, 1)


def _by_width(cells: list[bytes]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Sketches by their width in 64-bit words: (places in ``cells``, table)."""
    widths = np.array([len(c) // 8 for c in cells])
    out = {}
    for w in sorted(set(widths.tolist())):
        at = np.flatnonzero(widths == w)
        out[w] = at, np.frombuffer(b"".join(cells[i] for i in at), np.uint64).reshape(-1, w)
    return out


def close_pairs(component: np.ndarray, size: np.ndarray, cells: list[bytes], percent: int, side: np.ndarray | None = None, guest: np.ndarray | None = None):
    """Yield (left, right, bound) of the pairs that the sketches let pass: of different components, and sides if given, but not of two guests."""
    tables = {w: (at[order := np.argsort(size[at], kind="stable")], table[order]) for w, (at, table) in _by_width(cells).items()}
    for u, (one, narrow) in tables.items():
        for w, (two, wide) in tables.items():
            if w < u or 100 * size[one[-1]] < percent * size[two[0]]:
                continue
            other = _folded(wide, u)
            step = max(1, (1 << 18) // len(two))
            for at in range(0, len(one), step):
                x = one[at : at + step]
                lo = np.searchsorted(100 * size[two], percent * size[x[0]])
                hi = np.searchsorted(percent * size[two], 100 * size[x[-1]], "right")
                y = two[lo:hi]
                ok = component[x, None] != component[y]
                ok &= 100 * np.minimum(size[x, None], size[y]) >= percent * np.maximum(size[x, None], size[y])
                if u == w:
                    ok &= np.arange(at, at + len(x))[:, None] < np.arange(lo, lo + len(y))
                if side is not None:
                    ok &= side[x, None] != side[y]
                if guest is not None:
                    ok &= ~(guest[x, None] & guest[y])
                left, right = np.nonzero(ok)
                run = max(1, (1 << 21) // u)
                for k in range(0, len(left), run):
                    p, q = left[k : k + run], right[k : k + run]
                    may, bound = may_link(narrow[at + p], other[lo + q], size[x[p]], size[y[q]], percent)
                    if may.any():
                        yield x[p[may]], y[q[may]], bound[may]


def spanning(component: np.ndarray, pairs) -> list[tuple[int, int]]:
    """The spanning forest of the components by the pairs with the highest bounds; held are a forest and one part of the pairs."""
    count = int(component.max()) + 1
    left, right, bound = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    for part in pairs:
        left, right, bound = (np.concatenate(x) for x in zip((left, right, bound), part, strict=True))
        chief, kept = list(range(count)), []
        order = np.lexsort((right, left, -bound))
        for k, a, b in zip(order.tolist(), component[left[order]].tolist(), component[right[order]].tolist(), strict=True):
            while chief[a] != a:
                chief[a] = a = chief[chief[a]]
            while chief[b] != b:
                chief[b] = b = chief[chief[b]]
            if a != b:
                chief[max(a, b)] = min(a, b)
                kept.append(k)
                if len(kept) == count - 1:
                    break
        left, right, bound = left[kept], right[kept], bound[kept]
    return list(zip(left.tolist(), right.tolist(), strict=True))


def best_partners(component: np.ndarray, rank: np.ndarray, pairs, limit: int, tried: np.ndarray) -> list[tuple[int, int]]:
    """For each member of the smaller (by ``rank``) of two components its ``limit`` best pairs that are not in ``tried`` (left * rows + right)."""
    n = len(component)
    own, other, bound = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    for left, right, b in pairs:
        new = ~np.isin(np.minimum(left, right) * n + np.maximum(left, right), tried)
        left, right, b = left[new], right[new], b[new]
        swap = rank[left] > rank[right]
        own, other, bound = np.concatenate((own, np.where(swap, right, left))), np.concatenate((other, np.where(swap, left, right))), np.concatenate((bound, b))
        order = np.lexsort((other, -bound, own))
        own, other, bound = own[order], other[order], bound[order]
        first = np.searchsorted(own, own)
        keep = np.arange(len(own)) - first < limit
        own, other, bound = own[keep], other[keep], bound[keep]
    return list(zip(own.tolist(), other.tolist(), strict=True))


def _profile(width: int, percent: int, id_type: str):
    """Rows of (id, hash, n, digest, sketch) for the texts and (token, places) for the tokens of their prefixes."""
    import pyspark.sql.types as T
    from pyspark.sql.pandas.types import to_arrow_type

    kind, cells = to_arrow_type(T._parse_datatype_string(id_type)), coarse(percent)
    names = ["id", "hash", "n", "digest", "sketch", "token", "places"]

    def counted(fresh: list[np.ndarray]) -> pa.RecordBatch:
        tokens, counts = np.unique(np.concatenate(fresh), return_counts=True)
        n = len(tokens)
        return pa.RecordBatch.from_arrays([pa.nulls(n, kind), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()), pa.array(tokens.view(np.int64)), pa.array(counts)], names)

    def run(batches):
        fresh, size, seen = [], 0, set()
        for batch in batches:
            ns, digests, sketches = [], [], []
            for _, texts in _slices(batch):
                for tokens in token_sets(texts, width):
                    name = _digest(tokens)
                    ns.append(len(tokens))
                    digests.append(name)
                    sketches.append(sketch(tokens, cells))
                    if name not in seen:
                        seen.add(name)
                        fresh.append(tokens[: needed(len(tokens), percent)])
                        size += len(fresh[-1])
            n = len(ns)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("hash"), pa.array(ns, pa.int64()), pa.array(digests, pa.binary()), pa.array(sketches, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], names)
            if size > COUNTED:
                yield counted(fresh)
                fresh, size = [], 0
        if fresh:
            yield counted(fresh)

    return run


# --- signatures -----------------------------------------------------------------------


def needed(n: int, percent: int) -> int:
    """Tokens of a set of ``n`` that would have to be missing without a shared signature; 0 if only equal sets link."""
    least = -(-percent * n // 100)
    return 0 if least == n and 100 * n // percent == n else n - least + 1


def signatures(tokens: np.ndarray, frequent: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(signatures of rare tokens, signatures of pairs of frequent tokens, how many of them a similar set shares at least) of one set; ``frequent`` is a mask."""
    n = len(tokens)
    need, least = needed(n, percent), -(-percent * n // 100)
    if not need:
        return tokens[:0], tokens[:0], 1
    full = need + SHARED - 1
    rare, common = tokens[~frequent], tokens[frequent]
    if len(rare) >= full:
        return rare[:full], tokens[:0], SHARED
    pairs, shared = [tokens[:0]], SHARED
    for band in range(max(least, 1).bit_length(), (100 * n // percent).bit_length() + 1):
        classes = max(1, (100 - percent) * (1 << (band - 1)) // 200)
        own = (mix(common ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(classes)).astype(np.int64)
        order = np.argsort(own, kind="stable")
        opens = np.zeros(len(common), bool)  # the first token of its subclass counts 0
        opens[order[np.flatnonzero(np.diff(own[order], prepend=-1))]] = True
        counted = np.cumsum(~opens)
        end = int(np.searchsorted(counted, full - len(rare))) + 1
        if end > len(common):
            shared = 1
        mine, own = common[:end], own[:end]
        order = np.argsort(own, kind="stable")
        mine, own = mine[order], own[order]
        for gap in range(1, len(mine)):
            same = own[gap:] == own[:-gap]
            if not same.any():
                break
            low, high = np.minimum(mine[:-gap], mine[gap:])[same], np.maximum(mine[:-gap], mine[gap:])[same]
            pairs.append(mix(mix(low) + high * np.uint64(_STEPS[50]) + np.uint64(band)))
    return rare, np.concatenate(pairs), shared


def _postings(width: int, percent: int, frequent):
    def run(batches):
        bits = frequent.value
        for batch in batches:
            for _, texts in _slices(batch):
                sig, salt, digest, size, least, seen = [], [], [], [], [], set()
                sets = token_sets(texts, width)
                joined = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                mask = _has(bits, _frequent_place(joined))
                start = 0
                for tokens in sets:
                    mine, start = mask[start : start + len(tokens)], start + len(tokens)
                    name = _digest(tokens)
                    if name is None or name in seen:
                        continue
                    seen.add(name)
                    ones, twos, shared = signatures(tokens, mine, percent)
                    for values, s in ((ones, 0), (twos, 1 + name[-1] % SALTS)):
                        if len(values):
                            sig.append(values)
                            salt.append(np.full(len(values), s, np.int32))
                            digest += [name] * len(values)
                            size.append(np.full(len(values), len(tokens), np.int64))
                            least.append(np.full(len(values), shared, np.int32))
                if sig:
                    columns = [pa.array(np.concatenate(sig).view(np.int64)), pa.array(np.concatenate(salt)), pa.array(digest, pa.binary()), pa.array(np.concatenate(size)), pa.array(np.concatenate(least))]
                    yield pa.RecordBatch.from_arrays(columns, ["sig", "salt", "digest", "n", "shares"])

    return run


# --- bitmaps of bounded size ----------------------------------------------------------


def bitmap(values: DataFrame, position: str, n_bits: int = BITS) -> np.ndarray:
    """Bits of ``position`` (0 <= position < 2**n_bits): 2**n_bits bits, however many rows."""
    rows = values.groupBy(F.expr(f"bitmap_bucket_number({position} + 1)").alias("k")).agg(F.expr(f"bitmap_construct_agg(bitmap_bit_position({position} + 1))").alias("b")).collect()
    out = np.zeros((1 << n_bits) // 8, np.uint8)
    for r in rows:
        part = np.frombuffer(bytes(r["b"]), np.uint8)
        out[(r["k"] - 1) * len(part) : r["k"] * len(part)] = part
    return out


def _has(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def _frequent_place(tokens: np.ndarray) -> np.ndarray:
    return (tokens & np.uint64((1 << FREQUENT_BITS) - 1)).astype(np.int64)


# --- join -----------------------------------------------------------------------------


class _Join:
    """One run: the tables that its steps share."""

    def __init__(self, df: DataFrame, id_col: str, text_col: str, width: int, percent: int):
        self.spark, self.width, self.percent = df.sparkSession, width, percent
        self.scratch = Scratch(self.spark, "jaccard")
        text = pick(df, text_col)
        self.rows = df.select(pick(df, id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("hash"))
        kind = self.rows.schema["id"].dataType.simpleString()
        both = self.rows.mapInArrow(_profile(width, percent, kind), f"id {kind}, hash long, n long, digest binary, sketch binary, token long, places long")
        both.withColumn("part", F.col("n").isNull().cast("int")).write.partitionBy("part").parquet(f"{self.scratch.path}/profile")
        read = self.spark.read.schema(both.schema)
        texts, tokens = (read.parquet(f"{self.scratch.path}/profile/part={k}") if self.scratch.has(f"profile/part={k}") else self.spark.createDataFrame([], both.schema) for k in (0, 1))
        self.docs = texts.select("id", "hash", "n", "digest")
        self.classes = self.scratch.write(texts.where("digest IS NOT NULL").groupBy("digest").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch")), "sketches")
        frequent = tokens.groupBy("token").agg(F.sum("places").alias("n")).where(F.col("n") > MIN_FREQUENT)
        low = F.col("token").bitwiseAND((1 << FREQUENT_BITS) - 1)
        self.frequent = self.spark.sparkContext.broadcast(bitmap(frequent.select(low.alias("at")), "at", FREQUENT_BITS))
        self.scratch.drop("profile/part=1")

    def candidates(self) -> tuple[DataFrame, DataFrame]:
        """(groups: group, digest, guest of every signature's groups by size with pairs that met no pivot; pairs that met one)."""
        posts = self.rows.select("text").mapInArrow(_postings(self.width, self.percent, self.frequent), "sig long, salt int, digest binary, n long, shares int")
        group = Window.partitionBy("sig", "salt")
        met = posts.select("*", F.min(F.struct("digest", "n", "shares")).over(group).alias("p"), F.count(F.lit(1)).over(group).alias("size"))
        met = met.where("salt > 0 OR size > 1").withColumn("two", F.expr("salt = 0 AND size = 2"))
        # a member is at home in the band of its size and a guest in the next; similar sizes are less than a band apart
        band = F.floor(F.log("n") / (math.log(100 / self.percent) * 1.001) if self.percent < 100 else F.col("n")).cast("int")
        met = met.withColumn("guest", F.explode(F.array(F.lit(False), F.lit(True)))).withColumn("band", band + F.col("guest").cast("int"))
        inside = Window.partitionBy("sig", "salt", "band")
        met = met.withColumns({"k": F.count(F.lit(1)).over(inside), "guests": F.min("guest").over(inside), "q": F.min(F.struct("digest", "n", "shares")).over(inside)})
        # of a band's members: alive, those that are to meet; pair, the one that tells of the only two
        met = met.withColumn("alive", F.expr("salt > 0 OR NOT two AND k > 2 AND NOT guests")).withColumn("pair", F.expr("salt = 0 AND NOT two AND k = 2 AND NOT guests AND digest <> q.digest"))
        met = self.scratch.write(met.where("NOT guest OR alive OR pair").select("sig", "salt", "digest", "n", "shares", "p", "two", "guest", "band", "alive", "pair", F.when(F.col("pair"), F.col("q")).alias("q")), "met")
        self.frequent.destroy()
        home = met.where("NOT guest")
        salted = home.where("salt > 0").select("sig", "p.digest", "p.n", "p.shares").distinct()
        across = salted.withColumn("p", F.min(F.struct("digest", "n", "shares")).over(Window.partitionBy("sig"))).withColumn("two", F.lit(False))
        columns = ["digest", "n", "shares", "p", "two"]
        pairs = met.where("pair").select("digest", "n", "shares", F.col("q").alias("p"), F.lit(True).alias("two"))
        groups = met.where("alive").select(F.xxhash64("sig", "band").alias("group"), "digest", "guest")
        return groups, _apart(home.select(*columns).unionByName(across.select(*columns)).unionByName(pairs), self.percent)

    def sets_of(self, ends: DataFrame) -> DataFrame:
        """(digest, n, tokens, fine sketch, cluster) of the classes ``ends(digest, cluster)``; a bitmap of bounded size spares most other texts."""
        wanted = self.docs.join(ends, "digest", "left_semi").select(_place("hash").alias("at")).distinct()
        bits, width = self.spark.sparkContext.broadcast(bitmap(wanted, "at")), self.width

        def run(batches):
            seen = set()
            for batch in batches:
                held = np.flatnonzero(_has(bits.value, batch.column("at").to_numpy()))
                for _, texts in _slices(batch.take(pa.array(held))):
                    names, ns, sets, fine = [], [], [], []
                    for tokens in token_sets(texts, width):
                        name = _digest(tokens)
                        if name and name not in seen:
                            seen.add(name)
                            names.append(name)
                            ns.append(len(tokens))
                            sets.append(tokens.view(np.int64))
                            fine.append(sketch(tokens, FINE))
                    if names:
                        yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(ns, pa.int64()), pa.array(sets, pa.list_(pa.int64())), pa.array(fine, pa.binary())], ["digest", "n", "tokens", "sketch"])

        sets = self.rows.select("text", _place("hash").alias("at")).mapInArrow(run, "digest binary, n long, tokens array<bigint>, sketch binary")
        best = sets.join(ends, "digest").groupBy("digest").agg(F.first(F.struct("n", "tokens", "sketch", "cluster")).alias("x"))
        out = self.scratch.write(best.select("digest", "x.*"), "sets")
        bits.destroy()
        return out

    def pruned(self, pairs: DataFrame, name: str) -> DataFrame:
        """The pairs that the sketches let pass."""
        percent = self.percent

        @arrow_udf(BooleanType())
        def may(left: pa.Array, right: pa.Array, n: pa.Array, m: pa.Array) -> pa.Array:
            sizes = [x.to_numpy(zero_copy_only=False) for x in (n, m)]
            x, y = left.to_pylist(), right.to_pylist()
            out = np.zeros(len(x), bool)
            width = np.array([min(len(p), len(q)) // 8 for p, q in zip(x, y, strict=True)], np.int64)
            for w in sorted(set(width.tolist())):
                at = np.flatnonzero(width == w)
                tables = []
                for cells in (x, y):
                    table = np.zeros((len(at), w), np.uint64)
                    for _, (some, values) in _by_width([cells[i] for i in at]).items():
                        table[some] = _folded(values, w)
                    tables.append(table)
                out[at] = may_link(*tables, *(s[at] for s in sizes), percent)[0]
            return pa.array(out)

        left, right = (self.classes.select(F.col("digest").alias(e), F.col("n").alias(f"n{e}"), F.col("sketch").alias(f"s{e}")) for e in "ab")
        return self.scratch.write(pairs.join(left, "a").join(right, "b").where(may("sa", "sb", "na", "nb")).select("a", "b"), f"pairs-{name}")

    def links(self, pairs: DataFrame, sets: DataFrame, name: str) -> DataFrame:
        """The pairs (a, b) whose sets are similar enough."""
        left, right = (sets.select(F.col("digest").alias(e), F.col("tokens").alias(f"t{e}")) for e in "ab")
        wide = pairs.join(left, "a").join(right, "b")
        shared = wide.select("a", "b", (F.size("ta") + F.size("tb")).alias("n"), F.size(F.array_intersect("ta", "tb")).alias("k"))
        return self.scratch.write(shared.where(100 * F.col("k") >= self.percent * (F.col("n") - F.col("k"))).select("a", "b"), f"links-{name}")

    def spread(self, rows: DataFrame, key: str) -> DataFrame:
        """Rows with (i, j), i <= j, a pair of blocks of their group ``key``: each row goes to all pairs of its block."""
        others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least("mine", k).alias("i"), F.greatest("mine", k).alias("j")))
        return rows.withColumn("at", F.explode(others)).select(key, "at.i", "at.j", *[c for c in rows.columns if c not in (key, "blocks")])

    def meet(self, spread: DataFrame, key: str, kernel) -> DataFrame:
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return spread.repartition(parts, key, "i", "j").sortWithinPartitions(key, "i", "j", "digest").mapInArrow(kernel, "a binary, b binary").distinct()

    def forest(self, groups: DataFrame, label: DataFrame) -> DataFrame:
        """Of each group, a spanning forest (a, b) of the pairs of different components that the coarse sketches let pass."""
        named = groups.join(label.withColumnRenamed("id", "digest"), "digest", "left").withColumn("component", F.coalesce("component", "digest"))
        named = self.scratch.write(named, "named")
        open_ = self.scratch.write(named.join(_mixed(named, "group"), "group").withColumn("mine", _block()), "open")
        self.scratch.drop("named")
        rows = self.spread(open_, "group").join(self.classes, "digest").select("group", "i", "j", "mine", "digest", "component", "n", "sketch", "guest", F.lit(None).cast("binary").alias("other"))
        out = self.scratch.write(self.meet(rows, "group", _meet(self.percent, 0)), "forest")
        self.scratch.drop("open")
        return out

    def components(self) -> DataFrame:
        """(digest, component) of every class with a link."""
        groups, pairs = self.candidates()
        pairs = self.pruned(pairs, "0")
        # for now, two members are together when they met one pivot; who met none is alone
        both = pairs.select(F.col("b").alias("id"), F.col("a").alias("component")).unionByName(pairs.select(F.col("a").alias("id"), F.col("a").alias("component")))
        pairs = pairs.unionByName(self.forest(groups, both.groupBy("id").agg(F.min("component").alias("component"))))
        self.scratch.drop("met")
        cluster = self.scratch.write(component_of(pairs, "a", "b", within=self.scratch).select(F.col("id").alias("digest"), F.col("component").alias("cluster")), "cluster")
        sets = self.sets_of(cluster)
        members = sets.select("digest", "n", "sketch", "cluster")
        label = links = tried = None
        for k in range(64):
            if label is None:
                named = members.withColumn("component", F.col("digest"))
            else:
                named = members.join(label.withColumnRenamed("id", "digest"), "digest", "left").withColumn("component", F.coalesce("component", "digest"))
                named = self.scratch.write(named, f"named-{k}")
            open_ = named.join(_mixed(named, "cluster"), "cluster").withColumn("mine", _block()).withColumn("other", F.lit(None).cast("binary"))
            rows = self.spread(open_, "cluster")
            if tried is not None:  # what was verified and is no link goes to the blocks where it would be found again
                ends = open_.select("digest", "cluster", "component", "mine", "blocks")
                a, b = (ends.select(F.col("digest").alias(e), F.col("component").alias(f"c{e}"), F.col("mine").alias(f"m{e}"), *(["cluster"] if e == "a" else [])) for e in "ab")
                failed = tried.join(links, ["a", "b"], "left_anti").join(a, "a").join(b, "b").where("ca <> cb")
                none = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("n", "sketch", "component")]
                rows = rows.unionByName(failed.select("cluster", F.least("ma", "mb").alias("i"), F.greatest("ma", "mb").alias("j"), F.col("ma").alias("mine"), F.col("a").alias("digest"), F.col("b").alias("other"), *none))
            met = rows.select("cluster", "i", "j", "mine", "digest", "component", "n", "sketch", F.lit(False).alias("guest"), "other")
            found = self.scratch.write(self.meet(met, "cluster", _meet(self.percent, PARTNERS << 3 * (k - 1) if k else 0)), f"found-{k}")
            self.scratch.drop(f"named-{k}")
            if found.isEmpty():
                return cluster.select(F.col("digest").alias("id"), F.col("digest").alias("component")) if label is None else label
            more = self.links(found, sets, str(k))
            links = more if links is None else links.unionByName(more)
            tried = found if tried is None else tried.unionByName(found)
            label = self.scratch.write(component_of(links, "a", "b", within=self.scratch), f"label-{k}")
        raise RuntimeError("pairs were left after 64 rounds")


def _block() -> Column:
    return F.pmod(F.xxhash64("digest"), "blocks").cast("int")


def _place(name: str) -> Column:
    return F.pmod(F.col(name), F.lit(1 << BITS))


def _mixed(named: DataFrame, key: str) -> DataFrame:
    """(key, blocks) of the groups with several components."""
    seen = named.groupBy(key).agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count(F.lit(1)).alias("size"))
    return seen.where("x <> y").select(key, F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))


def _meet(percent: int, limit: int):
    """Compare the rows of one (key, i, j) at a time; they come sorted by it.

    With no limit, hand on a spanning forest, else the best pairs of each member of the smaller component.
    """

    def pairs_of(rows: list[tuple]) -> list[tuple[bytes, bytes]]:
        failed = [(r[4], r[9]) for r in rows if r[9] is not None]
        rows = [r for r in rows if r[9] is None]
        if not rows:
            return []
        _, i, j, mine, digest, component, n, cells, guest, _ = zip(*rows, strict=True)
        name = {c: k for k, c in enumerate(dict.fromkeys(component))}
        if len(name) == 1:
            return []
        comp, size = np.array([name[c] for c in component]), np.array(n)
        found = close_pairs(comp, size, cells, percent, np.array(mine) if i[0] != j[0] else None, np.array(guest))
        if not limit:
            told = spanning(comp, found)
        else:
            at = {d: k for k, d in enumerate(digest)}
            tried = [sorted((at[a], at[b])) for a, b in failed if a in at and b in at]
            tried = np.array([a * len(rows) + b for a, b in tried], np.int64)
            rank = np.lexsort((np.arange(len(name)), np.bincount(comp, minlength=len(name))))
            place = np.empty(len(name), np.int64)
            place[rank] = np.arange(len(name))
            told = best_partners(comp, place[comp], found, limit, tried)
        return [(min(digest[p], digest[q]), max(digest[p], digest[q])) for p, q in told]

    def run(batches):
        key, held, told = None, [], set()
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:3] != key:
                    told.update(pairs_of(held))
                    key, held = row[:3], []
                    if len(told) > 100_000:
                        yield _rows(told)
                        told = set()
                held.append(row)
        told.update(pairs_of(held))
        if told:
            yield _rows(told)

    return run


def _rows(told: set) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*told, strict=True)], ["a", "b"])


def _apart(met: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a < b) of different classes whose sizes allow a link, those of groups of two if they share enough signatures."""
    sized = met.where(f"digest <> p.digest AND 100 * least(n, p.n) >= {percent} * greatest(n, p.n)")
    pairs = sized.select(F.least("digest", "p.digest").alias("a"), F.greatest("digest", "p.digest").alias("b"), F.least("shares", "p.shares").alias("shares"), F.when(F.col("two"), 1).otherwise(SHARED).alias("k"))
    return pairs.groupBy("a", "b").agg(F.sum("k").alias("k"), F.min("shares").alias("shares")).where("k >= shares").select("a", "b")


def _labelled(df: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> tuple[_Join, DataFrame]:
    """(id, hash of the text, n, digest, component_id) of every row."""
    run = _Join(df, id_col, text_col, width, percent)
    label = run.components().withColumnRenamed("id", "digest")
    classes = run.docs.where("digest IS NOT NULL").groupBy("digest").agg(F.min("id").alias("least"))
    named = run.scratch.write(classes.join(label, "digest", "left").select("digest", "least", F.coalesce("component", "digest").alias("component")), "classes")
    first = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_class = run.scratch.write(named.join(first, "component").select("digest", "component_id"), "by-class")
    run.scratch.keep("profile", "by-class")
    # both sides come straight from a table, so that the rows of a class with many copies can be split
    return run, run.docs.join(by_class, "digest", "left")


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, percent: int = 90) -> DataFrame:
    """One row for each input row: id, ``n_shingles``, ``component_id`` (smallest id reachable by links)."""
    _, out = _labelled(df, id_col, text_col, width, percent)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("digest").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows whose id is the smallest of their component, with the input's columns.

    A row is its id and text (by 64-bit hash).  Rows with a null id stay.  Rows that are surely
    not among those to drop stay where they are read; a bitmap of bounded size tells.
    """
    run, out = _labelled(df, id_col, text_col, width, percent)
    gone = run.scratch.write(out.where("digest IS NOT NULL AND id <> component_id").select(F.col("id").alias("_id"), F.col("hash").alias("_hash")).distinct(), "gone")
    place = F.pmod(F.xxhash64("_id", "_hash"), F.lit(1 << BITS))
    bits = df.sparkSession.sparkContext.broadcast(bitmap(gone.select(place.alias("at")), "at"))

    @arrow_udf(BooleanType())
    def maybe(at: pa.Array) -> pa.Array:
        return pa.array(_has(bits.value, at.to_numpy(zero_copy_only=False)))

    rows = df.select(pack(df), pick(df, id_col).alias("_id"), F.xxhash64(pick(df, text_col)).alias("_hash")).withColumn("_maybe", maybe(place))
    kept = rows.where("_maybe").join(gone, ["_id", "_hash"], "left_anti")
    return rows.where("NOT _maybe").select("_row.*").unionByName(kept.select("_row.*"))
