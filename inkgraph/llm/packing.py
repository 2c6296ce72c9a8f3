"""Best-fit packing of token pieces into sequences with a capacity vector.

A sequence has three capacities: tokens, documents, and attention cost (the sum of the
squared lengths of its pieces).  A piece of length ``l`` asks for ``(l, 1, l * l)``, so
pieces of one length are alike, and the packing depends on the histogram of lengths alone:
``capacity`` rows at most, whatever the corpus.  The driver packs that histogram:

* lengths in decreasing order; bins with equal residuals form one group with a range of
  sequence ids; each piece goes to the feasible bin whose residual vector suits it best - the
  smallest weighted norm of what would be left over, or the largest weighted dot product of
  demand and residual - under all three capacities.  A bin that takes a piece has a smaller
  norm, so it stays the best until it is full, and a group is filled bin by bin; its dot
  product falls, so a group takes one piece a bin before it is looked at again;
* every scoring of the query's list weighs all three parts; of the given scorings, the plan
  with the fewest sequences is used, of equals the first.

The plan maps (length, rank within the length) to a sequence and an offset.  Ranks come
from a shuffle by (length, salt) with as many salts as a length has shares of the table, so
a length that a third of all pieces has is spread like the rest.

Defined cases: a null or empty text is the closing id alone; an empty table gives an empty
result; repeated rows are packed like any others; a null id is carried along; a very long text
is cut into many pieces; a piece that asks for more than a whole sequence has (limits set by
the caller) gets a sequence of its own; extra columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
import zlib
from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import filterfalse

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ..plans.lineage import Scratch
from .text import is_latin, latin_twin, pick

CAPACITY = 2048
CACHE_ROWS = 400_000
SLICE_CHARS = 1 << 20

# --- tokens ---------------------------------------------------------------------------


@lru_cache(maxsize=1)
def _young_letters() -> re.Pattern:
    """Letters and digits that Unicode got after 3.2: libraries differ in which of them they know."""
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    old = unicodedata.ucd_3_2_0.category
    runs: list[list[int]] = []
    for c in regex.findall(r"[\p{L}\p{N}]", every):
        if old(c) == "Cn":
            if runs and runs[-1][1] == ord(c) - 1:
                runs[-1][1] = ord(c)
            else:
                runs.append([ord(c), ord(c)])
    return re.compile("[" + "".join(f"{chr(x)}-{chr(y)}" for x, y in runs) + "]")


class WordTokenizer:
    """Ids of a lower-casing word-level BPE file, each distinct word encoded once.

    The file's own normaliser and splitting pattern are applied here (NFC, lower case, no
    white space); a word that is not known yet goes through the library.  Texts that hold
    one of the file's special tokens, or a letter younger than Unicode 3.2, go through the
    library as a whole.
    """

    def __init__(self, data: bytes):
        import json

        from tokenizers import Tokenizer

        told = json.loads(data)
        self.library = Tokenizer.from_str(data.decode())
        self.special = [t["content"] for t in told["added_tokens"]]
        pattern = told["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.split, self.latin = regex.compile(pattern), latin_twin(pattern)
        self.young = _young_letters()
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def words(self, text: str) -> list[str] | None:
        """The words of a text in lower case, None if it has to go through the library.

        Lower-casing is per character, so a final sigma is like any other.
        """
        if any(x in text for x in self.special):
            return None
        if self.latin and is_latin(text):
            return self.latin.findall(text.lower())
        if self.young.search(text):
            return None
        return self.split.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def _learn(self, words: list[str]) -> None:
        for at in range(0, len(words), 2000):
            part = words[at : at + 2000]
            found = self.library.encode(" ".join(part), add_special_tokens=False)
            owner = np.array(found.word_ids, "i8")
            ids = np.array(found.ids, "<u4")
            if len(owner) and owner[-1] == len(part) - 1 and (np.diff(owner) <= 1).all():
                bounds = np.searchsorted(owner, np.arange(len(part) + 1))
                self.known.update((w, ids[a:b].tobytes()) for w, a, b in zip(part, bounds[:-1], bounds[1:], strict=True))
            else:
                self.known.update((w, np.array(self.library.encode(w, add_special_tokens=False).ids, "<u4").tobytes()) for w in part)

    def encode(self, texts: list[str]) -> list[bytes]:
        found = [self.words(x) for x in texts]
        if len(self.known) > CACHE_ROWS // 2:
            self.known, self.old = {}, self.known
        new: set[str] = set()
        for words in found:
            new.update(filterfalse(self.known.__contains__, words or ()))
        again = new & self.old.keys()
        self.known.update((w, self.old[w]) for w in again)
        self._learn(list(new - again))
        get = self.known.__getitem__
        return [np.array(self.library.encode(x, add_special_tokens=False).ids, "<u4").tobytes() if w is None else b"".join(map(get, w)) for x, w in zip(texts, found, strict=True)]


class _Holder:
    def __init__(self, data: bytes):
        self.data = data

    def __eq__(self, other: object) -> bool:
        return isinstance(other, _Holder)

    def __hash__(self) -> int:
        return 0


@lru_cache(maxsize=2)
def _tokenizer(key: bytes, holder: _Holder) -> WordTokenizer:
    return WordTokenizer(holder.data)


def tokenizer_of(data: bytes) -> WordTokenizer:
    """One tokenizer for each worker process and file."""
    return _tokenizer(hashlib.sha256(data).digest(), _Holder(data))


def share(spark: SparkSession, path: str) -> Broadcast:
    """The tokenizer file's bytes, read on the driver; its size does not depend on the data."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def _slices(texts: list[str]):
    """Runs of texts of about ``SLICE_CHARS`` characters together."""
    run, size = [], 0
    for x in texts:
        run.append(x)
        size += len(x)
        if size >= SLICE_CHARS:
            yield run
            run, size = [], 0
    if run:
        yield run


def pieces(df: DataFrame, tokenizer: Broadcast, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Rows (id, piece, start, length, ids_crc32[, ids]): a text's ids and a closing id 0, cut every ``capacity`` ids."""
    width = 4 * capacity

    def run(batches):
        codec = tokenizer_of(tokenizer.value)
        for batch in batches:
            at = 0
            texts = [x or "" for x in batch.column("text").to_pylist()]
            for part in _slices(texts):
                rows, piece, start, length, crc, ids = [], [], [], [], [], []
                for packed in codec.encode(part):
                    packed += b"\0\0\0\0"
                    for k, cut in enumerate(range(0, len(packed), width)):
                        mine = packed[cut : cut + width]
                        rows.append(at)
                        piece.append(k)
                        start.append(cut // 4)
                        length.append(len(mine) // 4)
                        crc.append(zlib.crc32(mine))
                        if keep_ids:
                            ids.append(mine)
                    at += 1
                columns = [batch.column("id").take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["id", "piece", "start", "length", "ids_crc32"]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.binary())] * keep_ids, names + ["ids"] * keep_ids)

    kind = df.select(pick(df, id_col)).schema[0].dataType.simpleString()
    return df.select(pick(df, id_col).alias("id"), pick(df, text_col).alias("text")).mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids)


# --- plan -----------------------------------------------------------------------------


@dataclass(frozen=True)
class Scoring:
    """``kind``: "norm" (least weighted norm of the leftover) or "dot" (largest weighted dot product)."""

    kind: str
    weights: tuple[float, float, float]


SCORINGS = (Scoring("norm", (1.0, 1.0, 1.0)), Scoring("norm", (1.0, 0.05, 0.05)), Scoring("dot", (1.0, 0.5, 0.5)))


@dataclass(frozen=True)
class Plan:
    """Row ``i``: the pieces of ``length[i]`` with ranks from ``rank[i]`` to the next row's go to sequences from ``seq[i]`` on, each at ``offset[i]``."""

    length: np.ndarray
    rank: np.ndarray
    seq: np.ndarray
    offset: np.ndarray
    n_sequences: int


def plan_packing(histogram: dict[int, int], capacity: int, max_docs: int, max_attention: int, scoring: Scoring) -> Plan:
    """Best fit by ``scoring`` over a histogram of lengths, longest first; of equally good bins the first."""
    caps = np.array([capacity, max_docs, max_attention], float)
    weight = np.array(scoring.weights)
    left = np.zeros((0, 3), np.int64)  # residual capacities of each group's bins
    first, count = np.zeros(0, np.int64), np.zeros(0, np.int64)  # the group's range of sequence ids
    rows: list[tuple[int, int, int, int]] = []
    total = 0
    smallest = min(histogram, default=1)

    def scores(residual: np.ndarray, ask: np.ndarray) -> np.ndarray:
        if scoring.kind == "norm":
            return (weight * ((residual - ask) / caps) ** 2).sum(-1)
        return -(weight * (ask / caps) * (residual / caps)).sum(-1)

    for size in sorted(histogram, reverse=True):
        ask = np.array([size, 1, size * size], np.int64)
        todo, rank = histogram[size], 0
        alive = (left >= [smallest, 1, smallest * smallest]).all(1)
        left, first, count = left[alive], first[alive], count[alive]
        fits = np.flatnonzero((left >= ask).all(1))
        heap = list(zip(scores(left[fits], ask).tolist(), first[fits].tolist(), count[fits].tolist(), map(tuple, left[fits].tolist()), strict=True))
        rest = np.ones(len(left), bool)
        rest[fits] = False
        heapify(heap)
        done: list[tuple[int, int, tuple[int, ...]]] = []  # groups (first, count, residual) that take no more of this length
        while todo:
            if heap:
                _, start, have, base = heappop(heap)
                each = min(b // a for b, a in zip(base, ask.tolist(), strict=True)) if scoring.kind == "norm" else 1
            else:  # new sequences; each is filled before the next is opened
                base = tuple(int(c) for c in caps)
                each = max(1, min(b // a for b, a in zip(base, ask.tolist(), strict=True)))
                start, have = total, -(-todo // each)
                total += have
            used = capacity - base[0]
            full = min(have, todo // each)
            for k in range(each if full else 0):
                rows.append((size, rank + k * full, start, used + k * size))
            rank, todo = rank + each * full, todo - each * full
            over = todo if full < have else 0  # fewer than fill one more bin
            for k in range(over):
                rows.append((size, rank + k, start + full, used + k * size))
            rank, todo = rank + over, todo - over
            gone = full + bool(over)
            for s, c, n in ((start, full, each), (start + full, int(bool(over)), over), (start + gone, have - gone, 0)):
                now = tuple(b - n * a for b, a in zip(base, ask.tolist(), strict=True))
                if c and all(x >= y for x, y in zip(now, ask.tolist(), strict=True)):
                    heappush(heap, (float(scores(np.array(now), ask)), s, c, now))
                elif c:
                    done.append((s, c, now))
        groups = done + [(s, c, base) for _, s, c, base in heap]
        left = np.concatenate([left[rest], np.array([g[2] for g in groups], np.int64).reshape(-1, 3)])
        first = np.concatenate([first[rest], np.array([g[0] for g in groups], np.int64)])
        count = np.concatenate([count[rest], np.array([g[1] for g in groups], np.int64)])
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return Plan(*(table[:, k].copy() for k in range(4)), n_sequences=total)


def best_plan(histogram: dict[int, int], capacity: int, max_docs: int, max_attention: int, scorings: Sequence[Scoring] = SCORINGS) -> Plan:
    return min((plan_packing(histogram, capacity, max_docs, max_attention, s) for s in scorings), key=lambda p: p.n_sequences)


# --- assignment -----------------------------------------------------------------------

_PLACE = StructType([StructField("sequence_id", LongType()), StructField("offset", LongType())])


def pack_pieces(cut: DataFrame, capacity: int = CAPACITY, max_docs: int | None = None, max_attention: int | None = None, scorings: Sequence[Scoring] = SCORINGS) -> DataFrame:
    """Give each row of a pieces table (column ``length``) its ``sequence_id`` and ``offset``.

    Left at None, the document and attention capacities are what a full sequence could
    ask for at most, so the tokens alone bind.
    """
    spark = cut.sparkSession
    scratch = Scratch(spark, "packing")
    rows = scratch.write(cut.withColumn("_uid", F.monotonically_increasing_id()), "pieces")
    histogram = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = best_plan(histogram, capacity, max_docs or capacity, max_attention or capacity * capacity, scorings)
    share_rows = max(1, sum(histogram.values()) // (4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    salts = {size: -(-n // share_rows) for size, n in histogram.items()}
    limit = max(salts, default=0) + 1
    salt_of = np.ones(limit, np.int64)
    for size, n in salts.items():
        salt_of[size] = n

    @arrow_udf(IntegerType())
    def salt(length: pa.Array, mixed: pa.Array) -> pa.Array:
        return pa.array(np.mod(mixed.to_numpy(zero_copy_only=False), salt_of[length.to_numpy(zero_copy_only=False)]), pa.int32())

    salted = rows.withColumn("_salt", salt("length", F.xxhash64("_uid")))
    counts = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("n")).orderBy("length", "_salt").collect()  # one row for each length and share
    bases, key, at = {}, None, 0
    for r in counts:
        if r["length"] != key:
            key, at = r["length"], 0
        bases[(r["length"], r["_salt"])] = at
        at += r["n"]
    span = max(salts.values(), default=0) + 1
    base_key = np.array(sorted(size * span + s for size, s in bases), np.int64)
    base_at = np.array([bases[(int(k) // span, int(k) % span)] for k in base_key], np.int64)

    @arrow_udf(_PLACE)
    def place(length: pa.Array, mine: pa.Array, local: pa.Array) -> pa.Array:
        size, own, nth = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in (length, mine, local))
        rank = base_at[np.searchsorted(base_key, size * span + own)] + nth - 1
        lo, hi = np.searchsorted(plan.length, size, "left"), np.searchsorted(plan.length, size, "right")
        while (lo + 1 < hi).any():  # bisect the plan's rows of each length by rank
            mid = (lo + hi) // 2
            right = (lo + 1 < hi) & (plan.rank[np.minimum(mid, len(plan.rank) - 1)] <= rank)
            lo, hi = np.where(right, mid, lo), np.where((lo + 1 < hi) & ~right, mid, hi)
        return pa.StructArray.from_arrays([pa.array(plan.seq[lo] + rank - plan.rank[lo], pa.int64()), pa.array(plan.offset[lo], pa.int64())], ["sequence_id", "offset"])

    ranked = salted.withColumn("_n", F.row_number().over(Window.partitionBy("length", "_salt").orderBy("_uid")))
    placed = ranked.withColumn("_place", place("length", "_salt", "_n"))
    return placed.select(*[pick(placed, c) for c in cut.columns], F.col("_place.sequence_id").alias("sequence_id"), F.col("_place.offset").alias("offset"))


def pack(df: DataFrame, tokenizer: Broadcast, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, keep_ids: bool = False, **limits) -> DataFrame:
    """Tokenise, cut and pack a table of texts: one row for each piece."""
    return pack_pieces(pieces(df, tokenizer, id_col, text_col, capacity, keep_ids), capacity, **limits).withColumnRenamed("id", id_col)
