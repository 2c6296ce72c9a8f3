"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token is a linked list of byte spans.  Every pair of neighbours whose bytes have a
merge rank waits in the bucket of that rank, as its position.  A bitmap of the ranks with
waiting positions, in three levels of 64-bit words, gives the next rank by three
find-first-set steps, however long the pre-token; a popped position whose pair has changed
meanwhile is stale and skipped.  A bucket is a heap, so equal ranks merge left to right.
Encoding takes n log n steps for n bytes.

Pre-tokens repeat, so each worker keeps the ids of those it has seen, ``CACHE_ROWS`` of them
at most; that changes the speed alone.  The rank file is read once, on the driver, and sent
as its bytes (its size does not depend on the data).

Defined cases: null and empty texts have no ids; ids that the file does not name fail the
decoding; bytes that the file does not name fail the encoding; pairs of equal rank merge left to
right; repeated rows are encoded alike; an empty table gives no rows; very long texts are encoded
whole, pre-token by pre-token; the functions are column expressions, so other columns stay as
they are, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterable
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import Column, SparkSession
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import BinaryType, StructField, StructType

from .text import is_latin, latin_twin

CACHE_ROWS = 800_000
CACHE_CHARS = 48
LONG_CHARS = 1 << 20


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


class Codec:
    """Encoder and decoder over one rank file and one pre-token pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern, self.latin = ranks, regex.compile(pattern), latin_twin(pattern)
        n_ranks = max(ranks.values(), default=0) + 1
        #: The bitmap: a bit of ``low`` for each rank with waiting positions, of ``mid`` for each word of ``low`` that is not zero.
        self.low, self.mid = [0] * ((n_ranks >> 6) + 1), [0] * ((n_ranks >> 12) + 1)
        self.tokens: list[bytes | None] = [None] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.packed = _Packed(self)

    def merge(self, word: bytes) -> list[int]:
        """The ids of one pre-token.  The bitmap is all zero before and after."""
        rank_of, low, mid, n = self.ranks.get, self.low, self.mid, len(word)
        whole = rank_of(word)
        if whole is not None:
            return [whole]
        after = list(range(1, n + 1))  # where the span that begins here ends, and so where its neighbour begins
        before = list(range(-1, n))
        wanted: list[int | None] = [rank_of(word[at : at + 2]) for at in range(n - 1)]  # rank of the pair that begins here
        wanted += (None, None)
        fresh = [(rank, at) for at, rank in enumerate(wanted) if rank is not None]
        buckets: dict[int, list[int]] = {}
        top = 0  # a bit for each word of ``mid`` that is not zero
        while True:
            for rank, at in fresh:
                bucket = buckets.get(rank)
                if bucket is not None:
                    heappush(bucket, at)
                    continue
                buckets[rank] = [at]
                had = low[rank >> 6]
                low[rank >> 6] = had | 1 << (rank & 63)
                if not had:
                    mid[rank >> 12] |= 1 << (rank >> 6 & 63)
                    top |= 1 << (rank >> 12)
            if not top:
                break
            block = (top & -top).bit_length() - 1  # three times find-first-set
            bits = mid[block]
            row = (block << 6) + (bits & -bits).bit_length() - 1
            bits = low[row]
            rank = (row << 6) + (bits & -bits).bit_length() - 1
            bucket = buckets[rank]
            at = heappop(bucket)
            if not bucket:
                del buckets[rank]
                low[row] = bits = bits & (bits - 1)
                if not bits:
                    mid[block] = bits = mid[block] & (mid[block] - 1)
                    if not bits:
                        top &= top - 1
            if wanted[at] != rank:
                fresh = []  # a stale position
                continue
            gone = after[at]
            after[at] = end = after[gone]
            wanted[gone] = None
            if end < n:
                before[end] = at
                wanted[at] = rank = rank_of(word[at : after[end]])
                fresh = [] if rank is None else [(rank, at)]
            else:
                wanted[at] = None
                fresh = []
            if at:
                left = before[at]
                rank = rank_of(word[left:end])
                if rank is not None and rank != wanted[left]:
                    fresh.append((rank, left))
                wanted[left] = rank
        out, at = [], 0
        while at < n:
            out.append(self.ranks[word[at : after[at]]])
            at = after[at]
        return out

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        pattern = self.latin if self.latin and is_latin(text) else self.pattern
        words: Iterable[str] = pattern.findall(text) if len(text) <= LONG_CHARS else (m.group() for m in pattern.finditer(text))
        return b"".join(map(self.packed.__getitem__, words))

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(packed, "<u4").tolist()))


def pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class _Packed(dict):
    """Pre-token -> its packed ids, filled as they are met; half of it is kept when it is full."""

    def __init__(self, codec: Codec):
        self.codec = codec
        self.old: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        out = self.old.get(word)
        if out is None:
            out = pack(self.codec.merge(word.encode()))
        if len(word) <= CACHE_CHARS:
            if len(self) >= CACHE_ROWS // 2:
                self.old = dict(self)
                self.clear()
            self[word] = out
        return out


@lru_cache(maxsize=2)
def _codec(key: bytes, pattern: str, holder: "_Holder") -> Codec:
    return Codec(read_ranks(holder.data), pattern)


class _Holder:
    """Bytes that take no part in a cache key; their hash beside them does."""

    def __init__(self, data: bytes):
        self.data = data

    def __eq__(self, other: object) -> bool:
        return isinstance(other, _Holder)

    def __hash__(self) -> int:
        return 0


def codec_of(data: bytes, pattern: str) -> Codec:
    """One codec for each worker process, rank file and pattern."""
    return _codec(hashlib.sha256(data).digest(), pattern, _Holder(data))


def share(spark: SparkSession, ranks_path: str) -> Broadcast:
    with open(ranks_path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(text: Column, ranks: Broadcast, pattern: str) -> Column:
    """Binary column: the ids of each text, little-endian unsigned 32-bit."""

    def run(texts: pa.Array) -> pa.Array:
        codec = codec_of(ranks.value, pattern)
        return pa.array([codec.encode(x) if x else b"" for x in texts.to_pylist()], pa.binary())

    return arrow_udf(run, BinaryType())(text)


def decode(ids: Column, ranks: Broadcast, pattern: str) -> Column:
    """Binary column: the bytes that packed ids stand for."""

    def run(packed: pa.Array) -> pa.Array:
        codec = codec_of(ranks.value, pattern)
        return pa.array([codec.decode(x) if x else b"" for x in packed.to_pylist()], pa.binary())

    return arrow_udf(run, BinaryType())(ids)


_BOTH = StructType([StructField("ids", BinaryType()), StructField("decoded", BinaryType())])


def round_trip(text: Column, ranks: Broadcast, pattern: str) -> Column:
    """Struct column (ids, decoded): what :func:`encode` gives, and what :func:`decode` makes of that.

    Chained in one plan, the two would encode twice.
    """

    def run(texts: pa.Array) -> pa.Array:
        codec = codec_of(ranks.value, pattern)
        ids = [codec.encode(x) if x else b"" for x in texts.to_pylist()]
        return pa.StructArray.from_arrays([pa.array(ids, pa.binary()), pa.array([codec.decode(x) for x in ids], pa.binary())], ["ids", "decoded"])

    return arrow_udf(run, _BOTH)(text)
