"""Line dedup over content-defined chunks of lines, in DataFrame functions only.

``passage_dedup`` finds every repeated passage of ``MIN_LINES`` worded lines or more:

1. A rolling hash runs over the hashes of a document's worded lines; its value at a line stands
   for that line and the one before it.  It depends on these lines alone, wherever they stand.
2. Rolling hashes are counted over the whole table.  Where one occurs twice or more, a chunk
   begins or goes on, and it ends where the next one occurs once: so boundaries are set by the
   content, and a chunk is a maximal run of repeated line pairs.  Texts of repeated pairs alone
   are moved (a bitmap of bounded size, then the exact join) and grouped by their bytes: that is
   the byte comparison.
3. The occurrence of a pair with the smallest (id, row, place) stays, and so does one in the
   same row that overlaps it; the lines of all others go.  So the first occurrence of a line
   never goes, and of a repeated passage all lines go.
4. Documents that lose lines are put together again from their other lines; the rest stays
   where it is read.

``line_dedup`` does the same over chunks that do not overlap: the rolling hash ends one where
its remainder by ``DIVISOR`` is 0.  It moves less and leaves what does not fill a chunk.

Defined cases: a null text is empty; rows are told apart by id and text, so repeated rows
lose the same lines; of passages that repeat in one document the first stays; an empty
table gives an empty result; a document all of whose lines are repeats becomes empty; very long
texts are read whole; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import Scratch
from .text import SPACE, let, pick

WINDOW = 2
DIVISOR = 3
MIN_LINES = 2
BITS = 24
_SHIFT = 31


def _rotate(x: Column, by: int) -> Column:
    return x if not by else F.shiftleft(x, by).bitwiseOR(F.shiftrightunsigned(x, 64 - by))


def rolling(hashes: Column, window: int = WINDOW) -> Column:
    """Cyclic polynomial of the last ``window`` hashes at each place; places before the first count 0."""

    def at(h: Column, i: Column) -> Column:
        for k in range(1, window):
            h = h.bitwiseXOR(_rotate(F.when(i >= k, F.get(hashes, i - k)).otherwise(F.lit(0)), k))
        return h

    return F.transform(hashes, at)


def chunk_keys(lines: Column, window: int = WINDOW, divisor: int = DIVISOR) -> Column:
    """Chunks of a line array in order, each as start * 2**31 + end (line numbers, end excluded)."""

    def cut(rolled: Column) -> Column:
        ends = F.filter(F.transform(rolled, lambda r, i: F.when((F.pmod(r, F.lit(divisor)) == 0) | (i == F.size(rolled) - 1), i + 1)), lambda i: i.isNotNull())
        return let(ends, lambda es: F.transform(es, lambda e, k: F.coalesce(F.get(es, k - 1), F.lit(0)).cast("long") * (1 << _SHIFT) + e))

    return let(let(F.transform(lines, lambda x: F.xxhash64(x)), lambda h: rolling(h, window)), cut)


def chunk_lines(lines: Column, key: Column) -> Column:
    start = F.shiftright(key, _SHIFT).cast("int")
    return F.slice(lines, start + 1, (key - F.shiftright(key, _SHIFT) * (1 << _SHIFT)).cast("int") - start)


def _counts(lines: Column) -> Column:
    """Whether a chunk's lines make it worth removing."""
    worded = F.filter(lines, lambda x: x.rlike(f"[^{SPACE}]"))
    return F.size(worded) >= MIN_LINES


def _place(value: Column) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(1 << BITS))


def _bits(rows: DataFrame, value: str) -> DataFrame:
    """(bucket, bits): a bitmap of the places of ``value``, 2**BITS bits however many rows there are."""
    at = rows.select((_place(F.col(value)) + 1).alias("at"))
    return at.groupBy(F.expr("bitmap_bucket_number(at)").alias("_bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(at))").alias("_bits"))


def _flagged(rows: DataFrame, bits: DataFrame, value: str) -> DataFrame:
    """The rows with ``_maybe``: whether the bitmap has the place of ``value``."""
    at = _place(F.col(value))
    bit = F.pmod(at, F.lit(32768))
    joined = rows.withColumn("_bucket", F.floor(at / 32768) + 1).join(F.broadcast(bits), "_bucket", "left")
    byte = F.conv(F.hex(F.substring("_bits", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    mask = F.element_at(F.array(*[F.lit(1 << k) for k in range(8)]), F.pmod(bit, F.lit(8)).cast("int") + 1)
    return joined.withColumn("_maybe", F.coalesce(byte.bitwiseAND(mask) != 0, F.lit(False))).drop("_bucket", "_bits")


def _numbered(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, row): ``row`` tells rows apart by id and text."""
    text = F.coalesce(pick(df, text_col), F.lit(""))
    return df.select(pick(df, id_col).alias("id"), text.alias("text"), F.unhex(F.md5(F.concat_ws("\x00", pick(df, id_col).cast("string"), text))).alias("row"))


def _shared(scratch: Scratch, chunked: DataFrame) -> DataFrame:
    """(id, row, key, text, hash) of the chunks in ``cs(key, text, hash)`` whose hash occurs twice or more; chunks without text do not count."""
    every = chunked.select("id", "row", F.explode(F.filter("cs", lambda c: c["text"].isNotNull())).alias("c")).select("id", "row", "c.key", "c.text", "c.hash")
    repeated = scratch.write(every.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash"), "repeated")
    maybe = _flagged(every, _bits(repeated, "hash"), "hash").where("_maybe").drop("_maybe")
    return scratch.write(maybe.join(repeated, "hash", "left_semi"), "shared")


def _first(scratch: Scratch, shared: DataFrame, place: Column) -> DataFrame:
    """(hash, text, first) of the texts that occur twice or more.

    It is a table of its own, so that both sides of the join that follows come straight from
    tables and the rows of a text with very many places can be split.
    """
    return scratch.write(shared.groupBy("hash", "text").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("hash", "text", "first"), "first")


def _without(scratch: Scratch, rows: DataFrame, gone: DataFrame, rest: Callable[[Column, Column], Column], id_col: str) -> DataFrame:
    """The rows without the chunks ``key`` of ``gone``; ``rest`` gives a row's other lines from its lines and those keys."""
    gone = scratch.write(gone.groupBy("row").agg(F.collect_set("key").alias("gone")), "gone")
    wide = _flagged(rows, _bits(gone, "row"), "row")
    n_lines = (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long")
    calm = wide.where("NOT _maybe").select("id", "text", n_lines.alias("n_lines"), F.lit(0).cast("long").alias("n_removed_lines"), F.lit(0).cast("long").alias("n_removed_chars"))
    joined = wide.where("_maybe").join(gone, "row", "left").select("id", "text", n_lines.alias("n_lines"), F.coalesce("gone", F.array().cast("array<bigint>")).alias("gone"))
    cleaned = joined.select("id", "n_lines", F.length("text").alias("was"), let(F.split("text", "\n"), lambda ls: rest(ls, F.col("gone"))).alias("kept"))
    cleaned = cleaned.select("id", F.array_join("kept", "\n").alias("text"), "n_lines", (F.col("n_lines") - F.size("kept")).alias("n_removed_lines"), (F.col("was") - F.length(F.array_join("kept", "\n"))).cast("long").alias("n_removed_chars"))
    return calm.unionByName(cleaned).withColumnRenamed("id", id_col)


def line_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, divisor: int = DIVISOR) -> DataFrame:
    """One row for each input row: id, cleaned ``text``, ``n_lines``, ``n_removed_lines``, ``n_removed_chars``."""
    scratch, rows = Scratch(df.sparkSession, "line-dedup"), _numbered(df, id_col, text_col)
    chunked = rows.select("id", "row", let(F.split("text", "\n"), lambda ls: F.transform(chunk_keys(ls, window, divisor), lambda key: let(F.when(_counts(chunk_lines(ls, key)), F.array_join(chunk_lines(ls, key), "\n")), lambda t: F.struct(key.alias("key"), t.alias("text"), F.xxhash64(t).alias("hash"))))).alias("cs"))
    shared = _shared(scratch, chunked)
    first = _first(scratch, shared, F.struct("id", "key"))
    gone = shared.join(first, ["hash", "text"]).where(~F.struct("id", "key").eqNullSafe(F.col("first")))
    return _without(scratch, rows, gone, lambda ls, keys: let(F.array_except(chunk_keys(ls, window, divisor), keys), lambda ks: F.flatten(F.transform(ks, lambda k: chunk_lines(ls, k)))), id_col)


def _start(key: Column) -> Column:
    return F.shiftright(key, _SHIFT).cast("int")


def _end(key: Column) -> Column:
    return (key - F.shiftright(key, _SHIFT) * (1 << _SHIFT)).cast("int")


def passages(lines: Column) -> Column:
    """Pairs of neighbouring worded lines, with what stands between them: key (start * 2**31 + end, line numbers, end excluded), text, rolling hash."""

    def pairs(ws: Column) -> Column:
        def pair(hash_: Column, i: Column) -> Column:
            start, end = F.get(ws, i - 1), F.get(ws, i) + 1
            return F.struct((start.cast("long") * (1 << _SHIFT) + end).alias("key"), F.array_join(F.slice(lines, start + 1, end - start), "\n").alias("text"), hash_.alias("hash"))

        rolled = let(F.transform(ws, lambda w: F.xxhash64(F.get(lines, w))), lambda h: rolling(h, MIN_LINES))
        return F.filter(F.transform(rolled, lambda h, i: F.when(i > 0, pair(h, i))), lambda x: x.isNotNull())

    return let(F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(f"[^{SPACE}]"), i)), lambda i: i.isNotNull()), pairs)


def passage_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: id, cleaned ``text``, ``n_lines``, ``n_removed_lines``, ``n_removed_chars``."""
    scratch, rows = Scratch(df.sparkSession, "passage-dedup"), _numbered(df, id_col, text_col)
    chunked = rows.select("id", "row", let(F.split("text", "\n"), passages).alias("cs"))
    shared = _shared(scratch, chunked)
    first = _first(scratch, shared, F.struct("id", "row", "key"))
    stays = F.struct("id", "row").eqNullSafe(F.struct("first.id", "first.row")) & (_start(F.col("key")) < _end(F.col("first.key")))
    gone = shared.join(first, ["hash", "text"]).where(~stays)

    def rest(lines: Column, keys: Column) -> Column:
        out = F.flatten(F.transform(keys, lambda k: F.sequence(_start(k), _end(k) - 1)))
        return F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), out), lambda i: F.get(lines, i))

    return _without(scratch, rows, gone, rest, id_col)
