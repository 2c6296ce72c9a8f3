"""Column helpers shared by the corpus operators."""

from __future__ import annotations

import re
import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as a Java character class, without its brackets.
SPACE = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once for each row.

    A lambda that names an outer expression would evaluate it for every element;
    a bound lambda variable is evaluated once.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def pick(df: DataFrame, name: str) -> Column:
    """A column by its exact name, whatever characters the name holds."""
    return df["`" + name.replace("`", "``") + "`"]


def pack(df: DataFrame, name: str = "_row") -> Column:
    """All columns of a frame in one struct, so that no operator column can clash with them."""
    return F.struct(*[pick(df, c).alias(c) for c in df.columns]).alias(name)


#: Members of the Unicode classes among the characters below U+0100.
_LATIN = {r"\p{L}": "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff", r"\p{N}": "0-9\u00b2\u00b3\u00b9\u00bc-\u00be", r"\s": "\t-\r \u0085\u00a0"}


def latin_twin(pattern: str) -> re.Pattern | None:
    """A pattern that finds the same in texts of characters below U+0100, for the faster standard matcher.

    It replaces the classes ``\\p{L} \\p{N} \\s \\S`` by their members; None if the pattern has other
    escapes than these.
    """
    out, inside, at = [], False, 0
    while at < len(pattern):
        token = next((k for k in (*_LATIN, r"\S") if pattern.startswith(k, at)), pattern[at])
        if token == "\\" or token == r"\S" and inside:
            return None
        inside = token == "[" or inside and token != "]"
        if token == r"\S":
            out.append(f"[^{_LATIN[r'\s']}]")
        elif token in _LATIN:
            out.append(_LATIN[token] if inside else f"[{_LATIN[token]}]")
        else:
            out.append(token)
        at += len(token)
    return re.compile("".join(out))


def is_latin(text: str) -> bool:
    """All characters below U+0100."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True
