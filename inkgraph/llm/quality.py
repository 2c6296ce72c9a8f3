"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule reads a few features of the text.  :func:`plan_cascade` measures every rule on a
bounded sample: the share of rows that it rejects, and what it costs.  For the cost, a job
evaluates the rule so many times a row that it takes several times as long as a job without
it; the difference counts, the best of a few runs, as a power of two so that noise does not
decide.  The rules then run in the order of rejection per cost, nested so that a row which one
rule rejects is never shown to the next.  The order changes the cost alone: a row is kept when
all rules pass it.

Defined cases: a null text has no words and fails; an empty table gives an empty result;
ties in the measured order fall back to the rules' names; repeated rows are judged alike;
very long texts are read whole; other columns stay as they are, whatever their names, and a
text that the features do not need is not looked at.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import SPACE, let, pick

SYMBOLS = "#*$%&|<>"
SAMPLE_ROWS = 2000
RUNS = 3
MOST_TIMES = 16


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, f"[{SPACE}]+"), "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def word_chars(text: Column) -> Column:
    return F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long")


def n_symbols(text: Column) -> Column:
    return (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long")


def _worded_lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))


def n_lines(text: Column) -> Column:
    return F.size(_worded_lines(text)).cast("long")


def n_dup_lines(text: Column) -> Column:
    return let(_worded_lines(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def n_repeat_words(text: Column, width: int = 3) -> Column:
    """Words that stand in a window of ``width`` words which the text holds twice or more.

    Windows are compared by a 64-bit hash; sorting (hash, place) puts equal ones side by
    side, and the places of those count the words they cover once each.
    """

    def windows(ws: Column) -> Column:
        return F.transform(F.slice(ws, F.lit(1), F.size(ws) - (width - 1)), lambda w, i: F.xxhash64(w, *[F.get(ws, i + k) for k in range(1, width)]))

    def covered(hashes: Column) -> Column:
        ranked = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        places = let(ranked, lambda r: F.sort_array(F.transform(F.filter(r, lambda x, j: (F.coalesce(F.get(r, j - 1)["h"] == x["h"], F.lit(False))) | (F.coalesce(F.get(r, j + 1)["h"] == x["h"], F.lit(False)))), lambda x: x["i"])))
        start = F.struct(F.lit(-width).alias("at"), F.lit(0).alias("n"))
        return F.aggregate(places, start, lambda acc, p: F.struct(p.alias("at"), (acc["n"] + F.least(F.lit(width), p - acc["at"])).alias("n")), lambda acc: acc["n"])

    def counted(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(covered(hashes))

    return let(words(text), lambda ws: F.when(F.size(ws) < width, F.lit(0)).otherwise(let(windows(ws), counted))).cast("long")


FEATURES: dict[str, Callable[[Column], Column]] = {
    "n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_lines": n_lines, "n_dup_lines": n_dup_lines, "n_repeat_words": n_repeat_words,
}


@dataclass(frozen=True)
class Rule:
    """``test`` gets a function from feature names to columns and gives a boolean: the row passes."""

    name: str
    test: Callable[[Callable[[str], Column]], Column]


RULES: tuple[Rule, ...] = (
    Rule("enough_words", lambda f: f("n_words") >= 50),
    Rule("few_repeats", lambda f: 100 * f("n_repeat_words") <= 50 * f("n_words")),
    Rule("few_symbols", lambda f: 10 * f("n_symbols") <= f("n_words")),
    Rule("word_length", lambda f: f("word_chars").between(2.5 * f("n_words"), 12 * f("n_words"))),
    Rule("few_dup_lines", lambda f: 2 * f("n_dup_lines") <= f("n_lines")),
)


def from_text(text: Column) -> Callable[[str], Column]:
    """Features computed where a rule asks for them."""
    known = F.coalesce(text, F.lit(""))
    return lambda name: FEATURES[name](known)


def _seconds(texts: DataFrame, test: Column, times: int, sample_rows: int) -> float:
    """Seconds of one job that evaluates ``test`` so many times for each of the first rows."""
    began = time.perf_counter()
    texts.select("text", F.explode(F.sequence(F.lit(1), F.lit(times)))).select(test.alias("passed")).limit(sample_rows * times).collect()
    return time.perf_counter() - began


def cost_of(texts: DataFrame, test: Column, idle: float, sample_rows: int = SAMPLE_ROWS, runs: int = RUNS) -> float:
    """Seconds that one evaluation of ``test`` over the sample takes, beyond what an idle job of ``idle`` seconds does."""
    times = 1
    while (took := _seconds(texts, test, times, sample_rows)) < 4 * idle and times < MOST_TIMES:
        times *= 4
    return max(min([took, *(_seconds(texts, test, times, sample_rows) for _ in range(runs - 1))]) - idle, idle / 100) / times


def plan_cascade(df: DataFrame, text_col: str = "text", rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by rejection per cost, both measured on ``sample_rows`` rows at most.

    The sample is the first rows that a limit finds: partitions are read one after the other until
    there are enough, and the driver gets booleans, no texts.
    """
    texts, get = df.select(pick(df, text_col).alias("text")), from_text(F.col("text"))
    seen = texts.select(*[(~rule.test(get)).alias(f"r{k}") for k, rule in enumerate(rules)]).limit(sample_rows).collect()
    idle_test = F.length("text") < 0
    _seconds(texts, idle_test, 1, sample_rows)
    idle = min(_seconds(texts, idle_test, 1, sample_rows) for _ in range(RUNS))
    measured = []
    for k, rule in enumerate(rules):
        rejected = sum(bool(r[k]) for r in seen)
        cost = 2.0 ** round(math.log2(cost_of(texts, rule.test(get), idle, sample_rows))) if rejected else 1.0
        measured.append((-rejected / max(len(seen), 1) / cost, rule.name, rule))
    return [rule for _, _, rule in sorted(measured, key=lambda x: x[:2])]


def cascade(order: Sequence[Rule], get: Callable[[str], Column]) -> Column:
    """True when every rule passes; a rule is evaluated only for rows that all before it passed."""
    verdict = F.lit(True)
    for rule in reversed(order):
        verdict = F.when(rule.test(get), verdict).otherwise(F.lit(False))
    return verdict


def keep_good(df: DataFrame, text_col: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """The rows that all rules pass, with the input's columns."""
    return df.where(cascade(plan_cascade(df, text_col, rules), from_text(pick(df, text_col))))


def measure(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Sequence[Rule] = RULES, features: Sequence[str] = tuple(FEATURES)) -> DataFrame:
    """Every row's id, the named features and the verdict; other features are computed where a rule of the cascade gets to them."""
    text = F.coalesce(pick(df, text_col), F.lit(""))
    wide = df.select(pick(df, id_col).alias("_id"), text.alias("_text"), *[FEATURES[name](text).alias(name) for name in features])
    verdict = cascade(plan_cascade(df, text_col, rules), lambda name: F.col(name) if name in features else FEATURES[name](F.col("_text")))
    return wide.select(F.col("_id").alias(id_col), *features, verdict.alias("kept"))
