"""License scan by ordered signature rules, in DataFrame functions only.

A text is a sequence of words (A-Z lower-cased; ASCII letters and digits and everything
beyond ASCII).  The rules of :mod:`license_rules` are regular expressions over words joined by
one space; each starts with one of its gate words.  Where a gate word stands, and only there,
the rules of that word are tried on the words from there on: as many as the longest match of
any rule has, which is computed from the rules, and one more to look at.  A text that holds
none of the ``KEYWORDS``, one of which every rule and base phrase needs, is not even split
into words.

Overlaps: of the rules that match at one word, the one of highest priority, then the longest,
then the first in the list counts.  A detection that lies inside another of the same or a
higher priority is suppressed; only as many detections before it as the longest match has
words can contain it.

Base phrases are plain word sequences; all their places count and none is suppressed.

Defined cases: a null text is empty; an empty text has no words, no labels and score 0;
an empty table gives an empty result; repeated rows are alike; a very long text is scanned to
its end, at a cost in proportion to its length; other columns are not read, whatever their
names; every step is local to its row.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_rules import KEYWORDS, longest, rules
from .text import ascii_lower, let, pick

#: The words that a rule is tried on: those of the longest match, and the next one, which some rules look at.
REACH = longest() + 1

# The base phrases and their labels.
BASE: tuple[tuple[str, str], ...] = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))


def normal(text: Column) -> Column:
    """The words of a text joined by one space."""
    return F.trim(F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))


def _blocks() -> dict[tuple[str, ...], list]:
    """The rules of each set of gate words, in order; a gate word is in one set."""
    by: dict[tuple[str, ...], list] = {}
    for order, (gates, pattern, label, priority, confidence) in enumerate(rules()):
        by.setdefault(gates, []).append({"pattern": f"^({pattern})(?= |$)", "label": label, "priority": priority, "confidence": confidence, "order": -order})
    assert len({g for gates in by for g in gates}) == sum(map(len, by))
    return by


def _gated() -> Column:
    """Literal of gate words with their block, and blocks of rules; one expression, folded once."""
    by = _blocks()
    told = {"gates": {g: k for k, gates in enumerate(by) for g in gates}, "blocks": list(by.values())}
    return F.from_json(F.lit(json.dumps(told)), "struct<gates:map<string,int>,blocks:array<array<struct<pattern:string,label:string,priority:int,confidence:double,order:int>>>>")


def _gate_pattern() -> str:
    """A regular expression that matches gate words alone, by first letter."""
    by: dict[str, list[str]] = {}
    for g in sorted(g for gates in _blocks() for g in gates):
        by.setdefault(g[0], []).append(g[1:])
    return "^(?:" + "|".join(f"{first}(?:{'|'.join(rest)})" for first, rest in by.items()) + ")$"


_DETECTION = "array<struct<start:int,end:int,label:string,priority:int,confidence:double>>"


def detections(words: Column) -> Column:
    """Kept detections of a word array: (start, end, label, priority, confidence), by start."""
    gate_pattern = _gate_pattern()

    def at_word(i: Column, table: Column, ws: Column) -> Column:
        context = F.array_join(F.slice(ws, i + 1, F.lit(REACH)), " ")

        def tried(text: Column) -> Column:
            def match(r: Column) -> Column:
                found = F.regexp_substr(text, r["pattern"])
                return F.struct(r["priority"].alias("priority"), F.length(found).alias("size"), r["order"].alias("order"), found.alias("found"), r["label"].alias("label"), r["confidence"].alias("confidence"))

            return F.array_max(F.filter(F.transform(F.get(table["blocks"], table["gates"][F.get(ws, i)]), match), lambda h: h["size"] > 0))

        return let(let(context, tried), lambda h: F.struct(
            i.alias("start"), (i + 1 + F.length(h["found"]) - F.length(F.replace(h["found"], F.lit(" "), F.lit("")))).alias("end"),
            h["label"].alias("label"), h["priority"].alias("priority"), h["confidence"].alias("confidence")))

    def all_of(ws: Column) -> Column:
        places = F.filter(F.transform(ws, lambda w, i: F.when(w.rlike(gate_pattern), i)), lambda i: i.isNotNull())
        return F.filter(let(_gated(), lambda table: F.transform(places, lambda i: at_word(i, table, ws))), lambda d: d["label"].isNotNull())

    def kept(found: Column) -> Column:
        def inside(d: Column, i: Column) -> Column:
            before = F.slice(found, F.greatest(i - (REACH - 2), F.lit(1)), F.least(i, F.lit(REACH - 1)))
            return F.exists(before, lambda p: (p["end"] >= d["end"]) & (p["priority"] >= d["priority"]))

        return F.filter(found, lambda d, i: ~F.when(i > 0, inside(d, i)).otherwise(F.lit(False)))

    return let(let(words, all_of), kept).cast(_DETECTION)


def base_places(words: Column) -> Column:
    """All places of the base phrases: (start, label), by start."""

    def of(ws: Column) -> Column:
        def at(w: Column, i: Column) -> Column:
            out = F.lit(None).cast("struct<start:int,label:string>")
            for phrase, label in BASE:  # no two phrases begin with one word
                first, *others = phrase.split()
                same = w == first
                for k, x in enumerate(others, 1):
                    same = same & (F.get(ws, i + k) == x)
                out = F.when(same, F.struct(i.alias("start"), F.lit(label).alias("label"))).otherwise(out)
            return out

        return F.filter(F.transform(ws, at), lambda p: p.isNotNull())

    return let(words, of)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: id, n_words, ``base`` (start, label), ``detections``
    (start, end, label, priority, confidence), ``labels`` (sorted), ``score``.

    The score is the highest confidence of a kept detection, 0.6 for a base phrase.
    """
    rows = df.select(pick(df, id_col).alias(id_col), normal(pick(df, text_col)).alias("_text"))
    rows = rows.withColumn("_padded", F.concat(F.lit(" "), "_text", F.lit(" ")))
    gate = F.lit(False)
    for keyword in reversed(KEYWORDS):
        gate = F.contains("_padded", F.lit(keyword)) | gate
    words = F.when(gate, F.split("_text", " ")).otherwise(F.array().cast("array<string>"))
    found = rows.select(
        id_col, F.when(F.col("_text") == "", F.lit(0)).otherwise(F.length("_text") - F.length(F.replace("_text", F.lit(" "), F.lit(""))) + 1).cast("long").alias("n_words"),
        let(words, lambda ws: F.when(F.size(ws) > 0, F.struct(base_places(ws).alias("base"), detections(ws).alias("detections")))).alias("_found"),
    )
    base = F.coalesce(F.col("_found.base"), F.array().cast("array<struct<start:int,label:string>>"))
    kept = F.coalesce(F.col("_found.detections"), F.array().cast(_DETECTION))
    wide = found.select(id_col, "n_words", base.alias("base"), kept.alias("detections"))
    return wide.select(
        "*", F.array_sort(F.array_union(F.transform("base", lambda p: p["label"]), F.transform("detections", lambda d: d["label"]))).alias("labels"),
        F.coalesce(F.array_max(F.concat(F.transform("detections", lambda d: d["confidence"]), F.transform("base", lambda _: F.lit(0.6)))), F.lit(0.0)).alias("score"),
    )
