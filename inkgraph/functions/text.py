"""Anchor-text functions: tokens, similarity, scent rules, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Function words left out of token sets.
STOPWORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "how", "in", "into", "is", "it", "of", "on", "or", "the", "to", "with", "your", "you")
# Anchor texts that say nothing about their target.
SCENT_FREE = (
    "here", "click here", "this", "this page", "this document", "this link", "this article", "this section", "read more", "read this", "learn more", "see more", "more",
    "more info", "more information", "more details", "continue", "continue reading", "keep reading", "go here", "visit", "visit here", "link", "view", "see", "open",
    "download", "get", "click", "tap here", "the link", "the page", "the document", "source", "url", "http", "https",
)
LOW_SCENT = 0.20


def tokens(text: Column) -> Column:
    """Sorted distinct words of letters and digits, longer than one byte, without function words."""
    words = F.split(F.lower(text), r"[^\p{L}\p{Nd}]+")
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: (F.octet_length(w) > 1) & ~w.isin(*STOPWORDS))))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all tokens; 1 for two empty sets."""
    every = F.size(F.array_union(a, b))
    return F.when(every == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / every)


def normalised(anchor: Column) -> Column:
    """Lower case, white space collapsed and trimmed."""
    return F.trim(F.regexp_replace(F.lower(anchor), r"(?U)\s+", " "))


def is_scent_free(anchor: Column) -> Column:
    return normalised(anchor).isin(*SCENT_FREE)


def is_code_label(anchor: Column) -> Column:
    """Wholly in backticks, with none inside (T4)."""
    return F.regexp_replace(anchor, r"(?U)^\s+|\s+$", "").rlike(r"^`[^`]+`$")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dir_name(path: Column) -> Column:
    """The folder of a path, ``.`` at the top."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, r"/[^/]*$", "")).otherwise(F.lit("."))


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"(?i)\.md$", "")


def effective_anchor(anchor: Column, target: Column) -> Column:
    """The heading part of ``file § heading`` when the file part is empty or names the target (T5)."""
    at = F.instr(anchor, F.lit("§"))
    before = F.trim(F.substring(anchor, F.lit(1), at - 1))
    after = F.trim(F.substring(anchor, at + 1, F.length(anchor)))
    names = F.lower(F.regexp_replace(base_name(before), r"(?i)\.md$", "")) == F.lower(stem(target))
    return F.when((at > 0) & ((before == "") | names), after).otherwise(anchor)


def names_identifier(anchor: Column, target: Column) -> Column:
    """The anchor holds the target's stable identifier, its first segment with a digit, and is no path itself."""
    first = F.lower(F.element_at(F.split(stem(target), "[-_]"), 1))
    plain = ~F.contains(anchor, F.lit("/")) & ~F.contains(F.lower(anchor), F.lit(".md"))
    return plain & (F.length(first) > 1) & first.rlike("[0-9]") & F.array_contains(tokens(anchor), first)


def is_external(target: Column) -> Column:
    return F.lower(target).rlike(r"^(https?://|mailto:|ftp://|file://|data:|//)")


def is_http(target: Column) -> Column:
    return F.lower(target).rlike("^https?://")


def is_date_shape(text: Column) -> Column:
    return text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$")


def target_text(target: Column, fragment: Column) -> Column:
    """Target, ``#fragment`` or both."""
    return F.when(fragment == "", target).otherwise(F.concat(target, F.lit("#"), fragment))


def category(label: Column) -> Column:
    return F.when(label.isin("", "."), "(root)").otherwise(label)


def fixed6(x: Column) -> Column:
    """Six decimals, never an exponent."""
    return F.format_string("%.6f", x)
