"""Spam rules as boolean columns over lower-cased text, all JVM-side."""

import os
import re

import pandas as pd
from pyspark.sql import functions as F

from .fixed_values import SPACE, SPACE_CHARS, WORD
from .tandem import repeated_passage
from .text import as_column, is_valid_text

REASONS = ("too_short", "keyword", "repeated_letters", "repeated_words", "repeated_sentences")


def needed_keywords(keywords):
    """Distinct lower-case keywords without those that contain another one.

    A text holding `visit puerto rico` also holds `visit`, so only the shorter
    phrase has to be looked for. Each keyword's own parts are looked up in the list, so the
    cost follows its length and not the number of keywords.
    """
    words = {k.lower() for k in keywords if k}
    sizes = sorted({len(k) for k in words})

    def holds_other(word):
        return any(word[i : i + n] in words for n in sizes if n < len(word) for i in range(len(word) - n + 1))

    return sorted(w for w in words if not holds_other(w))


def prefix_pattern(tails):
    """Alternation over sorted strings with common prefixes written once."""
    if "" in tails:
        return ""
    groups = {}
    for tail in tails:
        groups.setdefault(tail[0], []).append(tail)
    branches = []
    for group in groups.values():
        prefix = os.path.commonprefix(group)
        branches.append(re.escape(prefix) + prefix_pattern([t[len(prefix):] for t in group]))
    return branches[0] if len(branches) == 1 else "(?:" + "|".join(branches) + ")"


def keyword_pattern(keywords):
    """One pattern that finds any of the keywords as a substring.

    The leading lookahead rejects most positions on their first character, so the
    cost per text hardly depends on the number of keywords.
    """
    keywords = needed_keywords(keywords)
    heads = "".join(sorted({re.escape(k[0]) for k in keywords}))
    return f"(?=[{heads}])" + prefix_pattern(keywords)


def contains_any(text, keywords):
    """True when the text holds any keyword as a substring; `keywords` are lower-case."""
    keywords = list(keywords)
    if not any(keywords):
        return F.lit(False)
    return as_column(text).rlike(keyword_pattern(keywords))


def repeated_letters(text):
    """Four or more equal characters in a row (line feeds do not count)."""
    return as_column(text).rlike(r"(?d)(.)\1{3}")


def repeated_words(text):
    """A word directly followed by itself, with only whitespace between."""
    return as_column(text).rlike(rf"(?<!{WORD})({WORD}+){SPACE}+\1(?!{WORD})")


def _repeated_passages():
    """An Arrow function: does a text hold a passage with an inner dot twice in a row?"""

    @F.pandas_udf("boolean")
    def passages(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else repeated_passage(t)).astype("boolean")

    return passages


def repeated_sentences(text):
    """A passage ending in a dot directly followed by itself (`nice. nice.`).

    Passages without an inner dot are searched on the reversed text, where every candidate
    starts at a dot, in linear time; whitespace at the start of a passage can always count as
    separator instead, so a candidate ends (read backwards) in a visible character, or is
    a single space. The lookahead rejects a dot unless the characters in front of this
    dot and of the one before are the same. A passage with inner dots needs equal segments
    between dots; only texts that have some reach the Arrow function.
    """
    text = as_column(text)
    one_sentence = F.reverse(text).rlike(
        rf"\.(?=([^.])[^.]*+\.\1)(?:([^.\n]*[^.\n{SPACE_CHARS}]){SPACE}+\.\2|([{SPACE_CHARS}&&[^\n]]){SPACE}+\.\3)"
    )
    segments = F.split(text, r"\.")
    may_hold = (F.size(segments) > 4) & (F.size(F.array_distinct(segments)) < F.size(segments))
    return one_sentence | F.coalesce(_repeated_passages()(F.when(may_hold, text)), F.lit(False))


def native_reason(text, lowered, keywords=()):
    """Name of the first rule before that of repeated sentences that rejects the text, else NULL."""
    return (
        F.when(~is_valid_text(text), REASONS[0])
        .when(contains_any(lowered, keywords), REASONS[1])
        .when(repeated_letters(lowered), REASONS[2])
        .when(repeated_words(lowered), REASONS[3])
    )


def spam_reason(lowered, native):
    """Name of the first rule that rejects the text, NULL for a clean one, given the `native_reason`.

    Texts rejected before are NULL to the sentence rule, so they do not reach its Arrow function.
    """
    left = F.when(native.isNull(), lowered)
    return F.coalesce(native, F.when(repeated_sentences(left), REASONS[4]))
