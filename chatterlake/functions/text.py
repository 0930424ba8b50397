"""Text columns: stripping, gates, truncation, words and character grams."""

from pyspark.sql import functions as F

from .fixed_values import (
    BLANK_TEXT_WORD,
    MAX_SENTIMENT_TEXT,
    MIN_LANGUAGE_TEXT_LENGTH,
    MIN_TEXT_LENGTH,
    NOT_SPACE,
    TRUNCATION_MARK,
    WORD,
)


def as_column(value):
    return F.col(value) if isinstance(value, str) else value


def strip(text):
    """Text without Unicode whitespace at either end.

    Matches from the first to the last visible character, which stays linear on
    long inner runs of whitespace (two anchored replacements would not).
    """
    return F.regexp_extract(as_column(text), f"(?s){NOT_SPACE}(?:.*{NOT_SPACE})?", 0)


def stripped_length(text):
    """Characters left after `strip`."""
    return F.char_length(strip(text))


def has_stripped_length(text, minimum):
    """True when the stripped text has at least `minimum` (>= 2) characters; NULL is false."""
    pattern = f"(?s){NOT_SPACE}.{{{minimum - 2},}}{NOT_SPACE}"
    return F.coalesce(as_column(text).rlike(pattern), F.lit(False))


def is_valid_text(text):
    """Gate in front of cleaning: three visible-bounded characters at least."""
    return has_stripped_length(text, MIN_TEXT_LENGTH)


def is_language_text(text):
    """Gate in front of language scoring: five characters at least."""
    return has_stripped_length(text, MIN_LANGUAGE_TEXT_LENGTH)


def fill_missing(text):
    """Missing text becomes the empty string."""
    return F.coalesce(as_column(text), F.lit(""))


def truncate_text(text, max_length=MAX_SENTIMENT_TEXT, mark=TRUNCATION_MARK):
    """Cut texts longer than `max_length` and append `mark`."""
    text = as_column(text)
    return F.when(
        F.char_length(text) > max_length,
        F.concat(F.substring(text, 1, max_length), F.lit(mark)),
    ).otherwise(text)


def fill_blank(text, word=BLANK_TEXT_WORD):
    """Missing or whitespace-only text becomes the given word before scoring."""
    text = as_column(text)
    return F.when(F.coalesce(text.rlike(NOT_SPACE), F.lit(False)), text).otherwise(F.lit(word))


def words(text, min_length=1):
    """Lower-cased runs of word characters with at least `min_length` characters.

    Replacing every other visible character by a space and splitting on
    whitespace leaves exactly these runs, so one extraction does all of it.
    """
    return F.regexp_extract_all(F.lower(as_column(text)), F.lit(f"{WORD}{{{min_length},}}"), F.lit(0))


def char_grams(text, n=3):
    """All overlapping runs of `n` characters of the lower-cased text, in linear time.

    The text is cut into pieces of `n` from each of the first `n` characters on.
    """
    lowered = F.lower(as_column(text))
    cut = F.lit("(?s)" + "." * n)
    return F.concat(*[F.regexp_extract_all(F.substr(lowered, F.lit(i + 1)), cut, F.lit(0)) for i in range(n)])


def chunks(text, size, overlap=0):
    """The lower-cased text as an array of chunks, one alone for a text of at most `size` characters.

    Chunks have `size` characters and the `overlap` characters that follow, so that runs of
    `overlap + 1` characters each stand in exactly one; without an overlap a chunk goes on to the end
    of the word it stops at or before, so that each word does. Fixed counts keep the patterns
    free of recursion, whatever characters there are.
    """
    text = as_column(text)
    if overlap:
        pattern, group = f"(?s)(?=(.{{{size + overlap}}}|.+))(?:.{{{size}}}|.+)", 1
    else:
        pattern, group = f"(?s)(?:.{{{size}}}|.+){WORD}*+", 0
    cut = F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(group))
    return F.when(F.char_length(text) > size, cut).otherwise(F.array(F.lower(text)))


def percent(part, whole, digits=1):
    """`part` as a percentage of `whole`; NULL when `whole` is zero."""
    return F.round(100.0 * as_column(part) / F.nullif(as_column(whole), F.lit(0)), digits)
