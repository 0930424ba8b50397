"""Spam filtering of comment tables."""

from pyspark.sql import functions as F

from ..functions.spam import contains_any, native_reason, prefix_pattern, repeated_letters, repeated_sentences, repeated_words, spam_reason
from ..functions.text import is_valid_text, percent

_LOWERED, _NATIVE, _REASON = "_lowered_text", "_native_reason", "_any_reason"
# Keyword starts up to this number are looked for while cutting windows; beyond it,
# windows open everywhere and the join with the starts sorts them out.
MAX_STARTS = 20_000
# Characters of a keyword that open a window, if it has so many.
LONGEST_START = 32


def _with_lowered(df, text_col):
    """Add the lower-cased text once.

    A one-element `explode` keeps the optimizer from copying `lower` into each of
    the rules that use it; it neither adds nor drops rows.
    """
    return df.select("*", F.explode(F.array(F.lower(F.col(text_col)))).alias(_LOWERED))


def _with_reason(df, text_col, keywords):
    """Add the lower-cased text, the first native rule that rejects it, and the first of all rules."""
    native = native_reason(F.col(text_col), F.col(_LOWERED), keywords)
    checked = _with_lowered(df, text_col).select("*", F.explode(F.array(native)).alias(_NATIVE))
    return checked.withColumn(_REASON, spam_reason(F.col(_LOWERED), F.col(_NATIVE)))


def with_spam_reason(df, text_col="comment", keywords=(), reason_col="spam_reason"):
    """Add the first rule that rejects each text, NULL where none does."""
    return _with_reason(df, text_col, keywords).withColumn(reason_col, F.col(_REASON)).drop(_LOWERED, _NATIVE, _REASON)


def with_cleaned_text(df, text_col="comment", keywords=(), cleaned_col="cleaned_text"):
    """Add the lower-cased text of clean rows and NULL for spam; keeps all rows."""
    clean = F.when(F.col(_REASON).isNull(), F.col(_LOWERED))
    return _with_reason(df, text_col, keywords).withColumn(cleaned_col, clean).drop(_LOWERED, _NATIVE, _REASON)


def keep_clean(df, text_col="comment", keywords=(), cleaned_col="cleaned_text"):
    """Keep clean rows and add their cleaned text.

    The rules stand in the filter alone, cheapest first, so no rule runs twice.
    """
    lowered = F.col(_LOWERED)
    return (
        _with_lowered(df.filter(is_valid_text(text_col)), text_col)
        .filter(~contains_any(lowered, keywords))
        .filter(~repeated_letters(lowered))
        .filter(~repeated_words(lowered))
        .filter(~repeated_sentences(lowered))
        .withColumnRenamed(_LOWERED, cleaned_col)
    )


def removal_stats(df, kept):
    """Original, kept and removed rows with the removal rate, from one pass.

    `kept` is a boolean column over `df`; NULL counts as removed.
    """
    return (
        df.agg(F.count("*").alias("original_count"), F.count_if(kept).alias("kept_count"))
        .withColumn("removed_count", F.col("original_count") - F.col("kept_count"))
        .withColumn("removal_rate", percent("removed_count", "original_count", 2))
    )


def drop_missing_cleaned(df, cleaned_col="cleaned_text"):
    """Rows without a cleaned text are left out."""
    return df.dropna(subset=[cleaned_col])


def keyword_hits(df, key_col, text_col, keywords):
    """Keys of texts that hold any keyword of a table of any size.

    The way for lists too long for a pattern. Keywords are taken in classes of length (powers of
    two). A position of a text opens a window for a class if the text goes on there like some
    keyword of the class starts; the window is as long as the class's longest keyword, so
    one long keyword costs windows only where it begins. A window is cut to the lengths
    keywords with that start have and must equal a keyword. All joins are on equality and
    none multiplies rows by keywords. A frequent start is a hot key of the text side, which
    adaptive execution splits.
    """
    length = F.char_length("_keyword")
    keywords = keywords.select(F.col("keyword").alias("_keyword")).filter(length > 0)
    keywords = keywords.withColumn("_class", F.floor(F.log2(length)).cast("int"))
    classes = keywords.groupBy("_class").agg(F.min(length).alias("least"), F.max(length).alias("most")).orderBy("_class").collect()
    if not classes:
        return df.select(key_col).limit(0)
    start_lengths = {c["_class"]: min(LONGEST_START, c["least"]) for c in classes}
    start_length = F.create_map(*[F.lit(x) for pair in start_lengths.items() for x in pair])[F.col("_class")]

    starts = keywords.groupBy("_class", F.left("_keyword", start_length).alias("_start")).agg(F.collect_set(length).alias("_lengths"))
    known = {}
    for row in starts.select("_class", "_start").limit(MAX_STARTS + 1).collect():
        known.setdefault(row["_class"], []).append(row["_start"])
    complete = sum(map(len, known.values())) <= MAX_STARTS

    def windows(number, most):
        size = start_lengths[number]
        begin = f"(?:{prefix_pattern(sorted(known[number]))})" if complete else f".{{{size}}}"
        found = F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(f"(?s)(?=({begin}.{{0,{most - size}}}))."), F.lit(1))
        return F.transform(F.array_distinct(found), lambda w: F.struct(F.lit(number).alias("_class"), w.alias("_window"), F.left(w, F.lit(size)).alias("_start")))

    opened = df.select(key_col, F.explode(F.flatten(F.array(*[windows(c["_class"], c["most"]) for c in classes]))).alias("_w"))
    begun = opened.select(key_col, "_w.*").join(starts, ["_class", "_start"])
    pieces = begun.select(key_col, "_window", F.explode("_lengths").alias("_length"))
    candidates = pieces.filter(F.char_length("_window") >= F.col("_length")).select(
        key_col, F.left("_window", F.col("_length")).alias("_keyword")
    )
    return candidates.join(keywords.select("_keyword"), "_keyword", "left_semi").select(key_col).distinct()
