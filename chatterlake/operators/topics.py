"""Word counts and topics."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.fixed_values import DEFAULT_TOPICS, MIN_TOKEN_LENGTH, STOP_WORDS
from ..functions.text import words
from .language import with_language_name
from .stats import top_groups


def topic_words(df, text_col="cleaned_text", keep=()):
    """One row per counted word: three characters or more, no English stop word."""
    exploded = df.select(*keep, F.explode(words(text_col, MIN_TOKEN_LENGTH)).alias("topic"))
    return exploded.filter(~F.col("topic").isin(STOP_WORDS))


def word_counts(df, text_col="cleaned_text"):
    """Occurrences of each word over all texts, counted per task before the shuffle."""
    return topic_words(df, text_col).groupBy("topic").agg(F.count("*").alias("count"))


def top_words(df, n=DEFAULT_TOPICS, text_col="cleaned_text"):
    """The `n` most frequent words; ties by word."""
    return word_counts(df, text_col).orderBy(F.desc("count"), F.asc("topic")).limit(n)


def ranked_topics(df, n=DEFAULT_TOPICS, text_col="cleaned_text"):
    """`top_words` with a rank from 1; the window sees `n` rows."""
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("count"), F.asc("topic"))
    return top_words(df, n, text_col).select(F.row_number().over(order).alias("rank"), "topic", "count")


def frequent_languages(df, k=5, language_col="language"):
    """The `k` languages with most rows, from the language column alone."""
    return top_groups(df.dropna(subset=[language_col]), language_col, k).select(language_col)


def language_word_counts(df, languages, text_col="cleaned_text", language_col="language"):
    """Occurrences of each word per language, for the given few languages.

    `languages` is a handful of rows and is broadcast. Words are counted per task before
    the shuffle, so a language that holds most rows costs later steps only its distinct words.
    """
    kept = df.join(F.broadcast(languages), language_col, "left_semi")
    return topic_words(kept, text_col, keep=[language_col]).groupBy(language_col, "topic").agg(F.count("*").alias("count"))


def rank_topics(counts, n_topics=DEFAULT_TOPICS, language_col="language"):
    """The most frequent words of each language; Spark cuts to `n_topics` per task ahead of the shuffle."""
    order = Window.partitionBy(language_col).orderBy(F.desc("count"), F.asc("topic"))
    ranked = counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n_topics)
    return with_language_name(ranked, language_col).select(language_col, "language_name", "rank", "topic", "count")


def with_weights(topics, language_col="language"):
    """Add each word's count over the language's largest count; the input is ranked and small."""
    largest = F.max("count").over(Window.partitionBy(language_col))
    return topics.withColumn("weight", F.round(F.col("count") / largest, 6))


def topics_by_language(df, n_languages=5, n_topics=DEFAULT_TOPICS, text_col="cleaned_text", language_col="language"):
    """The most frequent words of each of the most frequent languages."""
    languages = frequent_languages(df, n_languages, language_col)
    return rank_topics(language_word_counts(df, languages, text_col, language_col), n_topics, language_col)


def topics_chart(df, text_col="cleaned_text", language_col="language"):
    """Bar-chart data: 15 words for each of the 3 most frequent languages."""
    return topics_by_language(df, 3, 15, text_col, language_col)


def word_cloud(df, text_col="cleaned_text", language_col="language"):
    """Word-cloud data: 100 words for each of the 5 most frequent languages, with weights."""
    return with_weights(topics_by_language(df, 5, 100, text_col, language_col), language_col)


def topic_metadata(topics):
    """Nest ranked topics per language as `{"languages": {code: {name, topics: […]}}}`.

    The input is small by construction (languages times topics), one row results.
    """
    listed = F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "topic", "count"))),
        lambda t: F.struct(t["topic"].alias("topic"), t["count"].alias("count")),
    )
    per_language = topics.groupBy("language", "language_name").agg(listed.alias("topics"))
    entry = F.struct(F.col("language"), F.struct(F.col("language_name").alias("name"), F.col("topics")))
    return per_language.agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("languages"))


def overall_topic_metadata(topics):
    """Nest ranked topics as `{"topics": […]}`, the form for a single language."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "topic", "count")))
    return topics.agg(
        F.transform(
            ordered, lambda t: F.struct(t["topic"].alias("topic"), t["count"].alias("count"))
        ).alias("topics")
    )
