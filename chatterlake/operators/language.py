"""Languages: dictionary, target lists, filters."""

from pyspark.sql import functions as F

from ..functions.fixed_values import LANGUAGE_CONFIDENCE, LANGUAGE_NAMES


def supported_languages(spark):
    """The 20 named languages as a frame (`language`, `language_name`)."""
    return spark.createDataFrame(list(LANGUAGE_NAMES.items()), "language string, language_name string")


def with_language_name(df, language_col="language", name_col="language_name"):
    """Add the language's name, or the code itself when it has none.

    The dictionary is a fixed table of 20 rows, so it is always broadcast.
    """
    names = supported_languages(df.sparkSession).select(
        F.col("language").alias("_code"), F.col("language_name").alias("_name")
    )
    return (
        df.join(F.broadcast(names), F.col(language_col) == F.col("_code"), "left")
        .withColumn(name_col, F.coalesce("_name", language_col))
        .drop("_code", "_name")
    )


def parse_targets(languages):
    """`'EN, fr'` to `['en', 'fr']`; nothing given means no restriction."""
    if not languages:
        return []
    parts = languages.split(",") if isinstance(languages, str) else languages
    return [part.strip().lower() for part in parts]


def unsupported_targets(spark, languages):
    """Target languages that the dictionary does not know."""
    targets = spark.createDataFrame([(t,) for t in parse_targets(languages)], "language string")
    return targets.join(F.broadcast(supported_languages(spark)), "language", "left_anti")


def is_wanted_language(languages=None, min_confidence=LANGUAGE_CONFIDENCE,
                       language_col="language", confidence_col="language_confidence"):
    """True for rows in a target language (all, if none is given) with enough confidence."""
    targets = parse_targets(languages)
    confident = F.col(confidence_col) >= min_confidence
    return (F.col(language_col).isin(targets) & confident) if targets else confident


def keep_languages(df, languages=None, min_confidence=LANGUAGE_CONFIDENCE,
                   language_col="language", confidence_col="language_confidence"):
    """Rows in a target language with enough confidence."""
    return df.filter(is_wanted_language(languages, min_confidence, language_col, confidence_col))


def keep_english(df, language_col="language"):
    """English rows only."""
    return df.filter(F.col(language_col) == "en")
