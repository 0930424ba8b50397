"""Keyword labels."""

from pyspark.sql import functions as F

from ..functions.fixed_values import TOURISM_PHRASES
from ..functions.spam import contains_any
from ..functions.text import percent

_KEYWORD_SETS = {"tourism": list(TOURISM_PHRASES)}


def register_label_type(name, keywords):
    """Add a keyword set; the type's name is matched without regard to case."""
    _KEYWORD_SETS[name.lower()] = [k.lower() for k in keywords]


def label_types():
    return sorted(_KEYWORD_SETS)


def keywords_of(label_type):
    """Keywords of a label type; an unknown type is an error that names the known ones."""
    try:
        return _KEYWORD_SETS[label_type.lower()]
    except KeyError:
        raise ValueError(
            f"No keyword set is registered as {label_type!r}; there are: {', '.join(label_types())}"
        ) from None


def with_label(df, label_type="tourism", text_col="comment", keywords=None):
    """Add `<type>_related`: 1 when the text holds any keyword, else 0; missing text gives 0."""
    chosen = keywords_of(label_type) if keywords is None else [k.lower() for k in keywords]
    hit = contains_any(F.lower(F.col(text_col)), chosen)
    return df.withColumn(f"{label_type}_related", F.coalesce(hit.cast("int"), F.lit(0)))


def label_summary(df, label_col):
    """Matches and non-matches with percentages."""
    return summary_of_counts(
        df.agg(F.count("*").alias("total"), F.coalesce(F.sum(F.col(label_col).cast("bigint")), F.lit(0)).alias("matches"))
    )


def summary_of_counts(counts):
    """The summary for a row of `total` and `matches`."""
    return (
        counts
        .withColumn("non_matches", F.col("total") - F.col("matches"))
        .withColumn("match_share", percent("matches", "total", 2))
        .withColumn("non_match_share", percent("non_matches", "total", 2))
    )
