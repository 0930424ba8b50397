"""Keyword lists."""

import warnings

from pyspark.sql import functions as F

from ..functions.text import strip
from .storage import path_exists

# Lists up to this length are put into the plan as one pattern.
MAX_PATTERN_KEYWORDS = 50_000


def read_keywords(spark, path):
    """One keyword per line, stripped and lower-cased; no file means no keywords.

    A path without a file turns the keyword rule off as well, with a warning.
    """
    if path and not path_exists(spark, path):
        warnings.warn(f"No keyword file at {path}: comments are not filtered by keywords", stacklevel=2)
        path = None
    if not path:
        return spark.createDataFrame([], "keyword string")
    return (
        spark.read.text(path)
        .select(F.lower(strip("value")).alias("keyword"))
        .filter("keyword <> ''")
        .distinct()
    )


def keyword_list(keywords, limit=MAX_PATTERN_KEYWORDS):
    """Keywords of a frame as a list, or None when there are more than `limit`.

    Longer lists stay a table; `operators.cleaning.keyword_hits` joins with them.
    """
    rows = keywords.limit(limit + 1).collect()
    return None if len(rows) > limit else sorted(row["keyword"] for row in rows)
