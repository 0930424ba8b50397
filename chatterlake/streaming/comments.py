"""Cleaning and labelling of comment files as they arrive.

Every step is row-wise, so no state and no watermark is needed; the same operators
serve finite tables.
"""

from ..operators.cleaning import keep_clean
from ..operators.coerce import apply_plan
from ..operators.labels import with_label


def prepare_stream(df, text_col="comment", keywords=(), label_type=None, type_plan=None):
    """Clean a (streaming) frame, with types fixed by a plan and a label if asked for."""
    if type_plan:
        df = apply_plan(df, type_plan)
    cleaned = keep_clean(df, text_col, keywords)
    return with_label(cleaned, label_type, text_col) if label_type else cleaned


def write_stream(df, path, checkpoint):
    """Append a prepared stream to Parquet, taking what is there and then stopping."""
    return (
        df.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start(path)
    )
