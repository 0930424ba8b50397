"""Parquet sink with codec choice, skip rule and read-back check."""

from ..functions.fixed_values import CODECS
from .storage import path_exists


def write_parquet(df, path, compression="snappy", overwrite=False):
    """Write Parquet; False when the target exists and `overwrite` is not set."""
    if compression not in CODECS:
        raise ValueError(f"Unknown compression {compression!r}; known: {', '.join(CODECS)}")
    if not overwrite and path_exists(df.sparkSession, path):
        return False
    try:
        df.write.mode("overwrite").option("compression", compression).parquet(path)
    except Exception as error:
        if compression == "brotli" and "rotli" in str(error):
            raise ValueError("The brotli codec needs its library on Spark's class path") from error
        raise
    return True


def verify_parquet(spark, path):
    """True when the table can be read and holds at least one row."""
    try:
        return not spark.read.parquet(path).isEmpty()
    except Exception:
        return False
