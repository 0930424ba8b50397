"""Yearly data: split, label results, trends."""

import re

from pyspark.sql import functions as F

from ..functions.text import percent
from ..sources.csv import csv_options

# Date directives of `strftime` and their Spark pattern letters.
_DIRECTIVES = {
    "%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%b": "MMM", "%B": "MMMM",
    "%H": "HH", "%I": "hh", "%M": "mm", "%S": "ss", "%f": "SSSSSS", "%p": "a",
    "%j": "DDD", "%z": "xx", "%a": "E", "%A": "EEEE",
}


def spark_date_format(fmt):
    """A `%Y-%m-%d` style format as a Spark pattern; other formats are returned as given."""
    if not fmt or "%" not in fmt:
        return fmt
    pieces = re.findall(r"%.|[^%]+", fmt)
    unknown = [p for p in pieces if p.startswith("%") and p not in _DIRECTIVES]
    if unknown:
        raise ValueError(f"Unknown date directive: {unknown[0]}")
    return "".join(_DIRECTIVES.get(p) or re.sub(r"([A-Za-z]+)", r"'\1'", p) for p in pieces)


def with_year(df, date_col, date_format=None, year_col="year"):
    """Add the year of a date column (text or date type); unreadable dates give NULL."""
    source = F.col(date_col)
    pattern = spark_date_format(date_format)
    if pattern:
        parsed = F.try_to_timestamp(source.cast("string"), F.lit(pattern))
    else:
        parsed = source.try_cast("timestamp")
    return df.withColumn(year_col, F.year(parsed))


def write_by_year(df, date_col, path="yearly_data", date_format=None, mode="overwrite", file_format="parquet"):
    """Write one folder per year; rows with unreadable dates go to the NULL folder.

    In a folder that holds years already, only the years among the rows are replaced.

    The rebalance hint gathers each year into few files and splits a year that is
    larger than a partition, so neither small files nor a hot year pile up.
    """
    yearly = with_year(df, date_col, date_format).hint("rebalance", "year")
    writer = yearly.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("year")
    if file_format == "csv":
        csv_options(writer).csv(path)
    else:
        writer.format(file_format).save(path)
    return path


def rows_per_year(df, year_col="year"):
    return df.groupBy(year_col).agg(F.count("*").alias("row_count"))


def _label_shares(df, group_col, label_col):
    return (
        df.groupBy(group_col)
        .agg(
            F.count("*").alias("row_count"),
            F.coalesce(F.sum(F.col(label_col).cast("bigint")), F.lit(0)).alias("matches"),
        )
        .withColumn("match_share", percent("matches", "row_count", 2))
    )


def label_results(df, label_col="tourism_related", file_col="file"):
    """Rows, matches and share per labelled file."""
    return _label_shares(df, file_col, label_col)


def yearly_trends(df, label_col="tourism_related", year_col="year"):
    """Rows, matches and share per year."""
    return _label_shares(df, year_col, label_col)
