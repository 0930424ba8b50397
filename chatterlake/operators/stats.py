"""Distributions, counts, samples and unions."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.fixed_values import SAMPLE_SEED
from ..functions.text import as_column, percent
from .language import keep_english, with_language_name

# Samples up to this many rows are sorted directly; a larger sample is cut by hash range,
# which chooses the same rows.
DIRECT_SAMPLE_ROWS = 10_000
_HASH_DIGITS = 32
_RANGE_DIGITS = 4
_COPIES_PER_TASK = 1_000_000


def group_counts(df, column, count_col="count"):
    """Rows per value; one small shuffle after map-side counting."""
    return df.groupBy(column).agg(F.count("*").alias(count_col))


def distribution(df, column, digits=1, count_col="count", share_col="share"):
    """Rows per value with the percentage of all rows, most frequent first.

    The total is a scalar subquery over the counted groups: no cross join and no
    window over a single partition.
    """
    return _shares(df, column, digits, count_col, share_col).orderBy(F.desc(count_col), F.asc(column))


def _shares(df, column, digits, count_col="count", share_col="share"):
    counts = group_counts(df, column, count_col)
    total = counts.select(F.sum(count_col)).scalar()
    return counts.withColumn(share_col, percent(count_col, total, digits))


def language_distribution(df, language_col="language", digits=1):
    """Language counts with names and shares."""
    named = with_language_name(_shares(df, language_col, digits), language_col)
    return named.select(language_col, "language_name", "count", "share").orderBy(
        F.desc("count"), F.asc(language_col)
    )


def sentiment_distribution(df, label_col="sentiment_label", digits=2):
    """Sentiment counts and shares over all rows."""
    return distribution(df, label_col, digits)


def english_sentiment_distribution(df, label_col="sentiment", language_col="language", digits=1):
    """Sentiment counts and shares over English rows that have a sentiment."""
    return distribution(keep_english(df, language_col).dropna(subset=[label_col]), label_col, digits)


def top_groups(df, column, k, count_col="count"):
    """The `k` most frequent values; ties by value."""
    return group_counts(df, column, count_col).orderBy(F.desc(count_col), F.asc(column)).limit(k)


def distinct_values(df, column, alias="distinct_count"):
    """Distinct values, a missing value counting as one."""
    return df.select(column).distinct().agg(F.count("*").alias(alias))


def row_count(df, alias="row_count"):
    """Rows of a table."""
    return df.agg(F.count("*").alias(alias))


def daily_counts(df, timestamp_col="timestamp", count_col="count"):
    """Rows per day, with zero for days without rows between the first and the last.

    Only per-day counts are joined with the day spine, which is one row per day.
    """
    per_day = (
        df.select(F.to_date(timestamp_col).alias("day"))
        .dropna()
        .groupBy("day")
        .agg(F.count("*").alias("_n"))
    )
    spine = (
        per_day.agg(F.min("day").alias("first"), F.max("day").alias("last"))
        .filter(F.col("first").isNotNull())
        .select(F.explode(F.sequence("first", "last", F.expr("interval 1 day"))).alias("day"))
    )
    return spine.join(per_day, "day", "left").select(
        "day", F.coalesce("_n", F.lit(0)).cast("bigint").alias(count_col)
    )


def sample_key(key, seed=SAMPLE_SEED):
    """Repeatable pseudo-random sort key of a row; a missing key counts as empty."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(as_column(key).cast("string"), F.lit(""))))


def row_key(df):
    """A sampling key for tables without one: the whole row."""
    return F.to_json(F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns]))


def sample_exact(df, n, key=None, seed=SAMPLE_SEED, direct_rows=DIRECT_SAMPLE_ROWS):
    """Exactly min(n, rows) rows, the same ones on every run; none or 0 keeps all rows.

    Rows are taken in the order of a hash of `key`, rows with equal keys in the order of a
    hash of the whole row, so that neither the size nor the partitioning matters. A small
    sample is a top-n. For a large one the hash that cuts the sample is searched
    digits by digits: rows are counted in 65,536 hash ranges (only these counts reach the
    driver), then within the range that holds the cut, until few rows are left there. All
    rows below are kept by a plain filter and only the last range is sorted, so no task
    ever holds the sample.
    """
    if not n:
        return df
    hashed = df.withColumn("_hash", sample_key(row_key(df) if key is None else key, seed))
    if n <= direct_rows:
        return _first(hashed, n, key, seed)

    prefix, wanted = "", n
    while len(prefix) < _HASH_DIGITS:
        digits = F.substring("_hash", len(prefix) + 1, _RANGE_DIGITS)
        inside = hashed.filter(F.col("_hash").startswith(prefix)).groupBy(digits.alias("_range")).count()
        counts = inside.toPandas().sort_values("_range")
        for found, count in zip(counts["_range"], counts["count"].astype(object)):
            if count > wanted:
                break
            wanted -= count
        else:
            return df
        prefix += found
        if count <= max(direct_rows, 1):
            break

    below = hashed.filter(F.col("_hash") < prefix)
    inside = hashed.filter(F.col("_hash").startswith(prefix))
    if len(prefix) < _HASH_DIGITS:
        cut = _first(inside, wanted, key, seed)
    elif key is not None:
        # Very many rows share one key: choose among them by the whole row.
        cut = sample_exact(inside.drop("_hash"), wanted, None, seed, direct_rows)
    else:
        cut = _copies(inside.limit(1), wanted)
    return below.drop("_hash").unionByName(cut.drop("_hash"))


def _first(hashed, n, key, seed):
    """The `n` rows with the smallest hashes, ties by the whole row's hash.

    A first pass over the keys alone finds the hash that cuts, so whole rows are only hashed up to it.
    """
    if key is None:
        return hashed.orderBy("_hash").limit(n).drop("_hash")
    cut = hashed.select("_hash").orderBy("_hash").limit(n).agg(F.max("_hash").alias("cut")).first()["cut"]
    whole = sample_key(row_key(hashed.drop("_hash")), seed)
    up_to = hashed.filter(F.col("_hash") <= F.lit(cut))
    return up_to.withColumn("_whole", whole).orderBy("_hash", "_whole").limit(n).drop("_hash", "_whole")


def _copies(row, n):
    """`n` copies of a single row, made by many tasks; for very many equal rows."""
    whole, rest = divmod(n, _COPIES_PER_TASK)
    sizes = F.concat(F.array_repeat(F.lit(_COPIES_PER_TASK), whole), F.array(F.lit(rest)))
    spread = row.withColumn("_size", F.explode(sizes)).repartition(whole + 1)
    return spread.select(*row.columns, F.explode(F.array_repeat(F.lit(0), F.col("_size"))).alias("_one")).drop("_one")


def union_parts(*parts):
    """Rows of all parts by column name; a column absent from a part is NULL there."""
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part, allowMissingColumns=True)
    return result


def parse_timestamp(df, column="timestamp", fmt=None, bad_col=None, epoch_unit="seconds"):
    """Parse a text or number column as timestamps; unreadable values become NULL.

    Without `fmt`, text that is only a number counts as an epoch in `epoch_unit` ("seconds" or
    "milliseconds"), as the coercion rules leave such columns. With `bad_col`, rows whose value
    could not be read are marked there.
    """
    source = F.col(column)
    if fmt:
        parsed = F.try_to_timestamp(source.cast("string"), F.lit(fmt))
    elif isinstance(df.schema[column].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        parsed = source.cast("timestamp")
    else:
        text = F.trim(source.cast("string"))
        number = F.when(text.rlike(r"^[+-]?[0-9]+(\.[0-9]*)?$"), text.try_cast("double"))
        epoch = F.timestamp_micros((number * {"seconds": 1_000_000, "milliseconds": 1_000}[epoch_unit]).try_cast("bigint"))
        parsed = F.when(number.isNotNull() & (F.length(text) > 4), epoch).otherwise(text.try_cast("timestamp"))
    if bad_col:
        df = df.withColumn(bad_col, source.isNotNull() & parsed.isNull())
    return df.withColumn(column, parsed)
