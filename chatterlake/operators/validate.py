"""Table comparison and profiles."""

from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql import types as T


def _side_counts(left, right):
    """Copies of each distinct row on either side, in one shuffle.

    Both tables are stacked and counted per row, so equal rows meet wherever they
    were and heavy repetition is folded per task first.
    """
    columns = [c for c in left.columns if c in right.columns]
    if not columns:
        raise ValueError("The tables have no column in common")
    types = dict(right.dtypes)
    aligned = left.select(*[F.col(f"`{c}`").try_cast(types[c]).alias(c) for c in columns])
    stacked = aligned.withColumn("_left", F.lit(1)).unionByName(
        right.select(*[F.col(f"`{c}`") for c in columns]).withColumn("_left", F.lit(0))
    )
    return columns, stacked.groupBy(*[F.col(f"`{c}`") for c in columns]).agg(
        F.sum("_left").alias("_in_left"), F.sum(1 - F.col("_left")).alias("_in_right")
    )


def table_differences(left, right):
    """Rows that occur more often on one side, with the side and the number of extra copies."""
    columns, counts = _side_counts(left, right)
    extra = F.col("_in_left") - F.col("_in_right")
    return counts.filter(extra != 0).select(
        F.when(extra > 0, "left").otherwise("right").alias("side"),
        F.abs(extra).alias("copies"),
        *[F.col(f"`{c}`") for c in columns],
    )


def sample_differences(differences, n=3):
    """The first `n` differing rows in column order."""
    return differences.orderBy(*[F.col(f"`{c}`") for c in differences.columns[2:]], "side").limit(n)


def compare_tables(left, right):
    """One row: rows on each side, rows found on one side only, columns on one side only, verdict."""
    columns, counts = _side_counts(left, right)
    extra = F.col("_in_left") - F.col("_in_right")
    zero = F.lit(0)
    left_only = ",".join(sorted(set(left.columns) - set(columns)))
    right_only = ",".join(sorted(set(right.columns) - set(columns)))
    same_columns = not left_only and not right_only
    return counts.agg(
        F.coalesce(F.sum("_in_left"), zero).alias("left_rows"),
        F.coalesce(F.sum("_in_right"), zero).alias("right_rows"),
        F.coalesce(F.sum(F.greatest(extra, zero)), zero).alias("only_left"),
        F.coalesce(F.sum(F.greatest(-extra, zero)), zero).alias("only_right"),
    ).select(
        "*",
        F.lit(left_only).alias("columns_only_left"),
        F.lit(right_only).alias("columns_only_right"),
        ((F.col("only_left") == 0) & (F.col("only_right") == 0) & F.lit(same_columns)).alias("equal"),
    )


def fingerprints(df, key, columns):
    """Rows and two order-free sums of row hashes per key: equal multisets of rows have equal ones.

    Different multisets agree by chance alone, in one of some 2^128 cases. For columns without
    parts: within nested values the hash does not tell where a NULL stands.
    """
    types = dict(df.dtypes)
    if any(types[c].startswith(("struct", "array", "map")) for c in columns):
        raise ValueError("Fingerprints are for columns without parts")
    values = [F.col(f"`{c}`") for c in columns]
    flags = [v.isNull() for v in values]
    sums = [F.sum(F.xxhash64(F.lit(seed), *flags, *values).cast("decimal(20,0)")).alias(f"_sum{seed}") for seed in (1, 2)]
    return df.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_rows"), *sums)


def table_schema(df):
    """Column names and types as a frame."""
    rows = [(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "position int, column string, type string, nullable boolean")


def _field(name):
    return lambda v: v[name]


def _children(name, value, kind, many):
    """(name, value or list of values, type, whether it is a list) of the parts of a struct's fields, a list's elements, or a map's keys and values, of one value or of each of a list."""
    if isinstance(kind, T.StructType):
        for f in kind.fields:
            part = F.transform(value, _field(f.name)) if many else value[f.name]
            yield f"{name}.{f.name}", part, f.dataType, many
    elif isinstance(kind, (T.ArrayType, T.MapType)):
        pick = {"[]": (lambda v: v, kind.elementType)} if isinstance(kind, T.ArrayType) else {
            "{keys}": (F.map_keys, kind.keyType), "{values}": (F.map_values, kind.valueType)}
        for mark, (part, inner) in pick.items():
            # Lists within lists are laid side by side; a missing one has no elements.
            lists = F.flatten(F.transform(F.filter(value, lambda v: v.isNotNull()), part)) if many else part(value)
            yield name + mark, lists, inner, True


def _parts(fields):
    """All columns and, after each, its nested parts."""
    for part in fields:
        yield part
        yield from _parts(_children(*part))


def _ordered(kind):
    return not isinstance(kind, (T.StructType, T.ArrayType, T.MapType, T.VariantType))


def profile_table(df, approx_distinct=True):
    """One row per column: rows, missing values, smallest and largest value, distinct estimate.

    Nested columns have a row of their own, with the missing ones, and one for each of their parts:
    `a.b` for a field, `a[]` for a list's elements, `a{keys}` and `a{values}` for a map's. The rows
    of a part inside a list or map are its elements. Only plain values have a smallest and
    largest one; the distinct estimate is also left out for elements.
    All are profiled in a single aggregation without a shuffle of rows. The
    distinct number is a sketch estimate (about 2 % error); exact counts would
    shuffle every column by its values.
    """
    parts = list(_parts((f.name, F.col("`" + f.name.replace("`", "``") + "`"), f.dataType, False) for f in df.schema.fields))
    # Lists of elements are made once, in a projection of their own.
    values = df.select(*[value.alias(f"v{i}") for i, (_, value, _, _) in enumerate(parts)])
    measures, entries = [F.count("*").alias("rows")], []
    for i, (name, _, kind, many) in enumerate(parts):
        value, ordered = F.col(f"v{i}"), _ordered(kind)
        if many:
            total = F.coalesce(F.sum(F.size(F.coalesce(value, F.array().cast(T.ArrayType(kind))))), F.lit(0))
            filled = F.coalesce(F.sum(F.size(F.filter(F.coalesce(value, F.array().cast(T.ArrayType(kind))), lambda v: v.isNotNull()))), F.lit(0))
            low, high = F.array_min(value), F.array_max(value)
        else:
            total, filled, low, high = F.count("*"), F.count(value), value, value
        measures += [total.cast("bigint").alias(f"n{i}"), filled.cast("bigint").alias(f"f{i}")]
        if ordered:
            measures += [F.min(low).alias(f"lo{i}"), F.max(high).alias(f"hi{i}")]
        distinct = approx_distinct and ordered and not many
        if distinct:
            measures.append(F.approx_count_distinct(value, 0.02).alias(f"d{i}"))
        none = F.lit(None)
        entries.append(F.struct(
            F.lit(name).alias("column"),
            F.col(f"n{i}").alias("row_count"),
            (F.col(f"n{i}") - F.col(f"f{i}")).alias("null_count"),
            (F.col(f"lo{i}") if ordered else none).cast("string").alias("min_value"),
            (F.col(f"hi{i}") if ordered else none).cast("string").alias("max_value"),
            *([(F.col(f"d{i}") if distinct else none).cast("bigint").alias("approx_distinct")] if approx_distinct else []),
        ))
    return values.agg(*measures).select(F.inline(F.array(*entries)))


def sample_rows(df, n=10):
    """A few rows to look at."""
    return df.limit(n)


def union_reports(reports):
    return reduce(lambda a, b: a.unionByName(b), reports)
