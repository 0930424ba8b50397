"""Column types: profile a table of strings once, fix a plan, apply it row by row.

Profiling is one aggregation over the table and gives one row. The plan is plain
data (column name to target), so applying it needs no further pass and also works
on a stream.
"""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.fixed_values import (
    BOOLEAN_COLUMNS,
    BOOLEAN_NAME_PARTS,
    COUNT_COLUMNS,
    COUNT_NAME_PARTS,
    EPOCH_COLUMNS,
    EPOCH_NAME_PARTS,
    FALSE_WORDS,
    TRUE_WORDS,
)
from ..functions.text import as_column

# Number forms a CSV reader takes for numeric; Java's own parser would also accept
# suffixes such as `1d`.
INTEGER_PATTERN = r"^\s*[+-]?\d+\s*$"
NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|inf|Inf|infinity|Infinity)\s*$"
# Doubles below this are safe to cast to bigint.
LARGEST_WHOLE = 9.2e18

RULES = (
    ("boolean", BOOLEAN_COLUMNS, BOOLEAN_NAME_PARTS),
    ("epoch", EPOCH_COLUMNS, EPOCH_NAME_PARTS),
    ("count", COUNT_COLUMNS, COUNT_NAME_PARTS),
)


def require_column(df, column):
    """Fail when planning, naming the columns there are."""
    if column not in df.columns:
        raise ValueError(f"The input has no column {column!r}. Available columns: {', '.join(df.columns)}")
    return df


def rename_text_column(df, column, name="comment"):
    """Give the text column its common name."""
    return require_column(df, column).withColumnRenamed(column, name)


def rule_for(column):
    """Name of the coercion rule of a column name, None if there is none; first match wins."""
    lowered = column.lower()
    for rule, names, parts in RULES:
        if column in names or any(part in lowered for part in parts):
            return rule
    return None


def to_number(text):
    """Double value of a numeric text; NULL for any other."""
    text = as_column(text)
    return F.when(text.rlike(NUMBER_PATTERN), text.try_cast("double"))


def to_integer(text):
    """Bigint value of a whole number; exact for large ids, also reads `5.0` and `1e3`."""
    text = as_column(text)
    number = to_number(text)
    whole = F.when((number == F.floor(number)) & (F.abs(number) < LARGEST_WHOLE), number.cast("bigint"))
    return F.coalesce(F.when(text.rlike(INTEGER_PATTERN), text.try_cast("bigint")), whole)


def to_boolean(text):
    """True and false words in any case; any other value is NULL."""
    lowered = F.lower(as_column(text))
    return F.when(lowered.isin(TRUE_WORDS), True).when(lowered.isin(FALSE_WORDS), False)


def to_epoch(text):
    """Numeric value, 0 for anything that is not a number (also a missing value)."""
    return F.coalesce(to_number(text), F.lit(0.0))


def to_count(text):
    """Whole number, 0 for anything that is not a number (also a missing value)."""
    return F.coalesce(to_integer(text), F.lit(0).cast("bigint"))


def string_columns(df):
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def _quoted(name):
    return F.col("`" + name.replace("`", "``") + "`")


def profile_strings(df, columns=None, by=None):
    """Counts per string column that decide its type, from one aggregation.

    Returns {column: {filled, integers, numbers, fractions, booleans, flags, rows}}; with a column
    `by` this for each of its values.
    """
    columns = string_columns(df) if columns is None else columns
    if not columns:
        return {}
    # Numbers are parsed in a projection of their own, once per value; the counts use them.
    parsed = df.select(
        *[_quoted(name).alias(f"t{i}") for i, name in enumerate(columns)],
        *[to_number(_quoted(name)).alias(f"n{i}") for i, name in enumerate(columns)],
        *([] if by is None else [_quoted(by).alias("by")]),
    )
    parts = [F.count("*").alias("rows")]
    for i in range(len(columns)):
        text, number = F.col(f"t{i}"), F.col(f"n{i}")
        filled = number.isNotNull()
        whole = (number == F.floor(number)) & (F.abs(number) < LARGEST_WHOLE)
        parts += [
            F.count(text).alias(f"filled_{i}"),
            F.count_if(filled & whole & text.rlike(INTEGER_PATTERN)).alias(f"integers_{i}"),
            F.count(number).alias(f"numbers_{i}"),
            F.count_if(filled & ~whole).alias(f"fractions_{i}"),
            F.count_if(text.isin("True", "TRUE", "true", "False", "FALSE", "false")).alias(f"booleans_{i}"),
            F.count(to_boolean(text)).alias(f"flags_{i}"),
        ]
    keys = ("filled", "integers", "numbers", "fractions", "booleans", "flags")

    def profile(row):
        return {name: {"rows": row["rows"], **{key: row[f"{key}_{i}"] for key in keys}} for i, name in enumerate(columns)}

    if by is None:
        return profile(parsed.agg(*parts).first())
    return {row["by"]: profile(row) for row in parsed.groupBy("by").agg(*parts).collect()}


def plan_reader_types(profile):
    """Types that a type-inferring CSV reader gives: whole columns of numbers or booleans.

    Whole numbers with missing values become doubles, as they do for such a reader.
    """
    plan = {}
    for name, p in profile.items():
        if not p["filled"] or p["numbers"] == p["filled"]:
            whole = p["filled"] and p["integers"] == p["rows"]
            plan[name] = "read_integer" if whole else "read_number"
        elif p["booleans"] == p["rows"]:
            plan[name] = "read_boolean"
    return plan


def plan_coercion(profile, mode="compat"):
    """Target per string column by its name, given its profile.

    A count column holding any fraction becomes a double with missing values kept.
    `compat` converts whatever the name asks for, even where values are lost;
    `safe` leaves a column alone if any filled value could not be read.
    """
    if mode not in ("compat", "safe"):
        raise ValueError("mode must be 'compat' or 'safe'")
    plan = {}
    for name, p in profile.items():
        rule = rule_for(name)
        if rule is None:
            continue
        readable = p["flags"] if rule == "boolean" else p["numbers"]
        if mode == "safe" and readable < p["filled"]:
            continue
        plan[name] = "fraction" if rule == "count" and p["fractions"] else rule
    return plan


def lossy_columns(profile):
    """Columns that `compat` would change although some filled values are unreadable."""
    safe = plan_coercion(profile, "safe")
    return sorted(set(plan_coercion(profile)) - set(safe))


_TARGETS = {
    "boolean": to_boolean,
    "epoch": to_epoch,
    "count": to_count,
    "fraction": to_number,
    "read_integer": to_integer,
    "read_number": to_number,
    "read_boolean": to_boolean,
}


def apply_plan(df, plan):
    """Apply a plan; a projection without any further pass."""
    return df.select(
        *[
            _TARGETS[plan[name]](_quoted(name)).alias(name) if name in plan else _quoted(name)
            for name in df.columns
        ]
    )


def plan_csv_types(df, mode="compat"):
    """Plan for a table read as strings: reader types first, name rules for the rest."""
    return plan_profile(profile_strings(df), mode)


def plan_profile(profile, mode="compat"):
    """`plan_csv_types` for a profile at hand."""
    reader = plan_reader_types(profile)
    rest = {name: p for name, p in profile.items() if name not in reader}
    return {**plan_coercion(rest, mode), **reader}


def coerce_types(df, mode="compat"):
    """Profile the string columns of a table and convert them by the name rules."""
    return apply_plan(df, plan_coercion(profile_strings(df), mode))
