"""Conversion and comparison of whole folder trees of CSV files in a few jobs.

The number of jobs follows the number of different headers and type plans, not that of files:
one pass tells header, quotes and splits of all files; one aggregate by file for each header gives
what the types depend on; files with the same plan are read and written together, a folder
each, and read back together. A comparison reads them against their Parquet tables in the same
groups, down to one fingerprint a file.
"""

from collections import defaultdict

from pyspark.sql import functions as F

from ..operators.coerce import apply_plan, plan_profile, profile_strings
from ..operators.validate import fingerprints
from ..sources.csv import read_alike, unique_names
from ..sources.records import FILE, file_states, read_lines
from ..sources.storage import copy_path, delete_path, move_path, new_path, reader_path

_KEY = "_file_key"
# Files named in one read.
FILES_PER_READ = 20_000


def _grouped(files, key):
    """Files by a key, in parts that one read can name."""
    groups = defaultdict(list)
    for f in files:
        groups[key(f)].append(f)
    return [group[k : k + FILES_PER_READ] for group in groups.values() for k in range(0, len(group), FILES_PER_READ)]


def plan_files(spark, paths, delimiter, mode):
    """Paths as the metadata column spells them. What is known of each file: {path: row of `file_states`}, {path: type plan}, {path: message} of those that cannot be read."""
    files, plans, failed = {}, {}, {}
    for part in (paths[k : k + FILES_PER_READ] for k in range(0, len(paths), FILES_PER_READ)):
        for row in file_states(read_lines(spark.read, [reader_path(p) for p in part]), delimiter).collect():
            if row["header"] is None:
                failed[row["path"]] = "the file has no header"
            elif row["ends"][-1]:
                failed[row["path"]] = "the file ends inside quotes"
            else:
                files[row["path"]] = row
    for group in _grouped(files.values(), lambda f: (tuple(f["header"]), f["strict"])):
        table = read_alike(spark, group, delimiter)
        names = unique_names(group[0]["header"])
        profiles = profile_strings(table, names, by=FILE)
        nothing = {name: dict.fromkeys(("rows", "filled", "integers", "numbers", "fractions", "booleans", "flags"), 0) for name in names}
        for f in group:
            profile = profiles.get(f["path"], nothing)
            plans[f["path"]] = plan_profile(profile, mode), profile[names[0]]["rows"]
    return files, plans, failed


def _alike(files, plans):
    """Files that one read and one type plan serve."""
    return _grouped(files.values(), lambda f: (tuple(f["header"]), f["strict"], tuple(sorted(plans[f["path"]][0].items()))))


def convert_files(spark, targets, delimiter=",", compression="snappy", mode="compat"):
    """Convert files to Parquet: `targets` by path. Returns {path: None, or why it is not converted}.

    A file with a header alone becomes an empty table and counts as not converted. What is written
    is read back and its rows are counted before it takes its place. Where a whole group fails, all
    its files are named with the reason, and the other groups go on.
    """
    files, plans, report = plan_files(spark, sorted(targets), delimiter, mode)
    report.update({path: "the file is empty" for path in targets if path not in files and path not in report})
    for group in _alike(files, plans):
        staging = new_path(spark, "tree")
        try:
            report.update(_convert_group(spark, group, plans, targets, staging, delimiter, compression))
        except Exception as error:
            report.update({f["path"]: str(error).split("\n")[0] for f in group})
        finally:
            delete_path(spark, staging)
    return report


def _convert_group(spark, group, plans, targets, staging, delimiter, compression):
    plan, report = plans[group[0]["path"]][0], {}
    table = read_alike(spark, group, delimiter)
    # Folders are named by a hash of the path, as a path is no good name for one.
    keyed = table.withColumn(_KEY, F.hex(F.xxhash64(FILE)))
    typed = apply_plan(keyed.drop(FILE), plan)
    typed.write.partitionBy(_KEY).option("compression", compression).parquet(f"{staging}/full")
    keys = {r["path"]: r["k"] for r in spark.createDataFrame([(f["path"],) for f in group], "path string").select("path", F.hex(F.xxhash64("path")).alias("k")).collect()}
    found = {}
    if any(plans[f["path"]][1] for f in group):
        written = spark.read.schema(typed.schema).parquet(f"{staging}/full")
        found = {r[_KEY]: r["count"] for r in written.groupBy(_KEY).count().collect()}
    empty = [f["path"] for f in group if not plans[f["path"]][1]]
    if empty:
        typed.drop(_KEY).limit(0).coalesce(1).write.option("compression", compression).parquet(f"{staging}/none")
    for f in group:
        path, rows = f["path"], plans[f["path"]][1]
        if not rows:
            copy_path(spark, f"{staging}/none", targets[path])
            report[path] = "the file has no rows"
        elif found.get(keys[path]) != rows:
            report[path] = f"{found.get(keys[path], 0)} of {rows} rows could be read back"
        else:
            move_path(spark, f"{staging}/full/{_KEY}={keys[path]}", targets[path])
            report[path] = None
    return report


def same_files(spark, pairs, root, delimiter=",", mode="compat"):
    """Which CSV files have the rows of their Parquet tables: (reports, messages) by CSV path.

    `pairs` maps CSV paths to tables, all spelled as the metadata column does; tables are below
    `root`. A report is (rows, columns of the CSV alone, columns of the table alone) for a pair with
    the same rows in the columns both have, and None for one that has to be compared by its
    rows. Files that cannot be read have a message.
    """
    files, plans, failed = plan_files(spark, sorted(pairs), delimiter, mode)
    failed.update({path: "the file is empty" for path in pairs if path not in files and path not in failed})
    reports = {}
    for group in _alike(files, plans):
        reports.update(_same_group(spark, group, plans[group[0]["path"]][0], pairs, root, delimiter))
    return reports, failed


def _same_group(spark, group, plan, pairs, root, delimiter):
    """Reports of files of one plan.

    Tables are read under their merged schema. A table has all its columns if each has a value
    somewhere; tables that lack values in the same columns are read again by themselves, and
    where that adds no news, each one's own schema is looked at.
    """
    reports, todo = {f["path"]: None for f in group}, [group]
    while todo:
        part = todo.pop()
        try:
            tables = spark.read.option("mergeSchema", True).parquet(*[reader_path(pairs[f["path"]]) for f in part])
            filled = _filled_columns(tables, root)
        except Exception:
            # One table that cannot be read, or types that do not merge: the rest is found by halving.
            half = len(part) // 2
            todo.extend(p for p in (part[:half], part[half:]) if half)
            continue
        nothing = (0,) * len(tables.columns)
        by_filled = defaultdict(list)
        for f in part:
            by_filled[filled.get(pairs[f["path"]], nothing)].append(f)
        settled = []
        for seen, members in by_filled.items():
            if all(seen):
                settled += members
            elif len(by_filled) > 1:
                todo.append(members)
            else:
                settled += [f for f in members if spark.read.parquet(reader_path(pairs[f["path"]])).dtypes == tables.dtypes]
        if settled:
            reports.update(_same_rows(spark, settled, plan, pairs, root, tables, delimiter))
    return reports


def _table_of(root):
    """The table a data file belongs to: the first part of its path below `root` that is named as one."""
    above = root.rstrip("/").count("/") + 1
    return F.regexp_extract("_metadata.file_path", rf"^((?:[^/]*/){{{above}}}(?:[^/]*/)*?[^/]*\.(?i:parquet))(?:/|$)", 1)


def _filled_columns(tables, root):
    """Per table, which columns have a value."""
    quoted = ["`" + c.replace("`", "``") + "`" for c in tables.columns]
    seen = tables.groupBy(_table_of(root).alias("_key")).agg(
        F.array(*[F.max(F.col(c).isNotNull().cast("int")) for c in quoted]).alias("_filled")
    )
    return {row["_key"]: tuple(row["_filled"]) for row in seen.collect()}


def _same_rows(spark, group, plan, pairs, root, tables, delimiter):
    typed = apply_plan(read_alike(spark, group, delimiter), plan)
    names = [c for c in typed.columns if c != FILE]
    types, wanted = dict(tables.dtypes), {pairs[f["path"]] for f in group}
    common = [c for c in names if c in types]
    left_only, right_only = (",".join(sorted(set(a) - set(common))) for a in (names, tables.columns))
    try:
        quoted = {c: F.col("`" + c.replace("`", "``") + "`") for c in common}
        left = typed.select(FILE, *[quoted[c].try_cast(types[c]).alias(c) for c in common])
        right = tables.select(_table_of(root).alias(FILE), *quoted.values()).filter(F.col(FILE).isin(*wanted))
        sides = fingerprints(left, FILE, common), fingerprints(right, FILE, common)
        found = {row["_key"]: tuple(row)[1:] for side in sides for row in side.collect()}
    except Exception:
        return {}
    same = [f["path"] for f in group if common and found.get(f["path"]) == found.get(pairs[f["path"]])]
    return {path: (found[path][0] if path in found else 0, left_only, right_only) for path in same}
