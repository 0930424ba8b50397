"""Paths on the cluster's file system and the shared working folder."""

import re
import uuid
from contextlib import contextmanager
from urllib.parse import unquote

from pyspark.sql import functions as F


def _file_system(spark, path):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def path_exists(spark, path):
    fs, hadoop_path = _file_system(spark, path)
    return fs.exists(hadoop_path)


def delete_path(spark, path):
    """Remove a folder this library has written itself."""
    fs, hadoop_path = _file_system(spark, path)
    return fs.delete(hadoop_path, True)


def move_path(spark, path, target):
    """Give a folder another name, in place of what has that name."""
    fs, old = _file_system(spark, path)
    target_fs, new = _file_system(spark, target)
    target_fs.delete(new, True)
    target_fs.mkdirs(new.getParent())
    # A rename where both lie in one file system, else a copy.
    if fs.getUri().equals(target_fs.getUri()):
        if not fs.rename(old, new):
            raise OSError(f"{path} cannot become {target}")
    else:
        copy_path(spark, path, target)


def copy_path(spark, path, target):
    """Copy a folder, in place of what has the target's name."""
    fs, old = _file_system(spark, path)
    target_fs, new = _file_system(spark, target)
    target_fs.delete(new, True)
    target_fs.mkdirs(new.getParent())
    spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, old, target_fs, new, False, spark._jsc.hadoopConfiguration())


def is_folder(spark, path):
    fs, hadoop_path = _file_system(spark, path)
    return fs.exists(hadoop_path) and fs.getFileStatus(hadoop_path).isDirectory()


def working_folder(spark):
    """Shared folder for intermediate tables: the session's `spark.checkpoint.dir`.

    Where the setting is missing it is a folder in the warehouse, which all executors
    of a session share as well.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_chatterlake_working"


def new_path(spark, name):
    """A path below the working folder that nothing else uses."""
    return f"{working_folder(spark)}/{name}-{uuid.uuid4().hex}"


def write_table(df, name="stage"):
    """Write `df` to the working folder and return (frame over the files, path).

    The written table cuts the lineage and survives lost executors. Later readers
    take only the columns they need.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


@contextmanager
def staged(df, name="stage"):
    """`write_table` for the time of a `with` block; the files are removed afterwards."""
    table, path = write_table(df, name)
    try:
        yield table
    finally:
        delete_path(df.sparkSession, path)


# A table with this many splits is never dealt out again, however large the cluster is.
SPREAD_SPLITS = 64


def spread(table, *keys):
    """Share out a freshly read table of a few splits over the session's cores.

    For small tables, and for files one task must read whole (CSV with line breaks in
    quotes, JSON documents): the work after the read then uses all cores. A table of many
    splits, as any large one, is returned as it is, without a shuffle. With unique `keys`
    the shuffle also serves later grouping on them.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    if table.isStreaming or table.rdd.getNumPartitions() >= min(cores, SPREAD_SPLITS):
        return table
    return table.repartition(cores, *keys)


def relative_path(spark, path, root):
    """Part of a listed path below `root`, whatever scheme and host the two are written with."""
    fs, hadoop_root = _file_system(spark, root)
    base = fs.makeQualified(hadoop_root).toUri().getPath().rstrip("/") + "/"
    bare = re.sub(r"^[A-Za-z][\w+.-]*:(//[^/]*)?", "", path)
    if not bare.startswith(base):
        raise ValueError(f"{path} is not below {root}")
    return bare[len(base):]


def metadata_path(spark, path):
    """A listed path as Spark's metadata column spells it."""
    return spark._jvm.org.apache.hadoop.fs.Path(path).toUri().toString()


def reader_path(path):
    """A path as Spark's metadata column spells it, for a reader: decoded, and no part of it a pattern."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", unquote(path))


def list_files(spark, path, extension):
    """Files below a folder with the given extension in any case: `path`, `length`.

    File contents are never read, since the `content` column is left out. Empty files have no
    splits and so no rows in a read; they are taken from the reader's listing.
    """
    any_case = "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in extension)
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", f"*{any_case}")
        .load(path)
        .select("path", "length")
    )
    listed = spark.createDataFrame([(unquote(name),) for name in files.inputFiles()], "path string")
    # The two spell schemes differently (file:/ and file:///), so paths are compared without.
    bare = F.regexp_replace("path", "^[a-z0-9]+:/+", "/")
    empty = listed.withColumn("_bare", bare).join(files.select(bare.alias("_bare")), "_bare", "left_anti")
    return files.union(empty.select("path", F.lit(0).cast("bigint")))


def total_size(spark, path, extension):
    """Bytes in all files below a folder with the given extension."""
    return list_files(spark, path, extension).agg(
        F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")
    )
