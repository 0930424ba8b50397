"""Comment JSON files."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.stats import union_parts


def _files_by_kind(spark, path):
    """Paths of files whose document is an object, and of all others, by the first visible character."""
    is_object = F.col("value").rlike(r"^[\s\x{feff}]*+\{")
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), is_object.alias("object"))
    rows = files.collect()
    return [r["path"] for r in rows if r["object"]], [r["path"] for r in rows if not r["object"]]


def read_json_comments(spark, path, schema=None):
    """Read `{"comments": [{…}]}` or `[{…}]`, one document per file; a path may be a folder.

    Only an object at the top is unwrapped; the records of a top-level list are rows, whatever
    fields they have. The columns are the union of all records' fields (Spark orders them by
    name); a field absent from a record is NULL. A damaged document is an error. A known
    `schema` of the documents saves the pass that infers it. The format puts a whole document
    into one task; the listing of files, not their content, is on the driver.
    """
    objects, lists = _files_by_kind(spark, path)
    reader = spark.read.option("multiLine", True).option("mode", "FAILFAST")
    reader = reader.schema(schema) if schema else reader
    parts = [_unwrapped(reader.json(objects))] if objects else []
    if lists:
        parts.append(reader.json(lists))
    parts = [p for p in parts if p.columns] or parts[:1]
    return union_parts(*parts) if parts else spark.createDataFrame([], T.StructType([]))


def _unwrapped(documents):
    if "comments" not in documents.columns:
        return documents
    kind = documents.schema["comments"].dataType
    if not isinstance(kind, T.ArrayType):
        raise ValueError("'comments' must be a list of objects")
    if isinstance(kind.elementType, T.StructType):
        return documents.select(F.inline("comments"))
    if documents.filter(F.size("comments") > 0).isEmpty():
        return documents.sparkSession.createDataFrame([], T.StructType([]))
    raise ValueError("'comments' must be a list of objects")
