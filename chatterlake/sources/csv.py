"""Comment CSV: quoted line breaks, missing-value words, over-long lines."""

import re

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.fixed_values import MISSING_WORDS
from .records import FILE, RAW, ends_inside, parse, read_lines, read_spanning, strict_line
from .storage import is_folder, list_files, reader_path


def find_csv(spark, folder, extension=".csv"):
    """CSV files of a folder tree, extension in any case: `path`, `length`."""
    return list_files(spark, folder, extension)


def _needs_multi_line(spark, path, delimiter, extension=".csv"):
    """Whether a record may span lines, decided in the same way for every size.

    It cannot where every physical line by itself consists of fields that are free of quotes
    or quoted from end to end; then Spark's own reader gives the same records from lines. The
    check is a line scan over splits, which ends at the first other line.
    """
    return not _lines(spark, path, extension).filter(~F.col("value").rlike(strict_line(delimiter))).isEmpty()


def _lines(spark, path, extension):
    reader = spark.read
    if is_folder(spark, path):
        reader = reader.option("recursiveFileLookup", True).option("pathGlobFilter", any_case(extension))
    return read_lines(reader, path)


def _header(spark, path, delimiter, extension):
    """The first record of a file, which may span lines as well."""
    lines, wanted = _lines(spark, path, extension).filter("block = 0"), 1
    while True:
        found = lines.take(wanted)
        found = [r["value"] for r in found if r["path"] == found[0]["path"]]
        text, inside = "", False
        for k, line in enumerate(found):
            text += line + "\n"
            inside = ends_inside(line.removeprefix("\ufeff") if k == 0 else line, inside, delimiter)
            if not inside and text.strip("\ufeff\r\n"):
                return [name or "" for name in next(parse(text.removeprefix("\ufeff"), delimiter))[0]]
        if len(found) < wanted:
            raise ValueError(f"{path} has no header: it is empty or its first record does not end")
        wanted *= 16


def unique_names(header):
    """Column names of a header: a repeated one gets a number (`a`, `a.1`), one without text its place (`Unnamed: 2`).

    Names that differ in case alone count as repeated, as columns are found without regard to case.
    """
    names = []
    for place, name in enumerate(header):
        base = name = name or f"Unnamed: {place}"
        number = 0
        while name.lower() in {n.lower() for n in names}:
            number += 1
            name = f"{base}.{number}"
        names.append(name)
    return names


def any_case(extension):
    """File pattern for an extension in any case."""
    return "*" + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in extension)


def _field_count(record, delimiter):
    """Fields in a raw record: delimiters outside quoted fields, plus one.

    Only quotes at the start of a field open a quoted one; any other quote is text.
    """
    bare = F.regexp_replace(record, rf'(?s)(?<=^|{re.escape(delimiter)})"(?:[^"]|"")*+"', "")
    return (F.length(bare) - F.length(F.replace(bare, F.lit(delimiter)))) / len(delimiter) + 1


def _read_records(spark, path, delimiter, multi_line, extension):
    """Records as read, the column names, the raw record, the test for too many fields, and the file's name.

    Records that may span lines are cut by `records`. Of files of single lines Spark keeps the raw
    record of short and over-long ones alone, so only they are counted out field by field; column
    pruning must be off for the reader to notice them.
    """
    if multi_line is None:
        multi_line = _needs_multi_line(spark, path, delimiter, extension)
    header = _header(spark, path, delimiter, extension) if len(delimiter) == 1 else None
    names = unique_names(header) if header else None
    if multi_line and header:
        records = read_spanning(_lines(spark, path, extension), names, header, delimiter)
        return records, names, F.col(RAW), F.col(RAW).isNotNull(), F.col(FILE)
    reader = _line_reader(spark, delimiter, multi_line, bool(header) and names != header)
    if is_folder(spark, path):
        reader = reader.option("recursiveFileLookup", True).option("pathGlobFilter", any_case(extension))
    return *_line_records(reader, path, names or reader.csv(path).columns, delimiter), F.input_file_name()


def _line_reader(spark, delimiter, multi_line=False, renamed=False):
    return (
        spark.read.option("header", True)
        .option("sep", delimiter)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multi_line)
        .option("mode", "PERMISSIVE")
        .option("columnPruning", False)
        # Only names that stand in the files as they are can be compared with them.
        .option("enforceSchema", renamed)
    )


def _line_records(reader, path, names, delimiter):
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, RAW]])
    records = reader.schema(schema).option("columnNameOfCorruptRecord", RAW).csv(path)

    # Spark refuses queries on the corrupt-record column alone (a bare count would be
    # one), so the test also touches a data column, adding nothing to the text.
    touched = F.left(F.coalesce(_named(names[0]), F.lit("")), F.lit(0))
    record = F.concat(F.col(RAW), touched)
    too_long = F.coalesce(_field_count(record, delimiter) > len(names), F.lit(False))
    return records, names, record, too_long


def read_alike(spark, files, delimiter=",", missing_words=MISSING_WORDS):
    """Files of one header, given as rows of `file_states` that are all strict or all not, as one table with `FILE`.

    Over-long records are left out, as in `read_csv`.
    """
    paths, header = [reader_path(f["path"]) for f in files], files[0]["header"]
    names = unique_names(header)
    if files[0]["strict"]:
        reader = _line_reader(spark, delimiter, renamed=names != header)
        records, _, _, too_long = _line_records(reader, paths, names, delimiter)
        records, file = records.filter(~too_long), F.col("_metadata.file_path")
    else:
        records, file = read_spanning(read_lines(spark.read, paths), names, header, delimiter, files).filter(F.col(RAW).isNull()), F.col(FILE)
    return records.select(*_present(names, missing_words), file.alias(FILE))


def _present(names, missing_words):
    """Columns whose missing-value words are NULL."""
    return [F.when(~_named(n).isin(missing_words), _named(n)).alias(n) if missing_words else _named(n) for n in names]


def _named(name):
    return F.col("`" + name.replace("`", "``") + "`")


def read_csv(spark, path, delimiter=",", on_bad_lines="skip", multi_line=None, missing_words=MISSING_WORDS,
             file_name_col=None, extension=".csv"):
    """Read a CSV file or folder tree with header; all columns are strings.

    Short lines are padded with missing values. Over-long lines are left out
    (`on_bad_lines="skip"`, see `bad_lines`) or fail the job (`"error"`).
    `multi_line=None` finds out whether line breaks in quotes may occur. A line break (LF, CRLF
    or CR) outside quotes ends a record; inside it is kept as it is. A file that ends inside quotes
    and a file without a header are errors. Repeated and empty header names are made unique
    (`unique_names`). A delimiter of several characters is read by Spark's own reader, a file that needs
    `multi_line` then by one task.
    """
    records, names, record, too_long, file = _read_records(spark, path, delimiter, multi_line, extension)
    if on_bad_lines == "error":
        checked = F.when(too_long, F.raise_error(F.concat(F.lit("Too many fields: "), record))).otherwise(True)
        records = records.filter(checked.cast("boolean"))
    elif on_bad_lines == "skip":
        records = records.filter(~too_long)
    else:
        raise ValueError("on_bad_lines must be 'skip' or 'error'")

    columns = _present(names, missing_words)
    if file_name_col:
        columns.append(file.alias(file_name_col))
    return records.select(*columns)


def bad_lines(spark, path, delimiter=",", multi_line=None, extension=".csv"):
    """The raw over-long records that `read_csv` leaves out, with their file."""
    records, _, record, too_long, file = _read_records(spark, path, delimiter, multi_line, extension)
    return records.filter(too_long).select(file.alias("file"), record.alias("record"))


def read_comments(spark, path, on_bad_lines="error", **options):
    """Read a comment CSV; an over-long line is an error, as the input is then damaged."""
    return read_csv(spark, path, on_bad_lines=on_bad_lines, **options)


def csv_options(writer, delimiter=","):
    """Options under which written values are read back as they were."""
    return (
        writer.option("header", True)
        .option("sep", delimiter)
        .option("quote", '"')
        .option("escape", '"')
        .option("emptyValue", "")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
    )


def plain_columns(df):
    """Columns a CSV file can hold: nested values as JSON text."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(
        *[
            F.to_json(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def write_csv(df, path, mode="overwrite", delimiter=","):
    """Write CSV with header that `read_csv` reads back unchanged."""
    csv_options(plain_columns(df).write.mode(mode), delimiter).csv(path)
    return path


def output_path(input_path, suffix):
    """Input path with its extension replaced by `suffix`."""
    return re.sub(r"\.[^./\\]*$", "", input_path.rstrip("/")) + suffix
