"""Words, hashes and repeats over whole Arrow batches, in numpy.

Texts are handled as UTF-8 bytes. A missing text is an empty one. All word rules used
here treat every non-ASCII byte as part of a word, so bytes give the same words as
characters do.
"""

from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

# Bytes of text handled at a time inside a task; one longer text is handled alone.
CHUNK_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = {"n": 0}

# Words between white space, and words of letters and digits.
SPACES = b" \t\n\x0b\x0c\r"
SPACED = np.ones(256, bool)
SPACED[list(SPACES)] = False
ALNUM = np.zeros(256, bool)
ALNUM[list(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = True
ALNUM[128:] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _power_tables(n):
    """Powers of the hash base and of its inverse modulo 2**64, at least `n` of them."""
    if _powers["n"] < n:
        size = max(n, CHUNK_BYTES + 1)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            np.cumprod(table, out=table)
            _powers[name] = table
        _powers["n"] = size
    return _powers["up"], _powers["down"]


def mix(h):
    """Spread the entropy of 64-bit values over all their bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Hasher:
    """Fingerprints of any byte ranges of one buffer; equal bytes give equal values."""

    def __init__(self, data):
        up, self._down = _power_tables(len(data) + 1)
        self._sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=self._sums[1:])

    def __call__(self, starts, ends):
        raw = (self._sums[ends] - self._sums[starts]) * self._down[starts]
        return mix(raw + (ends - starts).astype(np.uint64))


def small_batches(spark):
    """Let Spark hand texts to Python in batches of a few MB, whatever their number of rows."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 * CHUNK_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    return spark


@contextmanager
def shuffles_removed(spark):
    """Let Spark remove a query's shuffle files as soon as it ends; for what is written to a table and not run again."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def text_bytes(column):
    """The UTF-8 bytes of a string column as one array, and the offsets of its rows."""
    column = pc.fill_null(column, "") if column.null_count else column
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    large = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if large else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    values = column.buffers()[2]
    data = np.frombuffer(values, np.uint8)[offsets[0] : offsets[-1]] if values is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def chunks(batches, text_col, limit=CHUNK_BYTES):
    """Split record batches into runs of rows with about `limit` bytes of text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text_col))
        _, offsets = text_bytes(column)
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


def task_rows():
    """A counter for the rows of this task: `next_rows(n)` gives `n` numbers no other row has.

    The same input split gives the same numbers, also when a task runs again.
    """
    from pyspark import TaskContext

    state = [TaskContext.get().partitionId() << 36]

    def next_rows(n):
        state[0] += n
        return np.arange(state[0] - n, state[0])

    return next_rows


def column_of(batch, name):
    return batch.column(batch.schema.get_field_index(name))


def word_spans(data, offsets, table=SPACED, cut=None):
    """Starts and ends of words, which never cross rows; `cut` marks further word starts."""
    inside = table[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    rows = offsets[:-1][offsets[:-1] < len(data)]
    first[rows] = inside[rows]
    ends = offsets[1:][offsets[1:] > 0] - 1
    last[ends] = inside[ends]
    if cut is not None:
        first |= cut
        last[:-1] |= cut[1:]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def row_bounds(starts, offsets):
    """Index of the first word of each row, and the number of all words at the end."""
    return np.searchsorted(starts, offsets)


def rows_of(bounds):
    """Row of each word."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def gram_hashes(hashes, bounds, n):
    """Hashes of all runs of `n` words inside a row: (positions of first words, values)."""
    if len(hashes) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    rows = rows_of(bounds)
    at = np.flatnonzero(rows[: len(rows) - n + 1] == rows[n - 1 :])
    value = np.zeros(len(at), np.uint64)
    for j in range(n):
        value = value * np.uint64(_BASE) + hashes[at + j]
    return at, mix(value + np.uint64(n))


def in_row(values, rows):
    """Make equal values of different rows differ."""
    return mix(values + rows.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))


def repeated(keys):
    """Mark every key that occurs more than once."""
    return pd.Series(keys).duplicated(keep=False).to_numpy()


def seen_before(keys):
    """Mark every key that has occurred earlier."""
    return pd.Series(keys).duplicated(keep="first").to_numpy()


def sums(values, bounds):
    """Sums of `values` over the index ranges between neighbouring bounds."""
    total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def signed(values):
    """Unsigned 64-bit values as the longs of Spark."""
    return np.ascontiguousarray(values).view(np.int64)


def record(schema, **columns):
    """A record batch of the given Arrow schema."""
    return pa.record_batch([pa.array(columns[f.name], f.type) if not isinstance(columns[f.name], (pa.Array, pa.ChunkedArray)) else columns[f.name].cast(f.type) for f in schema], schema=schema)


def arrow_schema(spark_schema):
    """Arrow schema of a DDL schema string of simple columns and lists of them."""
    simple = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}
    fields = []
    for part in spark_schema.split(", "):
        name, kind = part.split(" ")
        of = simple[kind[6:-1]] if kind.startswith("array<") else None
        fields.append((name, pa.list_(of) if of is not None else simple[kind]))
    return pa.schema(fields)


def bucket_of(column, parts):
    """CRC-32 of a column's text modulo `parts`, the rule that sets rows apart for tests."""
    from pyspark.sql import functions as F

    return F.crc32(F.col(column).cast("string").cast("binary")) % parts
