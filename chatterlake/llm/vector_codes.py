"""Product codes of vectors: integer k-means per part, nearest entries by Orchard search.

Vectors are cut into equal parts, each with its own small codebook. Only codebooks (parts x
entries x components) and, from every task, one row of sums per used entry travel; the
vectors themselves stay where they are staged, as integers, and every round passes over
them once. All arithmetic is on integers, so results do not depend on the order of rows.

Orchard search keeps for every entry the other ones sorted by their distance from it. A
query walks along the list of its best entry so far. Where it meets a better one, it jumps to
that one's list; entries it has met are marked and not measured again. An entry further from
the best one than twice the query's own distance cannot be nearer to the query, nor can any
behind it, so there the search ends. Whole batches of queries take their steps together.
"""

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..sources.storage import delete_path, write_table
from .common import arrow_schema, column_of, record

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
# Scaled components up to this size keep every distance of up to 1,024 components within 64 bits.
LARGEST = 1 << 26
BATCH_VECTORS = 2000


@dataclass
class Neighbours:
    """A codebook's entries, and for each the others by distance: `order`, and that distance squared: `far`."""

    entries: np.ndarray
    order: np.ndarray
    far: np.ndarray

    @classmethod
    def of(cls, entries):
        entries = np.asarray(entries, np.int64)
        square = ((entries[:, None] - entries[None]) ** 2).sum(2)
        order = np.argsort(square, axis=1, kind="stable")
        # An entry is not on its own list; one equal to it is.
        others = order[order != np.arange(len(entries))[:, None]].reshape(len(entries), max(len(entries) - 1, 0))
        return cls(entries, others, np.take_along_axis(square, others, 1))


def orchard_search(book, queries):
    """Index of the nearest entry of each query (ties to the lower index) and its squared distance."""
    n, listed = len(queries), book.order.shape[1]
    best = np.zeros(n, np.int64)
    square = ((queries - book.entries[0]) ** 2).sum(1)
    place = np.zeros(n, np.int64)
    met = np.zeros((n, len(book.entries)), bool)
    met[:, 0] = True
    walking = np.arange(n) if listed else np.zeros(0, np.int64)
    while len(walking):
        at, own = best[walking], place[walking]
        # Squared: an entry beyond twice the distance has more than four times its square.
        near = book.far[at, own] <= 4 * square[walking]
        walking, at, own = walking[near], at[near], own[near]
        entry = book.order[at, own]
        place[walking] = own + 1
        fresh = ~met[walking, entry]
        asked, entry = walking[fresh], entry[fresh]
        met[asked, entry] = True
        found = ((queries[asked] - book.entries[entry]) ** 2).sum(1)
        better = (found < square[asked]) | ((found == square[asked]) & (entry < best[asked]))
        jump = asked[better]
        best[jump], square[jump], place[jump] = entry[better], found[better], 0
        walking = walking[place[walking] < listed]
    return best, square


def _integers(column, scale):
    """Rows of a vector column that are kept, their scaled integers, and the length of each."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy()).astype(np.int64)
    values = column.values.slice(column.offsets[0].as_py(), int(sizes.sum())) if len(column) else column.values
    if column.null_count:
        # A null vector's range may hold values; it counts as one null.
        there = np.asarray(column.is_valid())
    else:
        there = np.ones(len(column), bool)
    numbers = values.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    edges = np.concatenate([[0], np.cumsum(sizes)])
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(numbers))])
    kept = there & (bad[edges[1:]] == bad[edges[:-1]])
    inside = np.repeat(kept, sizes)
    scaled = np.floor(numbers[inside] * scale)
    if len(scaled) and np.abs(scaled).max() >= LARGEST:
        raise ValueError(f"Vector components beyond {LARGEST // scale} are not supported")
    return np.flatnonzero(kept), scaled.astype("<i4"), sizes[kept]


def stage_vectors(vectors, id_col, vector_col, label_col, scale=SCALE):
    """A written table (id, label, ints, size): the kept vectors as little-endian 32-bit integers."""
    kinds = dict(vectors.dtypes)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            kept, scaled, sizes = _integers(column_of(batch, "vector"), scale)
            raw, ends = scaled.tobytes(), np.concatenate([[0], np.cumsum(sizes)]) * 4
            ints = [raw[a:b] for a, b in zip(ends.tolist(), ends[1:].tolist())]
            rows = pa.array(kept)
            yield pa.RecordBatch.from_arrays(
                [column_of(batch, "id").take(rows), column_of(batch, "label").take(rows), pa.array(ints, pa.binary()), pa.array(sizes, pa.int64())],
                names=["id", "label", "ints", "size"])

    read = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    return write_table(read.mapInArrow(run, f"id {kinds[id_col]}, label {kinds[label_col]}, ints binary, size long"), "vectors")


def _matrices(batches, parts):
    """Batches with their vectors as one array (parts, vectors, components of a part)."""
    for batch in batches:
        for start in range(0, batch.num_rows, BATCH_VECTORS):
            piece = batch.slice(start, BATCH_VECTORS)
            ints = np.frombuffer(b"".join(column_of(piece, "ints").to_pylist()), "<i4").astype(np.int64)
            yield piece, ints.reshape(piece.num_rows, parts, -1).transpose(1, 0, 2)


def _first_entries(staged, parts, entries):
    """The parts of the first vectors by id; equal ids by their integers, missing ids last."""
    first = staged.orderBy(F.col("id").asc_nulls_last(), "ints").limit(entries).select("ints").collect()
    rows = np.array([np.frombuffer(r["ints"], "<i4") for r in first], np.int64)
    return rows.reshape(len(rows), parts, -1).transpose(1, 0, 2)


def _sums(staged, books, parts):
    """Rows (part, entry, n, sums): how many parts an entry is nearest to and their sums, over all vectors."""
    schema = arrow_schema("part int, entry int, place int, n long, total long")

    def run(batches):
        lists = [Neighbours.of(b) for b in books]
        n = np.zeros(books.shape[:2], np.int64)
        total = np.zeros(books.shape, np.int64)
        for _, matrix in _matrices(batches, parts):
            for p, queries in enumerate(matrix):
                best, _ = orchard_search(lists[p], queries)
                n[p] += np.bincount(best, minlength=n.shape[1])
                np.add.at(total[p], best, queries)
        part, entry = np.nonzero(n)
        part, entry, place = (x.ravel() for x in np.broadcast_arrays(part[:, None], entry[:, None], np.arange(books.shape[2])))
        if len(part):
            yield record(schema, part=part, entry=entry, place=place, n=n[part, entry], total=total[part, entry, place])

    found = staged.select("ints").mapInArrow(run, "part int, entry int, place int, n long, total long")
    return found.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def fit_codebooks(staged, parts=PARTS, entries=ENTRIES, rounds=ROUNDS):
    """Codebooks as an array (part, entry, component) after `rounds` rounds over all staged vectors.

    What comes to the driver is one row per part, entry and component, however many vectors there are.
    """
    books = _first_entries(staged, parts, entries)
    for _ in range(rounds):
        after = books.copy()
        for r in _sums(staged, books, parts).collect():
            after[r["part"], r["entry"], r["place"]] = r["total"] // r["n"]
        books = after
    return books


def codebooks_sha256(books):
    """Digest of all entries' components by part, entry and place, comma-joined."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress_vectors(vectors, id_col="vec_id", vector_col="embedding", label_col="label", parts=PARTS, entries=ENTRIES, rounds=ROUNDS, scale=SCALE):
    """A row per kept vector: its id, label, `code` (binary, a byte per part), `error`, and `label_error`; and the codebooks.

    Vectors that are missing or hold missing or non-finite components are dropped. Components
    become floor(scale * x); other lengths than the first vector's, lengths that `parts` does not
    divide and components beyond 2**26 after scaling are an error. With fewer vectors than
    `entries` the codebooks are smaller; with none the result is empty. Rows with equal or missing
    ids are coded each (missing ids are last among the first entries). Other columns are ignored.
    """
    if entries > 256:
        raise ValueError("A code has one byte per part")
    kinds = dict(vectors.dtypes)
    staged, path = stage_vectors(vectors, id_col, vector_col, label_col, scale)
    size = staged.agg(F.min("size").alias("least"), F.max("size").alias("most")).first()
    if size["least"] != size["most"] or (size["least"] is not None and (size["least"] == 0 or size["least"] % parts)):
        raise ValueError(f"Vectors must have one length that {parts} divides, not {size['least']} to {size['most']}")
    books = fit_codebooks(staged, parts, entries, rounds) if size["least"] else np.zeros((parts, 0, 0), np.int64)

    def run(batches):
        lists = [Neighbours.of(b) for b in books]
        for piece, matrix in _matrices(batches, parts):
            found = [orchard_search(lists[p], queries) for p, queries in enumerate(matrix)]
            codes = np.stack([best for best, _ in found], 1).astype(np.uint8)
            raw = codes.tobytes()
            error = np.sum([square for _, square in found], 0)
            yield pa.RecordBatch.from_arrays(
                [column_of(piece, "id"), column_of(piece, "label"), pa.array([raw[k * parts : (k + 1) * parts] for k in range(len(codes))], pa.binary()), pa.array(error, pa.int64())],
                names=["id", "label", "code", "error"])

    coded, _ = write_table(staged.select("id", "label", "ints").mapInArrow(run, f"id {kinds[id_col]}, label {kinds[label_col]}, code binary, error long"), "codes")
    delete_path(coded.sparkSession, path)
    # Summed per task first and written: a label of very many rows meets one row, in a join that can be split.
    by_label, _ = write_table(coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label"), "label-errors")
    joined = coded.join(by_label, F.col("label").eqNullSafe(F.col("_label")))
    return joined.select(F.col("id").alias(id_col), F.col("label").alias(label_col), "code", "error", "label_error"), books


def decode(codes, books):
    """Vectors of scaled integers that the codes stand for."""
    return np.concatenate([books[p][codes[:, p]] for p in range(len(books))], 1)
