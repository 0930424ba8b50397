"""Best-fit packing with matched large items, over the whole corpus at once.

How documents are packed depends on their lengths alone, and there are no more different
lengths than tokens in a sequence. So the plan is made from the number of documents of every
length: it says which of the documents of one length, by their rank among these, go into
which sequences. It is as large as the sequence, not as the corpus, and the same as if
documents were placed one by one:

1. Large documents, above a third of a sequence, share one with at most one other large one. From
   the longest on, each is matched with the longest other that fits.
2. Small documents, from the longest on, go into the fullest sequence with room; only where
   there is none a new one is opened.

Ranks come without sorting: every task numbers its own documents of a length, and running
sums of the tasks' counts per length make these ranks of the whole corpus.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..sources.storage import write_table
from .byte_tokens import byte_tokens, default_path
from .common import arrow_schema, chunks, column_of, record, small_batches, text_bytes
from .tokens import TOKEN_BYTES

SEQUENCE = 2048
_RANKS = 1 << 44


class Plan:
    """Where every document goes, as runs of ranks of one length.

    A run has the first of its ranks, its first sequence, the documents of this length in each of
    its sequences and their offset there.
    """

    def __init__(self, counts, capacity):
        self.capacity, self.sequences, self._runs = capacity, 0, []
        self._left = [0] * (capacity + 1)
        for size, n in counts.items():
            self._left[size] = n
        self._rank = [0] * (capacity + 1)
        # Runs of sequences (first, many) by the room left in them.
        self._rooms = [[] for _ in range(capacity + 1)]
        self._match_large()
        self._fit_small()
        runs = np.array(sorted(self._runs), np.int64).reshape(-1, 5)
        self._key = runs[:, 0] * _RANKS + runs[:, 1]
        self._first_rank, self._first, self._each, self._offset = runs[:, 1:].T

    def _open(self, many):
        self.sequences += many
        return self.sequences - many

    def _put(self, size, first, many, each, offset):
        """`each` documents of one length into `many` sequences from `first` on."""
        self._runs.append((size, self._rank[size], first, each, offset))
        self._rank[size] += many * each
        self._left[size] -= many * each

    def _match_large(self):
        capacity, left = self.capacity, self._left
        for size in range(capacity, capacity // 3, -1):
            while left[size]:
                other = min(size, capacity - size)
                while 3 * other > capacity and left[other] < (2 if other == size else 1):
                    other -= 1
                if 3 * other <= capacity:
                    many, room = left[size], capacity - size
                    first = self._open(many)
                    self._put(size, first, many, 1, 0)
                elif other == size:
                    many, room = left[size] // 2, capacity - 2 * size
                    first = self._open(many)
                    self._put(size, first, many, 2, 0)
                else:
                    many, room = min(left[size], left[other]), capacity - size - other
                    first = self._open(many)
                    self._put(size, first, many, 1, 0)
                    self._put(other, first, many, 1, size)
                self._rooms[room].append((first, many))

    def _fit_small(self):
        capacity, left, rooms = self.capacity, self._left, self._rooms
        for size in range(capacity // 3, 0, -1):
            room = size
            while left[size]:
                while room < capacity and not rooms[room]:
                    room += 1
                each = room // size
                if rooms[room]:
                    first, many = rooms[room].pop()
                else:
                    many = -(-left[size] // each)
                    first = self._open(many)
                # Best fit fills one sequence after the other, as each is then the fullest with room.
                full = min(many, left[size] // each)
                if full:
                    self._put(size, first, full, each, capacity - room)
                    rooms[room - each * size].append((first, full))
                rest = many - full
                if rest and left[size]:
                    last = left[size]
                    rooms[room - last * size].append((first + full, 1))
                    self._put(size, first + full, 1, last, capacity - room)
                    full, rest = full + 1, rest - 1
                if rest:
                    rooms[room].append((first + full, rest))

    def places(self, sizes, ranks):
        """Sequence and offset of documents by their lengths and their ranks among these."""
        run = np.searchsorted(self._key, sizes * _RANKS + ranks, "right") - 1
        own = ranks - self._first_rank[run]
        sequence, k = np.divmod(own, self._each[run])
        return self._first[run] + sequence, self._offset[run] + k * sizes


def cut_pieces(sizes, longest):
    """Cut documents of more than `longest` ids: (row, number, first id, length); only a first piece is shorter."""
    parts = -(-sizes // longest)
    rows = np.repeat(np.arange(len(sizes)), parts)
    number = np.arange(len(rows)) - np.repeat(np.cumsum(parts) - parts, parts)
    head = (sizes - (parts - 1) * longest)[rows]
    start = np.where(number > 0, head + (number - 1) * longest, 0)
    return rows, number, start, np.where(number > 0, longest, head)


def running_ranks(values, seen):
    """Rank of each value among the equal ones so far; `seen` holds their numbers and is brought forward."""
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    first = np.searchsorted(ordered, ordered, "left")
    ranks = np.empty(len(values), np.int64)
    ranks[order] = seen[ordered] + np.arange(len(values)) - first
    seen += np.bincount(values, minlength=len(seen))
    return ranks


def token_pieces(docs, id_col, text_col, path, end_id, capacity):
    """A written table of pieces with the task they came from, `task`, and their rank among its pieces of one length."""
    kind = dict(docs.dtypes)[id_col]
    columns = "piece int, start long, length long, ids_crc32 long, task int, rank long"
    schema = arrow_schema(columns)

    def run(batches):
        from pyspark import TaskContext

        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        encode = byte_tokens(path, end_id)
        for batch in chunks(batches, "text", TOKEN_BYTES):
            ids, offsets = encode(*text_bytes(column_of(batch, "text")))
            rows, number, start, length = cut_pieces(np.diff(offsets), capacity)
            raw = memoryview(ids.astype("<u4").tobytes())
            first = (offsets[rows] + start) * 4
            crc = [zlib.crc32(raw[a : a + 4 * n]) for a, n in zip(first.tolist(), length.tolist())]
            out = record(schema, piece=number, start=start, length=length, ids_crc32=np.array(crc, np.int64), task=np.full(len(rows), task), rank=running_ranks(length, seen))
            yield pa.RecordBatch.from_arrays([column_of(batch, "id").take(pa.array(rows)), *out.columns], names=["id", *schema.names])

    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return write_table(read.mapInArrow(run, f"id {kind}, {columns}"), "pieces")[0]


def pack_matched(docs, id_col="doc_id", text_col="text", path=None, end_id=0, capacity=SEQUENCE):
    """A row per piece of every document: `piece`, `start`, `length`, `ids_crc32`, `sequence_id` and `offset`.

    Documents of more than `capacity` ids are cut, into pieces of `capacity`; the first may be
    shorter. Sequences are numbered from 0 without gaps. A missing or empty text is its end id
    alone; repeated rows and missing ids are packed each; other columns are ignored. The
    numbers of a document's copies follow the order in which files are read.
    """
    small_batches(docs.sparkSession)
    pieces = token_pieces(docs, id_col, text_col, path or default_path(), end_id, capacity)
    counts = write_table(pieces.groupBy("task", "length").agg(F.count("*").alias("n")), "lengths")[0]
    plan = Plan({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    ranks = write_table(counts.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), "ranks")[0]
    kind = dict(docs.dtypes)[id_col]
    columns = "piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

    def place(batches):
        for batch in batches:
            sizes, rank = (column_of(batch, c).to_numpy() for c in ("length", "rank"))
            sequence, offset = plan.places(sizes, rank)
            yield pa.RecordBatch.from_arrays(
                [*(column_of(batch, c) for c in ("id", "piece", "start", "length", "ids_crc32")), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())],
                names=[id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = pieces.join(ranks, ["task", "length"]).select("id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))
    return ranked.mapInArrow(place, f"`{id_col}` {kind}, {columns}")
