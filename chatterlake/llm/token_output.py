"""Token matrices: best-fit decreasing packing, written with segment ends and position resets.

Documents are tokenised where they are read; overlong ones are split without loss. Pieces
are dealt at random into groups of about a million tokens with their ids (two bytes each where the
vocabulary allows), so that every group is packed and written out by one task with no
further exchange. Best fit takes the open sequence with the least room that is enough,
found in a segment tree over room sizes.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from .common import arrow_schema, chunks, column_of, record, small_batches, task_rows, text_bytes
from .packing import SEQUENCE, SEQUENCES_PER_GROUP
from .tokens import TOKEN_BYTES, default_path, pieces, word_tokens

# Tokens of a group, as estimated from its bytes.
GROUP_TOKENS = 1 << 20
BYTES_PER_TOKEN = 4


class RoomTree:
    """Open sequences by their room; `take(size)` gives the one with the least room >= size."""

    def __init__(self, capacity):
        self._leaves = 1
        while self._leaves <= capacity:
            self._leaves *= 2
        self._count = [0] * (2 * self._leaves)
        self._open = [[] for _ in range(capacity + 1)]

    def put(self, room, sequence):
        self._open[room].append(sequence)
        self._change(room, 1)

    def _change(self, room, by):
        k = room + self._leaves
        while k:
            self._count[k] += by
            k //= 2

    def take(self, size):
        """(room, sequence), or None where no open sequence has room."""
        k = size + self._leaves
        if not self._count[k]:
            # Up to the first ancestor with something to the right, then down to its smallest room.
            while k > 1 and (k % 2 or not self._count[k + 1]):
                k //= 2
            if k <= 1:
                return None
            k += 1
            while k < self._leaves:
                k *= 2
                if not self._count[k]:
                    k += 1
        room = k - self._leaves
        self._change(room, -1)
        return room, self._open[room].pop()


def best_fit_decreasing(sizes, capacity):
    """Sequence and offset of every piece, from the longest to the shortest."""
    sizes = np.asarray(sizes)
    tree, opened = RoomTree(capacity), 0
    where, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        found = tree.take(size)
        if found is None:
            found, opened = (capacity, opened), opened + 1
        room, sequence = found
        where[i], offset[i] = sequence, capacity - room
        if room > size:
            tree.put(room - size, sequence)
    return where, offset


def packed_matrices(docs, id_col="doc_id", text_col="text", path=None, end_id=1, pad_id=0, capacity=SEQUENCE,
                    group_tokens=GROUP_TOKENS, seed=0):
    """One row per packed sequence.

    `ids` holds `capacity` little-endian 32-bit ids, padded with `pad_id`; `cu_seqlens` the
    segment ends from 0 on; `positions` the 32-bit position of every id, starting again at 0
    with each segment (and in the padding); `doc_ids` and `starts` tell of each segment its
    document and the document's ids before it. A missing or empty text is its end id alone;
    repeated rows are packed each; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    path = path or default_path()
    kind = dict(docs.dtypes)[id_col]
    piece_columns = "start long, length long, ids binary, _place long"
    schema = arrow_schema(piece_columns)

    def run(batches):
        encode, place = word_tokens(path, end_id), task_rows()
        for batch in chunks(batches, text_col, TOKEN_BYTES):
            ids, offsets = encode(*text_bytes(column_of(batch, text_col)))
            rows, start, length = pieces(offsets, capacity)
            narrow = not len(ids) or int(ids.max()) < 1 << 16
            # Pieces follow each other as their ids do, so one buffer holds the whole column.
            edges = np.append(offsets[rows] + start, len(ids)) * (2 if narrow else 4)
            raw = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(ids.astype("<u2" if narrow else "<u4"))])
            out = record(schema, start=start, length=length, ids=raw, _place=place(len(rows)))
            yield pa.RecordBatch.from_arrays([column_of(batch, id_col).take(pa.array(rows)), *out.columns], names=[id_col, *schema.names])

    # Groups are sized by tokens, of which no text has more than bytes and its end.
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0)).alias("n"), F.count("*").alias("rows")).first()
    groups = 1 + int((size["n"] // BYTES_PER_TOKEN + size["rows"]) // group_tokens)
    found = docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, {piece_columns}")
    dealt = found.withColumn("_group", F.pmod(F.xxhash64(F.lit(seed), "_place"), F.lit(groups)))
    columns = f"sequence_id long, n_tokens long, n_segments int, ids binary, cu_seqlens array<int>, positions binary, doc_ids array<{kind}>, starts array<long>"

    def pack(table):
        table = table.combine_chunks().sort_by([("length", "descending"), (id_col, "ascending"), ("start", "ascending")])
        sizes = table["length"].to_numpy()
        where, _ = best_fit_decreasing(sizes, capacity)
        group = table["_group"][0].as_py()
        # Members of a sequence side by side, in the order they were placed.
        order = np.argsort(where, kind="stable")
        own = sizes[order]
        sequence = where[order]
        edges = np.searchsorted(sequence, np.arange(int(where.max()) + 2))
        filled = np.bincount(where, weights=sizes).astype(np.int64)
        total = np.concatenate([[0], np.cumsum(own)])
        offset = total[:-1] - total[edges[:-1]][sequence]
        # One scatter puts the ids of all pieces into the rows of all sequences.
        place = np.repeat(sequence * capacity + offset - total[:-1], own) + np.arange(total[-1])
        raw = table["ids"].to_pylist()
        ids = [np.frombuffer(x, "<u2" if len(x) == 2 * n else "<u4") for x, n in zip((raw[k] for k in order.tolist()), own.tolist())]
        matrix, positions = np.full(len(filled) * capacity, pad_id, "<u4"), np.zeros(len(filled) * capacity, "<u4")
        matrix[place] = np.concatenate(ids)
        positions[place] = np.arange(total[-1]) - np.repeat(total[:-1], own)
        # Padding counts from 0 as well.
        spare = capacity - filled
        begin = np.cumsum(spare) - spare
        padding = np.arange(int(spare.sum())) - np.repeat(begin, spare)
        positions[np.repeat(np.arange(len(filled)) * capacity + filled, spare) + padding] = padding
        # A sequence's segment ends: 0 and the running sums of its pieces.
        ends = np.insert(offset + own, edges[:-1], 0)
        lists = pa.array(edges.astype(np.int32))
        members = table.take(pa.array(order)).combine_chunks()
        rows = [pa.Array.from_buffers(pa.binary(), len(filled), [None, pa.py_buffer((np.arange(len(filled) + 1) * 4 * capacity).astype(np.int32)), pa.py_buffer(x)]) for x in (matrix, positions)]
        return pa.table({
            "sequence_id": pa.array(group * SEQUENCES_PER_GROUP + np.arange(len(filled))), "n_tokens": pa.array(filled), "n_segments": pa.array(np.diff(edges).astype(np.int32)), "ids": rows[0],
            "cu_seqlens": pa.ListArray.from_arrays(pa.array((edges + np.arange(len(edges))).astype(np.int32)), pa.array(ends.astype(np.int32))), "positions": rows[1],
            "doc_ids": pa.ListArray.from_arrays(lists, members[id_col].combine_chunks()), "starts": pa.ListArray.from_arrays(lists, members["start"].combine_chunks())})

    return dealt.groupBy("_group").applyInArrow(pack, columns)


def write_matrices(packed, path):
    """Write packed sequences as Parquet; each file's `ids` column is one id matrix."""
    packed.write.mode("overwrite").parquet(path)
    return path


def as_matrix(column, capacity=SEQUENCE):
    """Binary rows of `ids` or `positions` as a matrix with `capacity` columns."""
    return np.frombuffer(b"".join(column), "<u4").reshape(-1, capacity)
