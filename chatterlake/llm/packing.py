"""Packing of documents into fixed sequences: first-fit decreasing with a tournament tree.

Documents are tokenised where they are read, and only the lengths of their pieces are dealt
into random groups of bounded size. Each group is packed by itself: pieces from long to
short go into the first open sequence with room, found by walking down a tree whose nodes
hold the largest free room below them.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from .common import arrow_schema, chunks, column_of, record, small_batches, task_rows, text_bytes
from .tokens import TOKEN_BYTES, default_path, pieces, word_tokens

SEQUENCE = 2048
GROUP_DOCUMENTS = 4000
SEQUENCES_PER_GROUP = 1 << 24


def first_fit_decreasing(sizes, capacity):
    """Sequence and offset of every piece; the i-th largest piece goes to the first sequence with room."""
    sizes = np.asarray(sizes)
    order = np.argsort(-sizes, kind="stable")
    leaves = 1
    while leaves < max(len(sizes), 1):
        leaves *= 2
    tree = [capacity] * (2 * leaves)      # tree[k]: largest room below k
    where, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for i in order.tolist():
        size, k = int(sizes[i]), 1
        while k < leaves:
            k *= 2
            if tree[k] < size:
                k += 1
        where[i], offset[i] = k - leaves, capacity - tree[k]
        tree[k] -= size
        k //= 2
        while k:
            room = max(tree[2 * k], tree[2 * k + 1])
            if tree[k] == room:
                break
            tree[k] = room
            k //= 2
    return where, offset


def token_pieces(docs, id_col, text_col, path, end_id, longest):
    """One row per piece: id, `start`, `length`, `ids_crc32`, `doc_tokens`, and `_place`, its number in the input."""
    kind = dict(docs.dtypes)[id_col]
    columns = "start long, length long, ids_crc32 long, doc_tokens long, _place long"
    schema = arrow_schema(columns)

    def run(batches):
        encode, place = word_tokens(path, end_id), task_rows()
        for batch in chunks(batches, text_col, TOKEN_BYTES):
            ids, offsets = encode(*text_bytes(column_of(batch, text_col)))
            rows, start, length = pieces(offsets, longest)
            raw = memoryview(ids.astype("<u4").tobytes())
            first = (offsets[rows] + start) * 4
            crc = [zlib.crc32(raw[a : a + 4 * n]) for a, n in zip(first.tolist(), length.tolist())]
            out = record(schema, start=start, length=length, ids_crc32=np.array(crc, np.int64), doc_tokens=np.diff(offsets)[rows], _place=place(len(rows)))
            yield pa.RecordBatch.from_arrays([column_of(batch, id_col).take(pa.array(rows)), *out.columns], names=[id_col, *schema.names])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, {columns}")


def pack_documents(docs, id_col="doc_id", text_col="text", path=None, end_id=1, capacity=SEQUENCE, group_documents=GROUP_DOCUMENTS, seed=0):
    """Place every piece of every document: `sequence_id` and `offset` (gapless from 0).

    Documents longer than `capacity` are cut; each id lies in exactly one piece. A missing or
    empty text is its end id alone. Repeated rows are packed each. `padding` is what its
    sequence needs to reach `capacity`, 0 at a power of two. No group depends on how long
    a document is: pieces, not documents, are dealt out.
    """
    small_batches(docs.sparkSession)
    found = token_pieces(docs, id_col, text_col, path or default_path(), end_id, capacity)
    groups = max(1, -(-docs.count() // group_documents))
    kind = dict(docs.dtypes)[id_col]
    columns = f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, padding long"
    dealt = found.withColumn("_group", F.pmod(F.xxhash64(F.lit(seed), "_place"), F.lit(groups)))

    def pack(table):
        table = table.combine_chunks().sort_by([("length", "descending"), ("ids_crc32", "ascending"), ("start", "ascending"), (id_col, "ascending")])
        sizes = table["length"].to_numpy()
        where, offset = first_fit_decreasing(sizes, capacity)
        filled = np.bincount(where, weights=sizes).astype(np.int64)
        padding = np.where(filled & (filled - 1), capacity - filled, 0)
        group = table["_group"][0].as_py()
        out = table.drop_columns(["_group", "_place"])
        for name, values in (("sequence_id", group * SEQUENCES_PER_GROUP + where), ("offset", offset), ("sequence_tokens", filled[where]), ("padding", padding[where])):
            out = out.append_column(name, pa.array(values, pa.int64()))
        return out

    return dealt.groupBy("_group").applyInArrow(pack, columns)
