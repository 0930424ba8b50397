"""Benchmark decontamination: size-partitioned MinHash containment search.

Test items are grouped by the size of their shingle sets (powers of two). The sketch of an item
holds its smallest shingle hashes, as many as its size class needs for the threshold: a
document with the share `containment` of an item's shingles lacks fewer of them than
the sketch has, so every such document meets the sketch. Documents that do are
verified by exact shingle containment. Sketches and item shingles are broadcast in blocks
of bounded size; each block is one pass over the documents without a shuffle. A few blocks are
held at a time; where there are more, what they found is written before the next ones are built.
"""

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from ..sources.storage import delete_path, write_table
from .common import ALNUM, Hasher, arrow_schema, chunks, column_of, gram_hashes, record, row_bounds, rows_of, small_batches, text_bytes, word_spans

WORDS = 5
CONTAINMENT = 0.8
# Bytes of item text that one broadcast block may hold.
BLOCK_BYTES = 8 << 20
# Blocks that are broadcast at a time.
BLOCKS_AT_ONCE = 4


def item_shingles(text, words=WORDS):
    """(shingle length, sorted distinct hashes) of one item; a shorter item is one shingle of all its words."""
    data = np.frombuffer(text.encode(), np.uint8)
    starts, ends = word_spans(data, np.array([0, len(data)]), ALNUM)
    if not len(starts):
        return words, np.zeros(0, np.uint64)
    n = min(words, len(starts))
    _, values = gram_hashes(Hasher(data)(starts, ends), np.array([0, len(starts)]), n)
    return n, np.unique(values)


class Index:
    """Sketches by shingle length: sorted hashes, each with the items that hold it."""

    def __init__(self, items, keys, words, containment):
        self.items, self.needed, self.keys = [], [], keys
        classes = {}
        for key, text in items:
            n, shingles = item_shingles(text, words)
            if len(shingles):
                size_class = int(len(shingles)).bit_length()
                classes[n, size_class] = max(classes.get((n, size_class), 0), len(shingles))
                self.items.append((key, n, shingles, size_class))
                self.needed.append(int(np.ceil(containment * len(shingles) - 1e-9)))
        self.sketches = {}
        for number, (_, n, shingles, size_class) in enumerate(self.items):
            largest = classes[n, size_class]
            width = largest - int(np.ceil(containment * largest - 1e-9)) + 1
            low = shingles[:width]
            self.sketches.setdefault(n, []).append((low, np.full(len(low), number)))
        for n, parts in self.sketches.items():
            values, owners = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(values, kind="stable")
            values, owners = values[order], owners[order]
            unique, first = np.unique(values, return_index=True)
            self.sketches[n] = unique, np.append(first, len(values)), owners

    def search(self, data, offsets):
        """(row, item number, shared shingles) of every containment in a run of texts."""
        starts, ends = word_spans(data, offsets, ALNUM)
        bounds = row_bounds(starts, offsets)
        hashes, rows = Hasher(data)(starts, ends), rows_of(bounds)
        found = []
        for n, (unique, first, owners) in self.sketches.items():
            at, values = gram_hashes(hashes, bounds, n)
            place = np.minimum(np.searchsorted(unique, values), len(unique) - 1)
            hit = np.flatnonzero(unique[place] == values)
            pairs = set()
            for row, k in zip(rows[at[hit]].tolist(), place[hit].tolist()):
                pairs.update((row, item) for item in owners[first[k] : first[k + 1]].tolist())
            by_row = {}
            for row, item in sorted(pairs):
                if row not in by_row:
                    a, b = np.searchsorted(at, [bounds[row], bounds[row + 1]])
                    by_row = {row: np.unique(values[a:b])}
                shared = int(np.isin(self.items[item][2], by_row[row], assume_unique=True).sum())
                if shared >= self.needed[item]:
                    found.append((row, item, shared))
        return found


def _indexes(spark, items, item_col, item_text_col, words, containment, block_bytes):
    """(broadcast indexes of some blocks, whether these are all), block after block.

    A block has about `block_bytes` of item text. Unless they are all, the caller ends the pass over
    them before it asks for the next ones; then they are destroyed.
    """
    small_batches(spark)
    wanted = items.select(F.col(item_col).alias("key"), F.col(item_text_col).alias("text")).filter("text is not null")
    total = wanted.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = int(total // block_bytes) + 1

    def build(number):
        own = wanted if blocks == 1 else wanted.filter(F.pmod(F.xxhash64("key", "text"), F.lit(blocks)) == number)
        table = own.toArrow()
        texts = pc.utf8_lower(table["text"]).to_pylist()
        return spark.sparkContext.broadcast(Index(list(zip(range(len(texts)), texts)), table["key"].combine_chunks(), words, containment))

    for first in range(0, blocks, BLOCKS_AT_ONCE):
        held = [build(number) for number in range(first, min(first + BLOCKS_AT_ONCE, blocks))]
        yield held, blocks <= BLOCKS_AT_ONCE
        if blocks > BLOCKS_AT_ONCE:
            for index in held:
                index.destroy()


def _lowered(batch, text_col):
    return text_bytes(pc.utf8_lower(column_of(batch, text_col)))


def find_contained(docs, items, id_col="doc_id", text_col="text", item_col="item_id", item_text_col="text",
                   words=WORDS, containment=CONTAINMENT, block_bytes=BLOCK_BYTES):
    """Pairs of a document and a test item of which it holds at least `containment` of the shingles.

    Columns: the ids, `n_item` and `n_shared` shingles, `containment`. Items without words match
    nothing, missing texts are empty, repeated documents or items give a row each. Items of
    any number are searched in blocks of about `block_bytes` of text, `BLOCKS_AT_ONCE` in a pass.
    """
    item_kind, kind = dict(items.dtypes)[item_col], dict(docs.dtypes)[id_col]
    columns = f"`{id_col}` {kind}, `{item_col}` {item_kind}, n_item long, n_shared long, containment double"
    numbers = arrow_schema("n_item long, n_shared long, containment double")

    def search(index):
        def run(batches):
            for batch in chunks(batches, text_col):
                found = index.value.search(*_lowered(batch, text_col))
                if found:
                    rows, owners, shared = zip(*found)
                    sizes = [len(index.value.items[i][2]) for i in owners]
                    keys = index.value.keys.take(pa.array([index.value.items[i][0] for i in owners]))
                    part = record(numbers, n_item=sizes, n_shared=shared, containment=[s / n for s, n in zip(shared, sizes)])
                    yield pa.RecordBatch.from_arrays([column_of(batch, id_col).take(pa.array(rows)), keys, *part.columns], names=[id_col, item_col, *numbers.names])

        return docs.select(id_col, text_col).mapInArrow(run, columns)

    found = []
    for held, all_blocks in _indexes(docs.sparkSession, items, item_col, item_text_col, words, containment, block_bytes):
        pairs = reduce(lambda a, b: a.union(b), [search(index) for index in held])
        found.append(pairs if all_blocks else write_table(pairs, "contained")[0])
    return reduce(lambda a, b: a.union(b), found)


def without_contained(docs, items, text_col="text", item_col="item_id", item_text_col="text",
                      words=WORDS, containment=CONTAINMENT, block_bytes=BLOCK_BYTES):
    """The rows of `docs`, with all their columns, that hold none of the test items."""
    spark, before = docs.sparkSession, None
    for held, all_blocks in _indexes(spark, items, item_col, item_text_col, words, containment, block_bytes):
        for index in held:

            def run(batches, index=index):
                for batch in chunks(batches, text_col):
                    good = np.ones(batch.num_rows, bool)
                    good[[row for row, _, _ in index.value.search(*_lowered(batch, text_col))]] = False
                    yield batch.filter(pa.array(good))

            docs = docs.mapInArrow(run, docs.schema)
        if not all_blocks:
            docs, path = write_table(docs, "clean")
            if before:
                delete_path(spark, before)
            before = path
    return docs
