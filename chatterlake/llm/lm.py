"""Language-model scoring with a log-frequency Bloom filter.

Counts of words and word pairs are quantised on a logarithmic scale, q = 1 + floor(log_b c),
and an entry is put into the filter once for each level 1 … q. Probing level after level until
one is missing gives the quantised count back; it is never too small. The filter is built in
slices by the tasks that sum the counts, each with the same number of bits for every entry, so
its error rate is the same at every size. Slices are broadcast in blocks of bounded bytes, one
pass over the texts to score for each block: these are staged in chunks as word numbers,
every pass probes the chunk's words and pairs of its slices and writes a byte for each. These
bytes meet their chunks once, for the sums. No word or pair is shuffled.

A pair's probability is c(v,w) smoothed towards the word's own by as many pseudo-counts as
histories of v's level have different successors on average (Witten–Bell by count level).
The plain add-half score beside it uses exact counts: those of the most frequent words are
broadcast (a bounded number), the others are joined.
"""

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from ..sources.storage import delete_path, new_path, write_table
from .common import LOWER, Hasher, arrow_schema, chunks, column_of, mix, record, row_bounds, signed, shuffles_removed, small_batches, sums, task_rows, text_bytes, word_spans

LOG_BASE = 1.5
PROBES = 3
BITS_PER_ENTRY = 16
FREQUENT_WORDS = 500_000
TOKENS_PER_SLICE = 1 << 20
COMBINED_KEYS = 1 << 20
# Bytes of text counted at a time, and of a chunk that is scored.
TEXT_BYTES = 1 << 19
SCORED_BYTES = 1 << 20
LEVELS = 64
# Bytes of the filter that are broadcast at a time (more only where a single slice is larger).
FILTER_BLOCK = 64 << 20

END = mix(np.array([11], np.uint64))[0]
START = mix(np.array([12], np.uint64))[0]


def level_of(counts):
    return 1 + np.floor(np.log(np.maximum(counts, 1)) / np.log(LOG_BASE) + 1e-9).astype(np.int64)


def count_of(levels):
    """Middle of the counts that share a level; 0 for level 0, 1 for level 1."""
    low = np.ceil(LOG_BASE ** (levels - 1.0) - 1e-9)
    high = np.maximum(np.ceil(LOG_BASE ** (levels * 1.0) - 1e-9) - 1, low)
    return np.where(levels > 0, (low + high) / 2, 0.0)


def _slots(keys, level, bits):
    """Bit numbers of an entry's level inside its slice, one array per probe."""
    for j in range(PROBES):
        yield (mix(keys + np.uint64(level * 0x9E3779B9 + j * 0xC2B2AE3D27D4EB4F & 0xFFFFFFFFFFFFFFFF)) % np.asarray(bits, np.uint64)).astype(np.int64)


def _slice_of(keys, slices):
    return (mix(keys ^ np.uint64(0x2545F4914F6CDD1D)) % np.uint64(slices)).astype(np.int64)


def build_slice(keys, levels, bits):
    """The bits of one slice of the filter."""
    on = np.zeros(bits, bool)
    for level in range(1, int(levels.max(initial=0)) + 1):
        for slot in _slots(keys[levels >= level], level, bits):
            on[slot] = True
    return np.packbits(on)


def slice_bits(levels):
    """Size of a slice: the same number of bits for each entry, a key's level."""
    return max(64, BITS_PER_ENTRY * int(levels.sum()) // 8 * 8)


@dataclass
class Filter:
    """Slices after each other; `levels(keys)` probes them. A slice without bits holds no key."""

    slices: int
    bits: object             # size of every slice, or an array of their sizes
    data: np.ndarray

    def levels(self, keys):
        sizes = np.broadcast_to(self.bits, self.slices).astype(np.int64)
        out, where = np.zeros(len(keys), np.int64), _slice_of(keys, self.slices)
        base, bits = (np.cumsum(sizes) - sizes)[where], sizes[where]
        left = np.flatnonzero(bits)
        for level in range(1, LEVELS + 1):
            if not len(left):
                break
            inside = np.ones(len(left), bool)
            for slot in _slots(keys[left], level, bits[left]):
                at = base[left] + slot
                inside &= ((self.data[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).astype(bool)
            left = left[inside]
            out[left] = level
        return out


def tokens(data, offsets):
    """Hashes of all words with an end after each text, and the offsets of the texts in them."""
    starts, ends = word_spans(data, offsets)
    bounds = row_bounds(starts, offsets)
    hashes = np.insert(Hasher(LOWER[data])(starts, ends), bounds[1:], END)
    return hashes, bounds + np.arange(len(bounds))


def _histories(hashes, bounds, start=START):
    """The token before each token; a text's first token follows the start mark."""
    before = np.empty_like(hashes)
    before[1:] = hashes[:-1]
    before[bounds[:-1]] = start
    return before


def _pair(before, hashes):
    return mix(before * np.uint64(3) + hashes * np.uint64(5))


def _sliced(slices, keys, counts, extra=None):
    """Blobs per slice of combined counts, as rows (slice, keys, counts, extra)."""
    where = _slice_of(keys, slices)
    # Equal extras side by side compress well.
    order = np.argsort(where, kind="stable") if extra is None else np.lexsort((extra, where))
    keys, counts, where = keys[order], counts[order], where[order]
    extra = np.zeros(len(keys), np.uint8) if extra is None else extra[order]
    edges = np.searchsorted(where, np.arange(slices + 1))
    used = np.flatnonzero(np.diff(edges))
    cut = [(edges[k], edges[k + 1]) for k in used]
    schema = arrow_schema("slice int, keys binary, counts binary, extra binary")
    return record(schema, slice=used, keys=[keys[a:b].tobytes() for a, b in cut],
                  counts=[counts[a:b].astype("<u4").tobytes() for a, b in cut], extra=[extra[a:b].tobytes() for a, b in cut])


def _merge(table, extra_type=np.uint8):
    """Distinct keys of one slice, their summed counts and their extra value."""
    keys = np.frombuffer(b"".join(table["keys"].to_pylist()), "<u8")
    counts = np.frombuffer(b"".join(table["counts"].to_pylist()), "<u4")
    extra = np.frombuffer(b"".join(table["extra"].to_pylist()), extra_type)
    order = np.argsort(keys, kind="stable")
    keys, counts, extra = keys[order], counts[order].astype(np.int64), extra[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts, extra[first]


def _combined(batches, text_col, keys_of, slices):
    """Map side of counting: combine up to some million keys of a task before they are dealt out."""
    held, size = [], 0

    def flush():
        keys, first, counts = np.unique(np.concatenate([k for k, _ in held]), return_index=True, return_counts=True)
        extra = None if held[0][1] is None else np.concatenate([e for _, e in held])[first]
        return _sliced(slices, keys, counts, extra)

    for batch in chunks(batches, text_col, TEXT_BYTES):
        keys, extra = keys_of(*tokens(*text_bytes(column_of(batch, text_col))))
        held.append((keys, extra))
        size += len(keys)
        if size >= COMBINED_KEYS:
            yield flush()
            held, size = [], 0
    if size:
        yield flush()


_BLOBS = "slice int, keys binary, counts binary, extra binary"


@dataclass
class Model:
    words: object            # table (h, c) of all training words
    tokens: int              # N
    kinds: int               # V
    frequent: tuple          # hashes and counts of the most frequent words, sorted by hash
    slices: int
    filters: object          # table (slice, kind, bits); kind 0 has words, 1 has pairs
    pseudo: np.ndarray       # pseudo-counts by the level of the history
    paths: tuple             # folders of its tables

    def close(self):
        """Remove the model's tables; it scores no more texts."""
        for path in self.paths:
            delete_path(self.words.sparkSession, path)


def _sizes_of(texts):
    """Estimated tokens and number of rows."""
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n"), F.count("*").alias("rows")).first()
    return int(size["n"] // 6 + size["rows"]), size["rows"]


def fit(train, text_col="text", frequent_words=FREQUENT_WORDS):
    """Count words and word pairs of all training texts and build the filters."""
    spark = small_batches(train.sparkSession)
    texts = train.select(F.col(text_col).alias("text"))
    estimate, documents = _sizes_of(texts)
    slices = estimate // TOKENS_PER_SLICE + 8

    counted = texts.mapInArrow(lambda it: _combined(it, "text", lambda h, b: (h, None), slices), _BLOBS)

    def word_rows(table):
        keys, counts, _ = _merge(table)
        return pa.table({"h": pa.array(signed(keys)), "c": pa.array(counts, pa.int64())})

    with shuffles_removed(spark):
        words, words_path = write_table(counted.groupBy("slice").applyInArrow(word_rows, "h long, c long"), "lm-words")
    level = (F.floor(F.log("c") / F.log(F.lit(LOG_BASE)) + 1e-9) + 1).cast("int")
    by_level = words.groupBy(level.alias("level")).agg(F.sum("c").alias("tokens"), F.count("*").alias("kinds"), F.min("c").alias("least")).collect()
    total, kinds = sum(r["tokens"] for r in by_level), sum(r["kinds"] for r in by_level)
    least, room = None, frequent_words
    for r in sorted(by_level, key=lambda r: -r["level"]):
        room -= r["kinds"]
        if room < 0:
            break
        least = r["least"]
    often = words.filter(F.col("c") >= (least if least is not None else 1 << 62)).toArrow()
    h, c = often["h"].to_numpy().astype(np.int64).view(np.uint64), often["c"].to_numpy().astype(np.int64)
    order = np.argsort(h)
    frequent = h[order], c[order]

    def word_slice(table):
        keys = table["h"].to_numpy().view(np.uint64)
        levels = level_of(table["c"].to_numpy())
        number = int(_slice_of(keys[:1], slices)[0])
        return pa.table({"slice": pa.array([number], pa.int32()), "bits": pa.array([build_slice(keys, levels, slice_bits(levels)).tobytes()], pa.binary())})

    # The mark before a text counts as a history, as often as there are texts.
    marked = words.union(spark.createDataFrame([(int(np.array([START]).view(np.int64)[0]), documents)], "h long, c long")) if documents else words

    def add_slice(batches):
        for batch in batches:
            number = _slice_of(column_of(batch, "h").to_numpy(zero_copy_only=False).view(np.uint64), slices)
            yield pa.RecordBatch.from_arrays([pa.array(number, pa.int32()), *batch.columns], names=["slice", *batch.schema.names])

    word_filter, word_path = write_table(marked.mapInArrow(add_slice, "slice int, h long, c long").groupBy("slice").applyInArrow(word_slice, "slice int, bits binary"), "lm-filter")

    known = spark.sparkContext.broadcast((frequent[0], level_of(frequent[1]).astype(np.uint64)))

    def pair_keys(hashes, bounds):
        """Pairs and their histories; frequent words stand as their levels, which are below all hashes."""
        before = _histories(hashes, bounds)
        codes, different = pd.factorize(before.view(np.int64))
        different, (often, levels) = different.view(np.uint64), known.value
        if len(often):
            at = np.minimum(np.searchsorted(often, different), len(often) - 1)
            different = np.where(often[at] == different, levels[at], different)
        return _pair(before, hashes), different[codes]

    def pair_slice(table):
        keys, counts, before = _merge(table, "<u8")
        levels = level_of(counts)
        bits = build_slice(keys, levels, slice_bits(levels))
        histories, different = np.unique(before, return_counts=True)
        return pa.table({"slice": table["slice"].slice(0, 1).combine_chunks(), "bits": pa.array([bits.tobytes()], pa.binary()),
                         "h": pa.array([signed(histories)], pa.list_(pa.int64())), "n": pa.array([different], pa.list_(pa.int64()))})

    pairs = texts.mapInArrow(lambda it: _combined(it, "text", pair_keys, slices), _BLOBS)
    with shuffles_removed(spark):
        pair_filter, pair_path = write_table(pairs.groupBy("slice").applyInArrow(pair_slice, "slice int, bits binary, h array<long>, n array<long>"), "lm-pairs")
    followed = pair_filter.select(F.explode(F.arrays_zip("h", "n")).alias("x")).groupBy(F.col("x.h").alias("h")).agg(F.sum("x.n").alias("n"))
    different = np.zeros(LEVELS + 1)
    by_hash = followed.join(marked, "h").select(level.alias("level"), "n")
    by_number = followed.filter(F.col("h").between(1, LEVELS)).select(F.col("h").cast("int").alias("level"), "n")
    for r in by_hash.union(by_number).groupBy("level").agg(F.sum("n").alias("n")).collect():
        different[r["level"]] = r["n"]
    known.unpersist()
    histories = np.zeros(LEVELS + 1)
    for r in by_level:
        histories[r["level"]] += r["kinds"]
    pseudo = np.maximum(different / np.maximum(histories, 1), 0.5)
    filters = word_filter.select("slice", F.lit(0).alias("kind"), "bits").union(pair_filter.select("slice", F.lit(1).alias("kind"), "bits"))
    return Model(words, total, kinds, frequent, slices, filters, pseudo, (words_path, word_path, pair_path))


def _packed(values):
    """Small numbers as compressed planes of their bytes."""
    return zlib.compress(np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _unpacked(raw):
    planes = np.frombuffer(zlib.decompress(raw), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def _chunk(batch, row):
    """A staged chunk: its words, its different pairs as (key, history, word), each token's pair, and the texts' bounds."""
    words = np.frombuffer(column_of(batch, "words")[row].as_py(), "<u8")
    codes, sizes = (_unpacked(column_of(batch, c)[row].as_py()) for c in ("codes", "sizes"))
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    of, pairs = pd.factorize(_histories(codes, bounds, column_of(batch, "mark")[row].as_py()) * len(words) + codes)
    history, word = np.divmod(pairs, len(words))
    return words, _pair(words[history], words[word]), history, word, of, bounds


def _blocks(model):
    """Ranges of slices whose filters have at most `FILTER_BLOCK` bytes together."""
    sizes = model.filters.groupBy("slice").agg(F.sum(F.octet_length("bits")).alias("n")).orderBy("slice").collect()
    starts, held = [0], 0
    for r in sizes:
        if held and held + r["n"] > FILTER_BLOCK:
            starts.append(r["slice"])
            held = 0
        held += r["n"]
    return list(zip(starts, [*starts[1:], model.slices]))


def _load(model, first, stop):
    """The filters of words and of pairs with the bits of a range of slices."""
    table = model.filters.filter(F.col("slice").between(first, stop - 1)).toArrow().sort_by("slice")
    filters = []
    for kind in (0, 1):
        own = table.filter(pc.equal(table["kind"], kind))
        bits = [np.frombuffer(b.as_buffer(), np.uint8) for b in own["bits"]]
        sizes = np.zeros(model.slices, np.int64)
        sizes[own["slice"].to_numpy()] = [8 * len(b) for b in bits]
        filters.append(Filter(model.slices, sizes, np.concatenate([np.zeros(0, np.uint8), *bits])))
    return filters


_ANSWERS = "chunk long, first int, words binary, pairs binary"


def _pass(chunked, filters, first, stop, slices):
    """Probe one block: a byte for each of a chunk's words and pairs that belong to its slices, in the chunk's order."""
    schema = arrow_schema(_ANSWERS)

    def probe(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                found = []
                for keys, built in zip(_chunk(batch, row), filters.value):
                    where = _slice_of(keys, slices)
                    own = keys[(where >= first) & (where < stop)]
                    found.append(zlib.compress(built.levels(own).astype(np.uint8).tobytes(), 1))
                yield record(schema, chunk=[column_of(batch, "chunk")[row].as_py()], first=[first], words=found[:1], pairs=found[1:])

    return chunked.mapInArrow(probe, _ANSWERS)


def _answered(keys, answers, blocks, slices):
    """The levels of a chunk's keys from the answers of all blocks, which are in the blocks' order."""
    block = np.searchsorted([first for first, _ in blocks], _slice_of(keys, slices), "right")
    levels = np.empty(len(keys), np.int64)
    levels[np.argsort(block, kind="stable")] = np.frombuffer(b"".join(zlib.decompress(x) for x in answers.to_pylist()), np.uint8)
    return levels


def _probed(chunked, model, blocks):
    """The answers of all blocks, one pass after the other: a written table and its folder."""
    spark = chunked.sparkSession
    path = new_path(spark, "lm-levels")
    for first, stop in blocks:
        shared = spark.sparkContext.broadcast(_load(model, first, stop))
        _pass(chunked, shared, first, stop, model.slices).write.mode("append").parquet(path)
        shared.destroy()
    return spark.read.schema(_ANSWERS).parquet(path), path


def score_texts(docs, model, id_col="doc_id", text_col="text", keep=()):
    """`n_tokens`, `n_known`, `train_tokens`, `base_score` and `score` for every row.

    Scores are log10 probabilities of whole texts with their ends. A missing or empty text
    is its end alone; without training tokens every word has the same share. Repeated rows are
    scored each. `keep` names further columns to carry along. The result is a written table;
    what it was made from is removed.
    """
    spark = small_batches(docs.sparkSession)
    kinds = dict(docs.dtypes)
    carried = [id_col, *keep]
    columns = "_row long, n_tokens long, known long, base double, rare array<long>, words binary, codes binary, mark long, sizes binary"
    schema = arrow_schema(columns)
    shared = spark.sparkContext.broadcast(model.frequent)
    blocks = _blocks(model)
    whole, slices, pseudo = model.tokens + 0.5 * (model.kinds + 1), model.slices, model.pseudo

    def run(batches):
        often, often_counts = shared.value
        place = task_rows()
        for batch in chunks(batches, text_col, SCORED_BYTES):
            hashes, bounds = tokens(*text_bytes(column_of(batch, text_col)))
            codes, kinds = pd.factorize(hashes.view(np.int64))
            kinds = kinds.view(np.uint64)
            at = np.minimum(np.searchsorted(often, kinds), max(len(often) - 1, 0))
            exact = often[at] == kinds if len(often) else np.zeros(len(kinds), bool)
            base = np.zeros(len(kinds))
            if len(often):
                base[exact] = np.log10((often_counts[at[exact]] + 0.5) / whole)
            sizes = np.diff(bounds)
            # The first row of a chunk carries its words.
            rest = [None] * (batch.num_rows - 1)
            out = record(
                schema, _row=place(batch.num_rows), n_tokens=sizes, known=sums(exact[codes].astype(np.int64), bounds),
                base=sums(base[codes], bounds), rare=_lists(signed(hashes), ~exact[codes], bounds), words=[np.append(kinds, START).tobytes(), *rest],
                codes=[_packed(codes), *rest], mark=[len(kinds), *rest], sizes=[_packed(sizes), *rest])
            yield pa.RecordBatch.from_arrays([*(column_of(batch, c) for c in carried), *out.columns], names=[*carried, *schema.names])

    def finish(staged, answers):
        rows, scores = np.zeros(0, np.int64), np.zeros(0)
        if staged.num_rows:
            words, keys, history, word, of, bounds = _chunk(staged.combine_chunks().to_batches()[0], 0)
            answers = answers.sort_by("first")
            levels, pair_levels = _answered(words, answers["words"], blocks, slices), _answered(keys, answers["pairs"], blocks, slices)
            counts = count_of(levels)
            own = ((counts + 0.5) / whole)[word]
            weight, extra = counts[history], pseudo[levels[history]]
            seen = np.minimum(count_of(pair_levels), weight)
            chance = np.where(weight > 0, (seen + extra * own) / (weight + extra), own)
            scores = sums(np.log10(np.minimum(chance, 1.0))[of], bounds)
            rows = staged["chunk"][0].as_py() + np.arange(len(scores))
        return pa.table({"_row": pa.array(rows, pa.int64()), "score": pa.array(scores, pa.float64())})

    head = ", ".join(f"`{c}` {kinds[c]}" for c in carried)
    scored, scored_path = write_table(docs.select(*carried, text_col).mapInArrow(run, f"{head}, {columns}"), "lm-scored")
    chunked = scored.filter(F.col("words").isNotNull()).select(F.col("_row").alias("chunk"), "words", "codes", "mark", "sizes")
    answers, answers_path = _probed(chunked, model, blocks)
    with shuffles_removed(spark):
        paired, paired_path = write_table(chunked.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(finish, "_row long, score double"), "lm-scores")
    delete_path(spark, answers_path)
    rare = scored.select("_row", F.explode("rare").alias("h")).join(model.words, "h", "left")
    rare = rare.groupBy("_row").agg(
        F.sum(F.log10((F.coalesce("c", F.lit(0)) + 0.5) / whole)).alias("_rare_base"), F.count("c").alias("_rare_known"))
    none = F.lit(0)
    result = scored.select(*carried, "_row", "n_tokens", "known", "base").join(paired, "_row").join(rare, "_row", "left").select(
        *carried, "n_tokens", (F.col("known") + F.coalesce("_rare_known", none)).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("_rare_base", F.lit(0.0))).alias("base_score"), "score")
    with shuffles_removed(spark):
        result, _ = write_table(result, "lm-result")
    for path in (scored_path, paired_path):
        delete_path(spark, path)
    shared.unpersist()
    return result


def _lists(values, mask, bounds):
    """The masked values of each text as a list column."""
    ends = np.concatenate([[0], np.cumsum(mask)])[bounds].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values[mask]))
