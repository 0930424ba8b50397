"""The strongest collocations of every language, by best-first growth of phrases.

Phrases grow from their first words. A phrase's own count bounds the score of all that start
with it: with a <= f(xy), the cut after x gives a*a / (f(x) * f(yz)) <= min(f(xy), most any pair
from y on has) / f(x). So pairs are nodes with a best possible score, for themselves and
for the triples below them, and the frontier is expanded from the best node on:

1. Words and pairs are counted. Words below the least count are not grown; no phrase can be more
   frequent than its words.
2. The nodes with the highest bounds of each language are expanded: all triples that hold them are
   counted in one pass over the texts. This settles the nodes, as a pair is dropped where a
   triple around it has half its count, and scores the triples.
3. The score of the 2000th settled phrase is a threshold. Nodes whose bound does not reach it
   can hold nothing above it or equal to it; while others are left, the next ones are expanded.

Counts are exact at every step. What a pass has to look for is broadcast as a bitmap of
hashes: it may let through what is not wanted, which then is counted in full and changes nothing,
but nothing wanted is left out. So its size is bounded whatever the number of phrases. Words
are handled as 64-bit hashes that differ by language; the words of the result are looked up again.
"""

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..sources.storage import delete_path, write_table
from .common import LOWER, Hasher, arrow_schema, chunks, column_of, mix, record, row_bounds, rows_of, signed, small_batches, text_bytes, word_spans

TOP = 2000
LEAST = 10
# A phrase is dropped inside a longer one with this percentage of its count.
INSIDE_PERCENT = 50
SCALE = 1_000_000
NO_LANGUAGE = "und"
# Nodes of each language in the first expansion, and how many times more are open to each next one.
FIRST_NODES = 4
GROWTH = 8
# Bits for each wanted phrase, and the most a bitmap may have (32 MB).
BITS_EACH, MOST_BITS = 16, 1 << 28
COMBINED = 1 << 20
TEXT_BYTES = 1 << 20

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[list(b".,;:!?\n\x0b\x0c\r")] = True
_WORD = ~_SEPARATOR
_WORD[list(b" \t")] = False


def _salts(langs):
    """A number for every row's language."""
    codes = langs.dictionary_encode()
    own = [int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in codes.dictionary.to_pylist()]
    return np.array(own, np.uint64)[codes.indices.to_numpy()]


def words_of(batch):
    """Bytes, starts, ends, rows and hashes of all words, and whether the next word follows in the same piece."""
    raw, offsets = text_bytes(column_of(batch, "text"))
    data = LOWER[raw]
    starts, ends = word_spans(data, offsets, _WORD)
    rows = rows_of(row_bounds(starts, offsets))
    hashes = mix(Hasher(data)(starts, ends) + _salts(column_of(batch, "lang"))[rows])
    breaks = np.concatenate([[0], np.cumsum(_SEPARATOR[data])])
    follows = (rows[1:] == rows[:-1]) & (breaks[starts[1:]] == breaks[ends[:-1]])
    return data, starts, ends, rows, hashes, follows


def pair_keys(first, second):
    return mix(first * np.uint64(3) + second * np.uint64(5))


def _texts(docs, text_col, lang_col):
    return docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANGUAGE)).alias("lang"))


def count_words(texts):
    """(h, lang, word, f) of all words."""
    columns = "h long, lang string, word string, n long"
    schema = arrow_schema(columns)

    def run(batches):
        for batch in chunks(batches, "text", TEXT_BYTES):
            data, starts, ends, rows, hashes, _ = words_of(batch)
            codes, kinds = pd.factorize(signed(hashes))
            if not len(kinds):
                continue
            first = np.flatnonzero(np.diff(np.maximum.accumulate(codes), prepend=-1))
            raw = data.tobytes()
            words = [raw[a:b].decode() for a, b in zip(starts[first].tolist(), ends[first].tolist())]
            yield record(schema, h=kinds, lang=column_of(batch, "lang").take(pa.array(rows[first])), word=words, n=np.bincount(codes))

    return texts.mapInArrow(run, columns).groupBy("h", "lang", "word").agg(F.sum("n").alias("f"))


class Bitmap:
    """Which hashes may be wanted: a bit for each, without false misses."""

    def __init__(self, bits):
        self.bits = np.frombuffer(bits, np.uint8)
        self._mask = np.uint64(8 * len(bits) - 1)

    def __contains__(self, key):
        return bool(self.has(np.array([key], np.uint64))[0])

    def has(self, keys):
        slot = (keys & self._mask).astype(np.int64)
        return (self.bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)


def bitmap(hashes, column, n, bits_each=BITS_EACH, most=MOST_BITS):
    """The bitmap of a column of `n` hashes, put together from blocks of 4 KB that Spark builds."""
    size = 1 << 15
    while size < min(bits_each * n, most):
        size *= 2
    slot = F.col(column).bitwiseAND(F.lit(size - 1)) + 1
    found = hashes.groupBy(F.bitmap_bucket_number(slot).alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
    out = bytearray(size // 8)
    for r in found.toLocalIterator():
        at = (r["block"] - 1) * 4096
        out[at : at + 4096] = r["bits"]
    return Bitmap(bytes(out))


def _combined(occurrences, width):
    """Rows of hashes with their counts, combined over about a million occurrences of a task at a time."""
    names = [f"h{k}" for k in range(width)]
    schema = arrow_schema(", ".join(f"{c} long" for c in [*names, "n"]))

    def flush(held):
        columns = [np.concatenate(x) for x in zip(*held)]
        key = columns[0]
        for c in columns[1:]:
            key = pair_keys(key, c)
        codes, kinds = pd.factorize(signed(key))
        if len(kinds):
            first = np.flatnonzero(np.diff(np.maximum.accumulate(codes), prepend=-1))
            yield record(schema, n=np.bincount(codes), **{c: signed(x[first]) for c, x in zip(names, columns)})

    held, size = [], 0
    for found in occurrences:
        held.append(found)
        size += len(found[0])
        if size >= COMBINED:
            yield from flush(held)
            held, size = [], 0
    if held:
        yield from flush(held)


def count_pairs(texts, wanted, least):
    """(h0, h1, a) of all pairs with `least` occurrences; both words are in the bitmap `wanted`."""
    def occurrences(batches):
        for batch in chunks(batches, "text", TEXT_BYTES):
            *_, hashes, follows = words_of(batch)
            known = wanted.value.has(hashes)
            at = np.flatnonzero(follows & known[1:] & known[:-1])
            yield hashes[at], hashes[at + 1]

    found = texts.mapInArrow(lambda it: _combined(occurrences(it), 2), "h0 long, h1 long, n long")
    return found.groupBy("h0", "h1").agg(F.sum("n").alias("a")).filter(F.col("a") >= least)


def count_triples(texts, frequent, expanded, least):
    """(h0, h1, h2, a) of all triples with `least` occurrences of frequent pairs, one of which is expanded."""
    def occurrences(batches):
        for batch in chunks(batches, "text", TEXT_BYTES):
            *_, hashes, follows = words_of(batch)
            first = np.flatnonzero(follows[1:] & follows[:-1])
            keys = pair_keys(hashes[:-1], hashes[1:]) if len(hashes) else hashes
            first = first[frequent.value.has(keys[first]) & frequent.value.has(keys[first + 1])]
            at = first[expanded.value.has(keys[first]) | expanded.value.has(keys[first + 1])]
            yield hashes[at], hashes[at + 1], hashes[at + 2]

    found = texts.mapInArrow(lambda it: _combined(occurrences(it), 3), "h0 long, h1 long, h2 long, n long")
    return found.groupBy("h0", "h1", "h2").agg(F.sum("n").alias("a")).filter(F.col("a") >= least)


def _keyed(pairs):
    """Pairs with the hash that bitmaps use."""
    def run(batches):
        for batch in batches:
            h0, h1 = (column_of(batch, c).to_numpy().view(np.uint64) for c in ("h0", "h1"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(signed(pair_keys(h0, h1)))], names=[*batch.schema.names, "key"])

    return pairs.mapInArrow(run, "h0 long, h1 long, a long, key long")


def exact_score(a, left, right):
    """floor(1000000 * a * a / (left * right)) in 38 digits."""
    a, left, right = (F.col(c).cast("decimal(15,0)") for c in (a, left, right))
    top = F.lit(SCALE).cast("decimal(7,0)") * a * a
    return F.call_function("div", top.cast("decimal(38,0)"), (left * right).cast("decimal(38,0)"))


def _nodes(pairs, words):
    """Pairs with their language, parts, score and `best`: the most that they or a triple from them on can score."""
    most = pairs.groupBy(F.col("h0").alias("h1")).agg(F.max("a").alias("most"))
    left = words.select(F.col("h").alias("h0"), "lang", F.col("f").alias("l"))
    right = words.select(F.col("h").alias("h1"), F.col("f").alias("r"))
    parts = pairs.join(left, "h0").join(right, "h1").join(most, "h1", "left").withColumn("score", exact_score("a", "l", "r"))
    below = F.expr(f"{SCALE} * least(a, coalesce(most, 0)) div l")
    return parts.select("h0", "h1", "key", "lang", "a", "l", "r", "score", F.greatest("score", below).alias("best"))


def _reached(rows, value, many):
    """Per language the highest value that at least `many` rows reach; rows of languages with fewer are left out."""
    steps = rows.groupBy("lang", value).count()
    falling = Window.partitionBy("lang").orderBy(F.col(value).desc()).rowsBetween(Window.unboundedPreceding, 0)
    return steps.withColumn("reach", F.sum("count").over(falling)).filter(F.col("reach") >= many).groupBy("lang").agg(F.max(value).alias("at"))


def _triple_scores(triples, pairs, words):
    """Triples with language, `l`, `r` and `score` of their lowest cut, the first of equal ones."""
    one = words.select(F.col("h").alias("h0"), "lang", F.col("f").alias("l1"))
    three = words.select(F.col("h").alias("h2"), F.col("f").alias("r2"))
    head = pairs.select("h0", "h1", F.col("a").alias("l2"))
    tail = pairs.select(F.col("h0").alias("h1"), F.col("h1").alias("h2"), F.col("a").alias("r1"))
    parts = triples.join(head, ["h0", "h1"]).join(tail, ["h1", "h2"]).join(one, "h0").join(three, "h2")
    cuts = F.least(*[F.struct(exact_score("a", f"l{k}", f"r{k}").alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")) for k in (1, 2)])
    return parts.withColumn("cut", cuts).select("h0", "h1", "h2", "lang", "a", "cut.l", "cut.r", "cut.score")


def _survivors(nodes, triples, inside_percent):
    """Expanded pairs that no triple around them makes superfluous."""
    around = triples.select("h0", "h1", "a").union(triples.select("h1", "h2", "a")).groupBy("h0", "h1").agg(F.max("a").alias("longer"))
    kept = nodes.join(around, ["h0", "h1"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < inside_percent * F.col("a")))
    return kept.select("h0", "h1", F.lit(None).cast("long").alias("h2"), "lang", "a", "l", "r", "score")


def collocations(docs, text_col="text", lang_col="lang", top=TOP, least=LEAST, inside_percent=INSIDE_PERCENT, first_nodes=None, most_bits=MOST_BITS):
    """Each language's first `top` phrases of two and three words: lang, rank, phrase, a, l, r, n, score.

    The order is by score, then count, then phrase (in the order of bytes). A missing text is
    empty, a missing language `und`. Languages without a phrase of `least` occurrences have no row.
    Repeated rows count each; other columns are ignored.
    """
    spark = small_batches(docs.sparkSession)
    texts = _texts(docs, text_col, lang_col)
    done = []

    def written(frame, name):
        table, path = write_table(frame, f"phrases-{name}")
        done.append(path)
        return table

    def shared(table, column):
        n = table.count()
        return spark.sparkContext.broadcast(bitmap(table, column, n, most=most_bits))

    words = written(count_words(texts), "words")
    frequent_words = words.filter(F.col("f") >= least)
    wanted = shared(frequent_words, "h")
    pairs = written(_keyed(count_pairs(texts, wanted, least)), "pairs")
    wanted.unpersist()
    nodes = written(_nodes(pairs, frequent_words), "nodes")
    frequent = shared(pairs, "key")
    many, closed, settled, triples = first_nodes or FIRST_NODES * top, None, None, None
    threshold = spark.createDataFrame([], "lang string, threshold long")
    while True:
        # The frontier of each language: its nodes from `cut` on, of which those below `closed` are new.
        cut = _reached(nodes, "best", many).withColumnRenamed("at", "cut")
        languages = nodes.select("lang").distinct().join(cut, "lang", "left").join(threshold, "lang", "left")
        limits = languages.select("lang", F.greatest(F.coalesce("cut", F.lit(0)), F.coalesce("threshold", F.lit(0))).alias("cut"))
        limits = written(limits if closed is None else limits.join(closed.withColumnRenamed("cut", "closed"), "lang", "left"), "limits")
        new = F.col("best") >= F.col("cut")
        if closed is not None:
            new = new & (F.col("best") < F.col("closed"))
        opened = written(nodes.join(limits, "lang").filter(new).select(*nodes.columns), "opened")
        expanded = shared(opened, "key")
        found = written(_triple_scores(written(count_triples(texts, frequent, expanded, least), "triples"), pairs, frequent_words), "scored")
        expanded.unpersist()
        kept = written(_survivors(opened, found, inside_percent), "kept")
        settled = kept if settled is None else settled.union(kept)
        triples = found if triples is None else triples.union(found)
        # A triple of two expanded pairs may have been counted twice, each time in full.
        rows = written(settled.union(triples.dropDuplicates(["h0", "h1", "h2"])), "rows")
        threshold = written(_reached(rows, "score", top).withColumnRenamed("at", "threshold"), "threshold")
        closed = limits.select("lang", "cut")
        open_ = nodes.join(closed, "lang").join(threshold, "lang", "left").filter((F.col("best") < F.col("cut")) & (F.col("best") >= F.coalesce("threshold", F.lit(0))))
        if open_.isEmpty():
            break
        many *= GROWTH
    frequent.unpersist()

    best = written(rows.join(threshold, "lang", "left").filter(F.col("score") >= F.coalesce("threshold", F.lit(0))).drop("threshold"), "best")
    for k in range(3):
        best = best.join(frequent_words.select(F.col("h").alias(f"h{k}"), F.col("word").alias(f"w{k}")), f"h{k}", "left")
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = best.withColumn("phrase", F.concat_ws(" ", "w0", "w1", "w2")).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    total = words.groupBy("lang").agg(F.sum("f").alias("n"))
    result = ranked.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
    # The result is a few rows a language; the working tables go.
    out, _ = write_table(result, "collocations")
    for path in done:
        delete_path(spark, path)
    return out
