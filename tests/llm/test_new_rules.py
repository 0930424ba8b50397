"""Product codes, whole-corpus packing and collocations against plain versions on small inputs."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from conftest import DATA
from pyspark.sql import functions as F
from test_rules import LONG, TEXTS, frame

from chatterlake.llm import byte_tokens, collocations, matched_packing, vector_codes
from chatterlake.llm.common import text_bytes

RNG = random.Random(7)


# ---------------------------------------------------------------- vector codes
def plain_codes(rows, parts=8, entries=16, rounds=6):
    """(id, label, vector) rows to (id, label, code, error) and the books, one part at a time."""
    kept = [(i, label, [int(np.floor(4096 * x)) for x in v]) for i, label, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, np.array(r[2], "<i4").tobytes()))
    if not kept:
        return [], []
    size = len(kept[0][2]) // parts
    cut = [[v[p * size : (p + 1) * size] for _, _, v in kept] for p in range(parts)]
    books = [list(cut[p][:entries]) for p in range(parts)]

    def nearest(book, q):
        return min((sum((a - b) ** 2 for a, b in zip(e, q)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            own = defaultdict(list)
            for q in cut[p]:
                own[nearest(books[p], q)[1]].append(q)
            books[p] = [[sum(c) // len(own[k]) for c in zip(*own[k])] if k in own else e for k, e in enumerate(books[p])]
    found = [[nearest(books[p], q) for q in cut[p]] for p in range(parts)]
    return [(i, label, bytes(found[p][n][1] for p in range(parts)), sum(found[p][n][0] for p in range(parts))) for n, (i, label, _) in enumerate(kept)], books


def test_orchard_search():
    rng = np.random.default_rng(3)
    for entries in (1, 2, 5, 16, 200):
        for scale in (2, 50, 5000):
            book = rng.integers(-scale, scale, (entries, 4))
            book[rng.integers(entries)] = book[0]                 # equal entries tie
            queries = rng.integers(-2 * scale, 2 * scale, (500, 4))
            square = ((queries[:, None] - book[None]) ** 2).sum(2)
            best, found = vector_codes.orchard_search(vector_codes.Neighbours.of(book), queries)
            assert (best == square.argmin(1)).all() and (found == square.min(1)).all()


def vectors(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int, code string, error int")


@pytest.mark.parametrize("kind, n", [("float", 120), ("double", 40), ("float", 5)])
def test_vector_codes(spark, kind, n):
    rows = [(k, [RNG.choice([RNG.uniform(-1, 1), 0.25, -0.0001]) for _ in range(16)], RNG.choice([1, 2, None]), "x", 1) for k in range(n)]
    rows += [(n, None, 1, "x", 1), (n + 1, [None] + [0.5] * 15, 1, "x", 1), (n + 2, [float("nan")] * 16, 2, None, 1), (n + 3, [float("inf")] + [0.0] * 15, None, "x", 1),
             (0, [0.5] * 16, None, "x", 1), (1, rows[1][1], 2, "x", 1), (None, [0.125] * 16, 1, "x", 1), (None, [-1.0] * 16, None, "x", 1)]
    table = vectors(spark, rows, kind)
    own = [(r.vec_id, r.label, r.embedding) for r in table.collect()]
    want, books = plain_codes(own)
    coded, found = vector_codes.compress_vectors(table.repartition(3))
    totals = Counter()
    for _, label, _, error in want:
        totals[label] += error
    assert sorted(((r.vec_id, r.label, bytes(r.code), r.error, r.label_error) for r in coded.collect()), key=str) == sorted(((i, x, c, e, totals[x]) for i, x, c, e in want), key=str)
    assert found.tolist() == books
    text = ",".join(str(c) for book in books for entry in book for c in entry)
    assert vector_codes.codebooks_sha256(found) == hashlib.sha256(text.encode()).hexdigest()
    codes = np.array([list(c) for _, _, c, _ in want])
    assert vector_codes.decode(codes, found).shape == (len(want), 16)


def test_vector_codes_of_odd_tables(spark):
    none = vectors(spark, [(1, None, 1, "x", 1)])
    for table in (none, none.limit(0)):
        coded, books = vector_codes.compress_vectors(table)
        assert coded.collect() == [] and books.size == 0 and coded.columns == ["vec_id", "label", "code", "error", "label_error"]
    with pytest.raises(ValueError, match="one length"):
        vector_codes.compress_vectors(vectors(spark, [(1, [0.5] * 8, 1, "x", 1), (2, [0.5] * 16, 1, "x", 1)]))
    with pytest.raises(ValueError, match="one length"):
        vector_codes.compress_vectors(vectors(spark, [(1, [0.5] * 9, 1, "x", 1)]))
    with pytest.raises(Exception, match="not supported"):
        vector_codes.compress_vectors(vectors(spark, [(1, [1e30] * 8, 1, "x", 1)]))


# ---------------------------------------------------------------- whole-corpus packing
def byte_ids(text):
    return byte_tokens.byte_tokens(byte_tokens.default_path(), 0)._tokenizer.encode(text or "", add_special_tokens=False).ids + [0]


def test_byte_tokens():
    alphabet = [*"ab'st ll.,!  \n\n\t\r12é–à  ç日本\x1c\x85<|>", "<|endoftext|>", "'s", "  ", " "]
    texts = [t or "" for t in TEXTS] + ["".join(RNG.choice(alphabet) for _ in range(RNG.randint(0, 40))) for _ in range(3000)]
    ids, offsets = byte_tokens.ByteTokens(byte_tokens.default_path())(*text_bytes(pa.array(texts, pa.string())))
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [byte_ids(t) for t in texts]


def plain_packing(sizes, capacity):
    """Filled lengths of the sequences, document by document."""
    large, small = (sorted((s for s in sizes if (3 * s > capacity) == big), reverse=True) for big in (True, False))
    bins = []
    while large:
        first = large.pop(0)
        other = next((k for k, s in enumerate(large) if first + s <= capacity), None)
        bins.append(first + (large.pop(other) if other is not None else 0))
    for size in small:
        fits = [(capacity - b, k) for k, b in enumerate(bins) if b + size <= capacity]
        if fits:
            bins[min(fits)[1]] += size
        else:
            bins.append(size)
    return sorted(bins)


def test_plan_is_that_of_single_documents():
    for _ in range(150):
        capacity = RNG.choice([8, 16, 30, 64, 2048])
        sizes = np.array([RNG.randint(1, capacity) if RNG.random() < 0.5 else max(1, int(capacity * RNG.random() ** 3)) for _ in range(RNG.randint(0, 150))], np.int64)
        plan = matched_packing.Plan(Counter(sizes.tolist()), capacity)
        ranks = matched_packing.running_ranks(sizes, np.zeros(capacity + 1, np.int64))
        where, offset = plan.places(sizes, ranks)
        filled = Counter()
        for s, k in zip(sizes.tolist(), where.tolist()):
            filled[k] += s
        assert sorted(filled.values()) == plain_packing(sizes.tolist(), capacity)
        for k in filled:
            own, end = sorted((o, s) for o, s, w in zip(offset.tolist(), sizes.tolist(), where.tolist()) if w == k), 0
            for o, s in own:
                assert o == end
                end += s
    assert matched_packing.Plan({7: 10**12, 2048: 3 * 10**12}, 2048).sequences == 3 * 10**12 + -(-10**12 // (2048 // 7))


@pytest.mark.parametrize("capacity", [64, 2048])
def test_pack_matched(spark, capacity):
    docs = frame(spark).withColumn("piece", F.lit("x")).withColumn("length", F.lit(1)).withColumn("rank", F.lit(2))
    docs = docs.union(docs.filter("doc_id < 5")).repartition(5)
    texts, copies = {r.doc_id: r.text for r in docs.collect()}, Counter(r.doc_id for r in docs.collect())
    found, sequences = defaultdict(Counter), defaultdict(list)
    for r in matched_packing.pack_matched(docs, capacity=capacity).collect():
        found[r.doc_id][(r.piece, r.start, r.length, r.ids_crc32)] += 1
        sequences[r.sequence_id].append((r.offset, r.length))
    sizes = []
    assert set(found) == set(texts)
    for key, text in texts.items():
        ids, want = byte_ids(text), Counter()
        cuts = [0, *range((len(ids) - 1) % capacity + 1, len(ids) + 1, capacity)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[(k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] += copies[key]
            sizes += [b - a] * copies[key]
        assert found[key] == want
    for own in sequences.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= capacity
    assert sorted(sum(n for _, n in own) for own in sequences.values()) == plain_packing(sizes, capacity)
    assert matched_packing.pack_matched(docs.limit(0)).collect() == []


# ---------------------------------------------------------------- collocations
def plain_collocations(rows, top=2000, least=10, percent=50):
    counts, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = lang if lang is not None else "und"
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        longer = Counter()
        for p, a in f.items():
            if len(p) == 3 and a >= least:
                for q in (p[:2], p[1:]):
                    longer[q] = max(longer[q], a)
        rank = []
        for p, a in f.items():
            if len(p) > 1 and a >= least and not (len(p) == 2 and longer[p] and 100 * longer[p] >= percent * a):
                score, k = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                rank.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for place, (score, a, phrase, left, right) in enumerate(sorted(rank)[:top], 1):
            out.append((lang, place, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def phrases():
    words = ["".join(RNG.choice("abcdeé") for _ in range(RNG.randint(1, 3))) for _ in range(14)]
    fixed = ["Alpha beta gamma", "beta gamma", "new york", "one two three four", "x\tY", "rest. of", "ça va"]
    rows = []
    for _ in range(400):
        parts = [RNG.choice(fixed) if RNG.random() < 0.3 else RNG.choice(words) for _ in range(RNG.randint(1, 25))]
        rows.append((RNG.choice(["en", "en", "en", "fr", None, "und", "a b"]), RNG.choice([" ", "  ", " "]).join(p + RNG.choice(["", "", "", ",", "!\n"]) for p in parts)))
    return rows + [("en", t) for t in TEXTS] + [("de", LONG), ("en", None), ("en", ""), (None, None), ("es", "too few words")]


@pytest.mark.parametrize("top, first_nodes, bits", [(2000, None, 1 << 28), (5, 3, 1 << 28), (30, 40, 1 << 15), (1, 1, 1 << 15)])
def test_collocations(spark, top, first_nodes, bits):
    rows = phrases()
    docs = spark.createDataFrame([(k, x, t, 1, "w") for k, (x, t) in enumerate(rows)], "doc_id long, lang string, text string, n int, word string")
    got = sorted(tuple(r) for r in collocations.collocations(docs.repartition(4), top=top, first_nodes=first_nodes, most_bits=bits).collect())
    assert got == plain_collocations(rows, top) and len(got) > 3
    assert collocations.collocations(docs.limit(0)).collect() == []


def test_scores_beyond_64_bits(spark):
    rows = [(10**14, 10**14 + 1, 10**14 + 3), (3 * 10**14, 3 * 10**14, 3 * 10**14), (10, 10**14, 11), (999_999_999_999, 10**12, 10**12)]
    table = spark.createDataFrame(rows, "a long, l long, r long").select("a", "l", "r", collocations.exact_score("a", "l", "r").alias("score"))
    assert [r.score for r in table.collect()] == [1000000 * a * a // (x * y) for a, x, y in rows]


def test_bitmap(spark):
    keys = [RNG.randrange(-(1 << 63), 1 << 63) for _ in range(3000)]
    found = collocations.bitmap(spark.createDataFrame([(k,) for k in keys], "key long"), "key", len(keys))
    assert found.has(np.array(keys, np.int64).view(np.uint64)).all()
    others = np.random.default_rng(1).integers(0, 1 << 63, 20_000).astype(np.uint64)
    assert found.has(others).mean() < 0.1
