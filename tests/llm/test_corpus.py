"""Duplicates, leaks, packing and the pipeline against plain versions on small inputs."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F
from test_rules import LONG, TEXTS, alnum, documents, frame

import corpus_pipeline
from chatterlake.llm import components, decontaminate, ngram_join, packing, suffix_dedup, token_output, tokens

RNG = random.Random(11)
WORDS = ["".join(RNG.choice("abcdefghi") for _ in range(RNG.randint(2, 8))) for _ in range(400)]


def prose(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


def edited(text, changes):
    words = text.split()
    for _ in range(changes):
        words[RNG.randrange(len(words))] = RNG.choice(WORDS)
    return " ".join(words)


# ---------------------------------------------------------------- components
def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 7), (200, 201), (300, 300)] + [(500, k) for k in range(501, 560)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert {got[k] for k in [*range(41), 100]} == {0} and got[200] == got[201] == 200 and {got[k] for k in range(500, 560)} == {500}


# ---------------------------------------------------------------- n-gram join
def plain_components(rows, words, percent):
    sets = []
    for key, text in rows:
        w = (text or "").encode().lower().split()
        sets.append((key, {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()))
    parent = list(range(len(sets)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[find(i)] = find(j)
    lowest = {}
    for i, (key, _) in enumerate(sets):
        if key is not None:
            lowest[find(i)] = min(key, lowest.get(find(i), key))
    return [(key, len(s), lowest.get(find(i), key) if s else key) for i, (key, s) in enumerate(sets)]


def near_copies():
    texts = list(TEXTS)
    for size, copies in ((12, 4), (60, 12), (150, 25), (300, 10)):
        base = prose(size)
        texts += [edited(base, RNG.randint(0, max(1, size // 40))) for _ in range(copies)]
        texts += [base, base]
    chain = prose(120)
    for _ in range(8):
        texts.append(chain)
        chain = edited(chain, 2)
    common = prose(40)
    texts += [f"{prose(10)} {common} {prose(10)}" for _ in range(12)]
    return texts


@pytest.mark.parametrize("words, percent, low, block", [(4, 85, 0.25, 400_000), (5, 80, 0.3, 3000)])
def test_ngram_components(spark, words, percent, low, block):
    docs = frame(spark, near_copies())
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.ngram_components(docs, words=words, percent=percent, low=low, block_grams=block).collect()]
    want = plain_components([(r.doc_id, r.text) for r in docs.collect()], words, percent)
    order = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(got, key=order) == sorted(want, key=order)


def test_trie_finds_every_component():
    rng = np.random.default_rng(3)
    base = rng.permutation(60)
    sets = [np.sort(np.unique(np.concatenate([base[rng.random(60) < 0.93], rng.integers(60, 90, 3)]))).astype(np.int32) for _ in range(80)]
    join = ngram_join.TrieJoin(sets, 80)
    links = join.run(90)
    for a, b in links:
        assert 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b]))
    linked = {(i, j) for i in range(80) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))}
    assert linked and all(join.find(i) == join.find(j) for i, j in linked)
    assert len({join.find(k) for k in range(80)}) == 80 - len(links)


def test_trie_of_two_sides():
    rng = np.random.default_rng(4)
    base = rng.permutation(60)
    sets = [np.unique(np.concatenate([base[rng.random(60) < 0.95], rng.integers(60, 90, 3)])) for _ in range(60)]
    sides = rng.integers(0, 2, 60)
    links = ngram_join.link_sets(np.concatenate(sets).astype(np.uint64), np.cumsum([0, *map(len, sets)]), 80, sides)
    linked = {(i, j) for i in range(60) for j in range(i) if sides[i] != sides[j] and 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))}
    parent = list(range(60))
    for a, b in links:
        assert (max(a, b), min(a, b)) in linked
        old, new = parent[a], parent[b]
        parent = [new if p == old else p for p in parent]
    assert linked and all(parent[i] == parent[j] for i, j in linked)


def test_texts_with_one_common_line(spark, monkeypatch):
    """Texts that only share a line came to one trie join as all pairs of blocks of the whole group, so its time grew with their square."""
    rng = random.Random(5)
    words = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    lines = [words(8) for _ in range(3)]
    texts = [f"{words(9)} {rng.choice(lines)} {rng.choice(lines)} {words(3)}" for _ in range(300)]
    copies = [words(60) for _ in range(8)]
    texts += [f"{lines[0]} {lines[1]} {lines[2]} {c} {words(1)}" for c in copies for _ in range(3)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4).cache()
    written = {}

    def write_table(df, name="stage"):
        out = table(df, name)
        written.setdefault(name, []).append(out[0].collect() if name in ("stands", "totals") else None)
        return out

    table = ngram_join.write_table
    monkeypatch.setattr(ngram_join, "write_table", write_table)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.ngram_components(docs, block_grams=1200).collect()]
    assert sorted(got) == sorted(plain_components(list(enumerate(texts)), 4, 85))
    assert len(written["stands"][0]) > 100
    assert {r.blocks for r in written["totals"][0]} == {1} and max(r.sets for r in written["totals"][0]) < 30


def test_ngram_empty(spark):
    assert ngram_join.ngram_components(frame(spark).limit(0)).count() == 0


# ---------------------------------------------------------------- suffixes
def plain_removal(texts, length):
    counts = Counter(t[k : k + length] for t in texts for k in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for k in range(len(t) - length + 1):
            if counts[t[k : k + length]] > 1:
                gone[k : k + length] = True
        gone = gone[:-1]
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(t) else 0
        out.append((len(t), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest()))
    return out


def repeats():
    passage, long_passage, edge = prose(80)[:430], prose(500), prose(100)[:400]
    texts = [None, "", "short", "Der " * 300, "x" * 399, "x" * 401, edge, f"a{edge}b", edge[:399] + "#" + prose(30), f"é{prose(90)}ü"]
    texts += [f"{prose(30)} {passage} {prose(20)}" for _ in range(5)]
    texts += [f"{prose(3)}{long_passage[k:]}{prose(4)}" for k in (0, 1, 250, 700, 1500)]
    texts += [f"{prose(40)}{long_passage[900:1500]}{long_passage[100:700]}", long_passage, long_passage, edited(long_passage, 3), "ßü" * 400, "xßü" + "ßü" * 250, LONG]
    return texts


@pytest.mark.parametrize("length", [400, 1000])
def test_repeats_removed(spark, length):
    """1000 bytes need the names of triples to be named once more."""
    docs = frame(spark, repeats())
    rows = docs.collect()
    want = Counter((r.doc_id, *x) for r, x in zip(rows, plain_removal([(r.text or "").encode() for r in rows], length)))
    found = suffix_dedup.remove_repeats(docs, length=length).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found) == want
    assert all(r.kept is None or len(r.kept.encode()) <= r.n_bytes - r.n_removed for r in found)


def test_passages_removed(spark):
    """Planted passages of 51 words and under 400 bytes are found as passages; what 400 bytes remove is as before."""
    planted = [prose(51) for _ in range(6)]
    assert all(200 <= len(p) < 400 for p in planted)
    texts = repeats() + [f"{prose(40)} {p} {prose(30)}" for p in planted for _ in range(2)] + [prose(120) for _ in range(8)]
    docs = frame(spark, texts)
    rows = docs.collect()
    raw = [(r.text or "").encode() for r in rows]
    want = Counter((r.doc_id, *x, *y[1:3]) for r, x, y in zip(rows, plain_removal(raw, 400), plain_removal(raw, 200)))
    found = suffix_dedup.remove_repeats_and_passages(docs).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.n_passage_bytes, r.n_passages) for r in found) == want
    got = {r.doc_id: r for r in found if r.doc_id is not None}
    for r in rows[len(texts) - 20 : len(texts) - 8]:
        own = next(p for p in planted if p in r.text)
        assert got[r.doc_id].n_passage_bytes >= len(own) and own not in got[r.doc_id].kept_outside_passages and own in got[r.doc_id].kept
    assert all(got[r.doc_id].kept_outside_passages == r.text and not got[r.doc_id].n_passages for r in rows[len(texts) - 8 : len(texts) - 1])


def test_repeats_of_documents(spark):
    from chatterlake.llm.queries import op10_suffix_dedup

    rows = documents(spark).collect()
    want = {r.doc_id: x for r, x in zip(rows, plain_removal([r.text.encode() for r in rows], 400))}
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op10_suffix_dedup(spark, DATA).collect()} == want


def test_repeats_edges(spark):
    assert suffix_dedup.remove_repeats(frame(spark).limit(0)).count() == 0
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeats(frame(spark), length=300)


def test_cover():
    distances = {(a - b) % suffix_dedup.PERIOD for a in suffix_dedup.COVER for b in suffix_dedup.COVER}
    assert distances == set(range(suffix_dedup.PERIOD))


@pytest.mark.parametrize("period", suffix_dedup.COVERS)
def test_covers(period):
    cover = suffix_dedup.COVERS[period]
    assert {(a - b) % period for a in cover for b in cover} == set(range(period))


def test_neighbours_over_batches(spark):
    import pyarrow as pa

    names = [1, 2, 2, 3, 3, 3, 3, 3, 4, 5, 5]
    for cuts in range(1 << (len(names) - 1)):
        edges = [0, *[k + 1 for k in range(len(names) - 1) if cuts >> k & 1], len(names)]
        batches = [pa.record_batch({"name": names[a:b], "p": list(range(a, b))}) for a, b in zip(edges, edges[1:])]
        run = {}
        suffix_dedup._neighbours(type("Frame", (), {"mapInArrow": lambda self, f, s: run.update(f=f)})())
        got = [p for batch in run["f"](iter(batches)) for p in batch.column("p").to_pylist()]
        assert got == [1, 2, 3, 4, 5, 6, 7, 9, 10]


# ---------------------------------------------------------------- test items
def plain_contained(docs, items, words=5, containment=0.8):
    def grams(w, n):
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}

    found = []
    for key, text in docs:
        w = alnum((text or "").lower())
        for item, item_text in items:
            v = alnum((item_text or "").lower())
            n = min(words, len(v))
            own = grams(v, n) if v else set()
            shared = len(own & grams(w, n)) if v else 0
            if own and shared >= containment * len(own) - 1e-9:
                found.append((key, item, len(own), shared))
    return sorted(found, key=str)


@pytest.mark.parametrize("block", [decontaminate.BLOCK_BYTES, 300])
def test_contained(spark, block):
    items = [(i, prose(RNG.randint(8, 60))) for i in range(12)] + [(50, None), (51, ""), (52, "one two"), (53, prose(8)), (53, "Tie, tie tie tie tie tie!")]
    texts = TEXTS + [f"{prose(300)} {text} {prose(200)}" for _, text in items[:6]] + [edited(f"{prose(9)} {text} {prose(9)}", k) for k, (_, text) in enumerate(items[6:12])]
    texts += ["so ONE, two three", "tie tie tie tie tie tie tie", items[0][1].upper().replace(" ", ", ")]
    docs = frame(spark, texts)
    table = spark.createDataFrame(items, "item_id long, text string")
    got = [(r.doc_id, r.item_id, r.n_item, r.n_shared) for r in decontaminate.find_contained(docs, table, block_bytes=block).collect()]
    want = plain_contained([(r.doc_id, r.text) for r in docs.collect()], items)
    assert sorted(got, key=str) == want and len({g[0] for g in got}) > 8
    left = decontaminate.without_contained(docs, table, block_bytes=block)
    assert left.columns == docs.columns
    assert sorted(r.doc_id or -1 for r in left.collect()) == sorted((r.doc_id or -1) for r in docs.collect() if r.doc_id not in {w[0] for w in want})


def test_contained_without_items(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_contained(frame(spark), none).count() == 0
    assert decontaminate.without_contained(frame(spark), none).count() == len(TEXTS) + 2


# ---------------------------------------------------------------- tokens and packing
def own_ids(text):
    return tokens.word_tokens(tokens.default_path(), 1)._tokenizer.encode(text or "", add_special_tokens=False).ids + [1]


STRANGE = ["it's <|endoftext|> a<|endoftext|>b", "é x.́y z", "\x01 a\x01b", "ÄÖ ΣΑΣ. 1234", "tail \t\n", "a,b;c'd(e)f"]


def test_word_tokens(spark):
    import pyarrow as pa

    texts = TEXTS + STRANGE + [RNG.choice(["", " "]).join(RNG.choice([*"ab.,'<|>1é\x01 \n", "'s", "<|endoftext|>"]) for _ in range(30)) for _ in range(300)]
    from chatterlake.llm.common import text_bytes

    ids, offsets = tokens.WordTokens(tokens.default_path())(*text_bytes(pa.array(texts, pa.string())))
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [own_ids(t) for t in texts]


def check_fit(sizes, where, offset, capacity):
    filled = defaultdict(list)
    for s, w, o in zip(sizes, where, offset):
        filled[int(w)].append((int(o), int(s)))
    for parts in filled.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(s for _, s in parts[:k]) for k in range(len(parts))] and sum(s for _, s in parts) <= capacity
    return len(filled)


def plain_fit(sizes, capacity, best):
    rooms = []
    for size in sorted(sizes, reverse=True):
        fits = [k for k, room in enumerate(rooms) if room >= size]
        if not fits:
            rooms.append(capacity - size)
        else:
            k = min(fits, key=lambda k: rooms[k]) if best else fits[0]
            rooms[k] -= size
    return sorted(rooms)


@pytest.mark.parametrize("fit, best", [(packing.first_fit_decreasing, False), (token_output.best_fit_decreasing, True)])
def test_fits_like_the_plain_rule(fit, best):
    for n in (1, 2, 7, 300):
        sizes = [RNG.randint(1, 64) for _ in range(n)]
        where, offset = fit(sizes, 64)
        check_fit(sizes, where, offset, 64)
        used = np.bincount(where, weights=sizes)
        assert sorted(64 - used[used > 0]) == plain_fit(sizes, 64, best)
    assert len(fit([], 64)[0]) == 0


def test_packing(spark):
    docs = frame(spark, TEXTS + STRANGE + [prose(900)])
    rows = packing.pack_documents(docs, capacity=128, group_documents=4).collect()
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
    texts = {r.doc_id: r.text for r in docs.collect()}
    copies = Counter(r.doc_id for r in docs.collect())
    for key, own in by_doc.items():
        ids = own_ids(texts[key])
        assert Counter(r.start for r in own) == Counter({s: copies[key] for s in range(0, len(ids), 128)})
        for r in own:
            part = ids[r.start : r.start + 128]
            assert (r.length, r.doc_tokens) == (len(part), len(ids))
            assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
    assert set(by_doc) == set(texts)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append(r)
    for own in sequences.values():
        check_fit([r.length for r in own], [0] * len(own), [r.offset for r in own], 128)
        filled = sum(r.length for r in own)
        assert {r.padding for r in own} == {0 if filled & (filled - 1) == 0 else 128 - filled}
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_matrices_round_trip(spark, tmp_path):
    docs = frame(spark, TEXTS + STRANGE + [prose(900)])
    path = token_output.write_matrices(token_output.packed_matrices(docs, capacity=128, pad_id=9, group_tokens=400), str(tmp_path / "packed"))
    rows = spark.read.parquet(path).collect()
    found = defaultdict(dict)
    for r in rows:
        [ids], [positions] = token_output.as_matrix([r.ids], 128), token_output.as_matrix([r.positions], 128)
        assert r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens <= 128 and r.n_segments == len(r.doc_ids) == len(r.cu_seqlens) - 1
        assert (ids[r.n_tokens :] == 9).all() and positions[r.n_tokens :].tolist() == list(range(128 - r.n_tokens))
        for a, b, doc, start in zip(r.cu_seqlens, r.cu_seqlens[1:], r.doc_ids, r.starts):
            assert positions[a:b].tolist() == list(range(b - a))
            found[doc].setdefault(start, []).append(ids[a:b].tolist())
    texts, copies = {r.doc_id: r.text for r in docs.collect()}, Counter(r.doc_id for r in docs.collect())
    for key, parts in found.items():
        assert all(len(p) == copies[key] and all(x == p[0] for x in p) for p in parts.values())
        assert sum((parts[s][0] for s in sorted(parts)), []) == own_ids(texts[key])
    assert set(found) == set(texts)
    assert token_output.packed_matrices(docs.limit(0)).count() == 0


# ---------------------------------------------------------------- pipeline
def test_pipeline_stages(spark, tmp_path):
    docs = documents(spark)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_jaccard_join", "suffix_array_dedup", "benchmark_decontamination", "packing"]
    texts, leaks = {r.doc_id: r.text for r in docs.collect()}, [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        stage(spark, docs, DATA).write.parquet(str(tmp_path / str(k)))
        after = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert after.columns == docs.columns and dict(after.dtypes) == dict(docs.dtypes)
        rows = {r.doc_id: r for r in after.collect()}
        if k == 0:
            assert set(rows) == {i for i, t in texts.items() if any(c.isalpha() for c in t)}
        if k == 1:
            want = plain_components([(i, r.text) for i, r in sorted(before.items())], 5, 80)
            assert set(rows) == {c for _, _, c in want}
        if k == 2:
            removed = {i: x[1] for i, x in zip(before, plain_removal([r.text.encode() for r in before.values()], corpus_pipeline.PASSAGE_BYTES))}
            assert all(rows[i].text == before[i].text for i in rows if not removed[i])
            assert all(rows[i].n_chars == len(rows[i].text) for i in rows if removed[i])
        if k == 3:
            assert set(before) - set(rows) == {d for d, *_ in plain_contained([(i, r.text) for i, r in before.items()], leaks)}
        docs = after
    assert set(rows) == set(before)
    whole = corpus_pipeline.run(spark, DATA)
    assert sorted((r.doc_id, r.start, r.ids_crc32) for r in whole.collect()) == sorted((r.doc_id, r.start, r.ids_crc32) for r in docs.collect())


def test_pipeline_cuts_passages_of_over_50_words(spark):
    """51 to 60 short words, 200 to 400 bytes, planted in two documents each."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghi") for _ in range(rng.randint(3, 6))) for _ in range(300)]

    def short(n):
        return " ".join(rng.choice(words) for _ in range(n))

    passages = [short(n) for n in range(51, 61)]
    assert all(200 <= len(p) < 400 for p in passages)
    rows = [(2 * k + j, f"{short(40 + k)} {p} {short(30 + j)}", "en", "a", 0) for k, p in enumerate(passages) for j in range(2)]
    rows += [(100 + k, short(90), "en", "a", 0) for k in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    removed = {r[0]: x for r, x in zip(rows, plain_removal([r[1].encode() for r in rows], corpus_pipeline.PASSAGE_BYTES))}
    left = {r.doc_id: r.text for r in corpus_pipeline.repeated_passages(spark, docs, DATA).collect()}
    assert {i: hashlib.sha256(t.encode()).hexdigest() for i, t in left.items()} == {i: x[3] for i, x in removed.items()}
    assert not any(p in t for p in passages for t in left.values())


def test_pipeline_edges(spark, tmp_path):
    rows = [(1, "the same words here and there " * 3, "en", "a", 5, 1.0), (1, "the same words here and there " * 3, "en", "a", 5, 1.0), (None, None, None, None, None, None),
            (2, "", "en", None, 0, 2.0), (None, "quite other words in this line", None, "b", 7, 3.0), (3, LONG, "en", "b", 8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double").withColumn("row", F.lit(1))
    # Names that stages use themselves, and a column without an order.
    docs = docs.withColumn("_row_id", F.lit(5)).withColumn("_kept", F.lit(None).cast("boolean")).withColumn("id", F.lit("x")).withColumn("key", F.create_map(F.lit("a"), F.col("doc_id")))
    for name, table in (("rows", docs), ("none", docs.limit(0))):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            path = str(tmp_path / f"{name}{k}")
            stage(spark, table, DATA).write.parquet(path)
            table = spark.read.parquet(path)
            assert k == 4 or table.columns == docs.columns
        assert {r.doc_id for r in table.collect()} == ({1, 3, None} if name == "rows" else set())
