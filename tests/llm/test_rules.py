"""Licence, repetition, language, quality and language-model operators against plain versions."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from chatterlake.llm import language_id, licenses, lm, quality, queries, repetition

LONG = "word " * 3 + "x" * 200_000 + " end"
TEXTS = [None, "", " \n\t", "!!!", LONG, "Über  straße\nÜber  straße", "a b c d e f a b c d e f", "a b c d e f a b c d e f", "l1 x\n\nl1 x\n l1 x", "中文 字 中文", "one\x0btwo\x1cthree four"]


def frame(spark, texts=TEXTS, first=0):
    """Rows with repeated and missing ids and a column whose name clashes with results."""
    rows = [(first + i, t, -1.0, "x") for i, t in enumerate(texts)]
    rows += [rows[-1], (None, "missing id of ten words a b c d e", 0.0, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, score double, labels string")


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def alnum(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


# ---------------------------------------------------------------- licences
LICENSED = [
    "Licensed under the Apache License, Version 2.0.", "licensed under CC-BY-NC 4.0", "ALL RIGHTS RESERVED all rights reserved",
    "Licensed under the terms of the GNU General Public License version 3", "Licensed to the GNU public", "copyright (c) 2020 A B all rights reserved",
    "Copyright 1 2 3 4 5 6 7 8 9 all rights reserved", "cc by cc by", "SPDX-License-Identifier: MIT", "the MIT license", "under the MIT license", "Licensed under the",
]


def plain_license(text):
    words = alnum(text)
    places = [(i, label) for phrase, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    line = "".join(f" {w}" for w in words)
    found = {label for label, markup in licenses.TEMPLATES.items() if re.search(queries._pattern(markup), line)}
    starts, own = [p[0] for p in places], {p[1] for p in places}
    return (len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(own)), ",".join(sorted(own | found)), 1.0 if found else 0.5 if own else 0.0)


def test_licenses(spark):
    texts = TEXTS + LICENSED
    got = {r["doc_id"]: r for r in licenses.license_scan(frame(spark, texts)).collect()}
    for i, text in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) == plain_license(text), text
    assert got[len(TEXTS)].spans == ["apache:0-5"] and got[len(TEXTS) + 5].labels == "copyright,reserved" and got[len(TEXTS) + 6].labels == "reserved"


BODIES = {
    "mit-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
        in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of
        the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission
        notice {} shall be included in all copies or substantial portions of the Software.""",
    "as-is,mit-warranty": """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
        FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.""",
    "gpl,gpl-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License {} as published by
        the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    "gpl,lgpl-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "bsd,bsd-2-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
        1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. * Redistributions in binary form must
        reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright
        notice and this permission notice appear in all copies.""",
    "mpl-header": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can
        obtain one at https://mozilla.org/MPL/2.0/.""",
    "apache,apache-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a
        copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is
        distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
        permissions and limitations under the License.""",
    "cc-by,cc-by-nc": "licensed under CC BY-NC",
    "gnu-gpl,gpl": "Licensed under the GNU General Public License",
}


def test_license_texts(spark):
    """Whole texts and headers are accepted with and without what may vary, and not with a mandatory word changed."""
    texts, wanted = [], []
    for labels, body in BODIES.items():
        for part in ("", "(including the next paragraph)" if "mit" in labels else "version 3"):
            texts.append("Preamble 2020. " + body.format(part) + " More text.")
            wanted.append(labels)
    broken = [body.format("").replace("copy", "c0py").replace("Free Software Foundation", "Foundation").replace("WARRANTY", "WARRANT").replace("Redistributions", "Reductions")
              for labels, body in BODIES.items() if labels not in ("cc-by,cc-by-nc", "gnu-gpl,gpl")]
    got = {r.doc_id: r for r in licenses.license_scan(frame(spark, texts + broken)).collect()}
    assert [got[i].labels for i in range(len(texts))] == wanted
    assert [got[len(texts) + i].labels for i in range(len(broken))] == ["", "as-is", "gpl", "gpl", "bsd", "", "", "apache"]
    for i, text in enumerate(texts + broken):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) == plain_license(text)


def test_automaton():
    a = licenses.Automaton("a <<optional>>b <<optional>>c<</optional>><</optional>> <<words x 0 2>> d")
    for text, good in (("a d", True), ("a b d", True), ("a b c d", True), ("a c d", True), ("a x y d", True), ("a b x y z d", False), ("a b c x y d", True), ("a", False)):
        words = [w.encode() for w in text.split()]
        assert (a.match(words, 0) == len(words)) == good, text
    with pytest.raises(ValueError):
        licenses.compile_templates({"x": "<<words a 1 2>> b"}, {})


# ---------------------------------------------------------------- repetition
def plain_repetition(text):
    words, lines = spaced(text), [x for x in (text or "").split("\n") if spaced(x)]
    chars = sum(map(len, words))

    def covered(n, least):
        seen, count, inside = set(), Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1)), set()
        for i in range(len(words) - n + 1):
            g = tuple(words[i : i + n])
            if (count[g] > 1 if least else g in seen):
                inside.update(range(i, i + n))
            seen.add(g)
        return inside

    again = [x for i, x in enumerate(lines) if x in lines[:i]]
    repeat = len(covered(5, True))
    failed = len(words) < 10 or 100 * repeat > 20 * len(words)
    kept = not failed and sum(map(len, again)) <= repetition.LINE_CHARS_SHARE * max(1, sum(map(len, lines)))
    for n, limit in repetition.GRAM_SHARES.items():
        kept = kept and sum(len(words[i]) for i in covered(n, False)) / max(chars, 1) <= limit
    return len(words), chars, len(re.findall(r"[#*$%&|<>]", text or "")), len(again), repeat, failed, kept


def test_repetition(spark):
    body = [f"w{i} z{i * 7}" for i in range(60)]
    texts = TEXTS + ["\n".join(body), "\n".join(body + body[:9]), "\n".join(body + body[:30]), " ".join(body) + "### $ <b>", "same line here\n" * 4 + " ".join(body)]
    got = {r["doc_id"]: r for r in repetition.repetition_rules(frame(spark, texts)).collect()}
    for i, text in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) == plain_repetition(text), text
    assert {r.kept for r in got.values()} == {True, False}


# ---------------------------------------------------------------- language
def test_language_held_out(spark):
    rows = queries.op4_language_id(spark, DATA).join(documents(spark), "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)


def plain_bits(text, counts):
    """Code length of a text under frozen counts {context: Counter}, escape by the number of different bytes."""
    data, total = text.lower().encode(), 0.0
    for i in range(len(data)):
        for order in range(language_id.ORDER, -1, -1):
            context = (b"\0" * language_id.ORDER + data[:i])[-order:] if order else b""
            seen = counts.get(context)
            if not seen:
                continue
            whole = sum(seen.values()) + len(seen)
            if data[i] in seen:
                total -= math.log2(seen[data[i]] / whole)
                break
            total -= math.log2(len(seen) / whole)
        else:
            total += 8
    return total


def test_language_code_lengths(spark):
    train = [("aa", "abab abba baab"), ("bb", "xyxy Éxyy"), ("aa", "ba ab"), (None, "zzz"), ("bb", None)]
    labelled = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(train)], "doc_id long, text string, lang string")
    model = language_id.fit(labelled)
    assert model.languages == ["aa", "bb"]
    counts = {"aa": {}, "bb": {}}
    for lang, text in train:
        for i, byte in enumerate((text or "").lower().encode() if lang else b""):
            for order in range(language_id.ORDER + 1):
                context = (b"\0" * language_id.ORDER + text.lower().encode()[:i])[-order:] if order else b""
                counts[lang].setdefault(context, Counter())[byte] += 1
    texts = TEXTS + ["ab ba", "XYZ éx", "q", "123"]
    got = {r["doc_id"]: r for r in language_id.predict_language(frame(spark, texts), model).collect()}
    for i, text in enumerate(texts):
        if not any(c.isalpha() for c in text or ""):
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
        elif len(text) < 1000:
            bits = {lang: plain_bits(text, counts[lang]) for lang in counts}
            assert got[i].lang_pred == min(sorted(bits), key=bits.get)
            assert got[i].bits == pytest.approx(min(bits.values()))


def test_language_without_labels(spark):
    model = language_id.fit(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert {r.lang_pred for r in language_id.predict_language(frame(spark), model).collect()} == {"und"}


# ---------------------------------------------------------------- quality
def test_quality_held_out(spark):
    larger = DATA.replace("sf0.001", "sf0.01")     # the smallest data have 19 held-out labels
    labels = spark.read.parquet(f"{larger}/labels.parquet")
    rows = queries.op8_quality(spark, larger).join(labels, "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_quality_votes():
    rng = np.random.default_rng(1)
    axes = np.eye(quality.TERMS, 4, dtype=np.float32)
    vectors = quality._unit(rng.random((60, 4)).astype(np.float32))
    vectors[40:] = vectors[:20]        # ties
    model = quality.Model(np.ones(quality.TERMS, np.float32), axes, vectors, (np.arange(60) % 3 > 0).astype(float), 0.5)
    counts = np.zeros((5, quality.TERMS), np.float32)
    counts[:4, :4] = rng.random((4, 4))
    scores = model.score(counts)
    for x, score in zip(counts[:4], scores):
        near = vectors @ (x[:4] / np.linalg.norm(x[:4]))
        votes = [(s, y) for s, y in zip(near, model.labels) if s >= sorted(near)[-quality.NEIGHBOURS]]
        assert score == pytest.approx(sum(s**4 * y for s, y in votes) / sum(s**4 for s, _ in votes), rel=1e-4)
    assert scores[4] == 0.5


def test_quality_edges(spark):
    labels = documents(spark).join(spark.read.parquet(f"{DATA}/labels.parquet").withColumnRenamed("quality", "label"), "doc_id")
    model = quality.fit(labels)
    rows = quality.score_quality(frame(spark), model).collect()
    assert len(rows) == len(TEXTS) + 2 and all(0 <= r.score <= 1 for r in rows)
    assert quality.fit(labels.limit(0)) is None
    assert {(r.score, r.predicted) for r in quality.score_quality(frame(spark), None).collect()} == {(0.0, 0)}


# ---------------------------------------------------------------- language model
def test_lm_base(spark):
    rows = {r.doc_id: r for r in queries.op7_lm_scoring(spark, DATA).collect()}
    texts = {r.doc_id: r.text for r in documents(spark).collect()}
    words = {i: [*(t or "").encode().lower().split(), None] for i, t in texts.items()}
    train = {i for i in words if zlib.crc32(str(i).encode()) % 5 != 1}
    counts = Counter(w for i in train for w in words[i])
    total, kinds = sum(counts.values()), len(counts)
    for i, own in words.items():
        r = rows[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(own), sum(w in counts for w in own), total, i not in train)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in own))
    held = [r for r in rows.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_lm_rare_words_are_joined(spark):
    docs = documents(spark)
    few = lm.score_texts(docs, lm.fit(docs, frequent_words=20)).collect()
    all_ = lm.score_texts(docs, lm.fit(docs)).collect()
    assert sorted((r.doc_id, r.n_known, round(r.base_score, 6)) for r in few) == sorted((r.doc_id, r.n_known, round(r.base_score, 6)) for r in all_)


def test_lm_edges(spark):
    model = lm.fit(frame(spark))
    rows = lm.score_texts(frame(spark), model).collect()
    assert len(rows) == len(TEXTS) + 2 and [r.n_tokens for r in rows if r.doc_id in (0, 1, 2)] == [1, 1, 1]
    assert lm.score_texts(frame(spark).limit(0), model).count() == 0
    empty = lm.fit(frame(spark).limit(0))
    assert {r.train_tokens for r in lm.score_texts(frame(spark), empty).collect()} == {0}


def test_filter_never_counts_too_few():
    rng = np.random.default_rng(5)
    keys = rng.integers(0, 2**63, 5000).astype(np.uint64)
    counts = rng.zipf(1.5, 5000).clip(1, 10**6)
    slices, bits = 4, 1 << 16
    where, data = lm._slice_of(keys, slices), []
    for k in range(slices):
        data.append(lm.build_slice(keys[where == k], lm.level_of(counts[where == k]), bits))
    found = lm.Filter(slices, bits, np.concatenate(data))
    levels = found.levels(keys)
    assert (levels >= lm.level_of(counts)).all() and (levels == lm.level_of(counts)).mean() > 0.9
    assert (found.levels(rng.integers(0, 2**63, 5000).astype(np.uint64)) == 0).mean() > 0.9
    assert lm.count_of(np.array([0, 1]))[:2].tolist() == [0.0, 1.0]


def test_filter_is_as_exact_for_many_blocks_as_for_few():
    """Bits follow the entries: absent keys are taken for present ones as often at every size."""
    rng = np.random.default_rng(6)
    rates = []
    for slices in (2, 64):
        keys = rng.integers(0, 2**63, 4000 * slices).astype(np.uint64)
        levels, where = lm.level_of(rng.zipf(1.8, len(keys)).clip(1, 10**6)), lm._slice_of(keys, slices)
        absent = rng.integers(0, 2**63, 20_000).astype(np.uint64)
        hits, absent_where = 0, lm._slice_of(absent, slices)
        for k in range(slices):
            own = levels[where == k]
            bits = lm.slice_bits(own)
            hits += (lm.Filter(1, bits, lm.build_slice(keys[where == k], own, bits)).levels(absent[absent_where == k]) > 0).sum()
        rates.append(hits / len(absent))
    assert max(rates) < 0.01 and abs(rates[0] - rates[1]) < 0.003


def plain_scores(texts):
    """Scores of the training texts themselves from exact levels, by one dictionary."""
    rows = [[w for w in re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())] + [None] for t in texts]
    words = Counter(w for r in rows for w in r)
    pairs = Counter(p for r in rows for p in zip([b" ", *r], r))
    whole = sum(words.values()) + 0.5 * (len(words) + 1)
    levels = {w: int(lm.level_of(np.array([c]))[0]) for w, c in [*words.items(), (b" ", len(rows))]}
    middle = lambda c: float(lm.count_of(lm.level_of(np.array([c])))[0])
    different, kinds = Counter(levels[v] for v, _ in pairs), Counter(levels[w] for w in words)
    out = []
    for r in rows:
        score = 0.0
        for v, w in zip([b" ", *r], r):
            weight, extra = middle(words[v] if v != b" " else len(rows)), max(different[levels[v]] / max(kinds[levels[v]], 1), 0.5)
            score += math.log10(min(1.0, (min(middle(pairs[v, w]), weight) + extra * (middle(words[w]) + 0.5) / whole) / (weight + extra)))
        out.append(score)
    return out


@pytest.mark.parametrize("tokens, block", [(1 << 20, lm.FILTER_BLOCK), (1 << 13, lm.FILTER_BLOCK), (1 << 13, 1 << 16)])
def test_lm_scores_like_exact_counts(spark, monkeypatch, tokens, block):
    """Few and many slices, chunks and passes give the scores of exact levels, up to rare false hits."""
    monkeypatch.setattr(lm, "TOKENS_PER_SLICE", tokens)
    monkeypatch.setattr(lm, "FILTER_BLOCK", block)
    docs = documents(spark).select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    model = lm.fit(docs)
    assert (model.slices > 8) == (tokens < 1 << 20) and (len(lm._blocks(model)) > 1) == (block == 1 << 16)
    want = dict(zip(texts, plain_scores(texts.values())))
    found = {r.doc_id: r.score for r in lm.score_texts(docs.union(docs.withColumn("doc_id", -F.col("doc_id") - 1)), model).collect()}
    assert len(found) == 2 * len(texts)
    assert all(found[-i - 1] == pytest.approx(found[i]) for i in want)
    off = np.abs([found[i] / want[i] - 1 for i in want])
    assert np.median(off) < 0.002 and np.quantile(off, 0.9) < 0.01 and off.max() < 0.15


@pytest.mark.parametrize("run", [licenses.license_scan, repetition.repetition_rules])
def test_empty_table(spark, run):
    assert run(frame(spark).limit(0)).count() == 0
