import math

import pytest
from conftest import column, rows
from pyspark.sql import functions as F

from chatterlake.operators import classify

TRAIN = [("en", "the cat and the hat"), ("en", "that thing"), ("fr", "le chat et la souris"), ("fr", "une chose")]
TEXTS = [(1, "the thing"), (2, "la chose"), (3, "abc"), (4, None), (5, "zzzzzz"), (6, "  ab  ")]


@pytest.fixture(scope="module")
def model(spark):
    fitted = classify.fit(spark.createDataFrame(TRAIN, "lang string, text string"), "text", "lang")
    yield fitted
    fitted.remove()


def expected(text):
    """Naive Bayes stated plainly."""
    def grams(t):
        return [t.lower()[i:i + 3] for i in range(len(t) - 2)]

    counts = {c: {} for c, _ in TRAIN}
    for c, t in TRAIN:
        for g in grams(t):
            counts[c][g] = counts[c].get(g, 0) + 1
    vocabulary = {g for c in counts.values() for g in c}
    scores = {
        c: math.log(0.5) + sum(math.log1p(counts[c].get(g, 0)) for g in grams(text))
        - len(grams(text)) * math.log(sum(counts[c].values()) + len(vocabulary))
        for c in counts
    }
    best = max(scores, key=lambda c: (scores[c], -ord(c[0])))
    return best, 1 / sum(math.exp(s - scores[best]) for s in scores.values())


@pytest.mark.parametrize("limit", [classify.BROADCAST_LIMIT, 0])
def test_language_scores(spark, model, limit):
    frame = spark.createDataFrame(TEXTS, "id int, text string")
    got = {r[0]: (r[1], r[2]) for r in rows(classify.score_languages(frame, "id", "text", model, limit))}
    assert len(got) == len(TEXTS)
    for key, text in TEXTS:
        if text is None or len(text.strip()) < 5:
            assert got[key] == ("und", 0.0)
        else:
            label, score = expected(text)
            assert got[key][0] == label and abs(got[key][1] - score) < 1e-9


@pytest.mark.parametrize("limit", [classify.BROADCAST_LIMIT, 0])
@pytest.mark.parametrize("kind", ["char_grams", "words"])
def test_chunks_change_nothing(spark, kind, limit):
    """Whatever the size of chunks, models and scores are those of whole texts."""
    texts = [t for _, t in TRAIN] + ["the \U0001F600cat\U0001F600 \U0001F600", "thethethethethe the", " a  b ", "", None, "LE Chat\nΣΑΣ Σ İx", "\U00010400\U00010401ab"]
    train = spark.createDataFrame(TRAIN, "lang string, text string")
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    def run(chunk):
        model = classify.fit(train, "text", "lang", kind, chunk=chunk)
        table = sorted(rows(model.table))
        sums = classify._feature_sums(frame, "id", F.col("text"), model, limit, chunk)
        got = sorted((r[0], r[1], *[round(v, 9) for v in r[2:]]) for r in rows(sums))
        model.remove()
        return table, got

    whole = run(classify.CHUNK)
    if kind == "char_grams":
        lengths = [len((t or "").lower()) for t in texts]
        assert [r[1] for r in whole[1]] == [max(n - 2, 0) for n in lengths]
    for chunk in (1, 2, 3, 7):
        assert run(chunk) == whole


def test_one_very_long_text(spark, model):
    """Millions of characters of mixed width are scored in lists of bounded length."""
    frame = spark.createDataFrame([(1, "the thing")], "id int, text string").select(
        "id", F.repeat(F.lit("the \U0001F600 thing"), 400_000).alias("text"))
    sums = classify._feature_sums(frame, "id", F.col("text"), model, classify.BROADCAST_LIMIT, classify.CHUNK)
    assert [r[1] for r in rows(sums)] == [400_000 * 11 - 2]


def test_model_join_is_broadcast_only_within_its_limit(spark, model, capsys):
    frame = spark.createDataFrame(TEXTS, "id int, text string")
    classify.score_languages(frame, "id", "text", model).explain()
    assert "BroadcastHashJoin" in capsys.readouterr().out
    classify.score_languages(frame, "id", "text", model, 0).explain()
    plan = capsys.readouterr().out
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_held_out_quality(spark, data):
    documents = spark.read.parquet(f"{data}/documents.parquet")
    fitted = classify.fit(documents.filter("doc_id % 2 = 0"), "text", "lang")
    rest = documents.filter("doc_id % 2 = 1")
    scored = classify.score_languages(rest, "doc_id", "text", fitted).join(rest, "doc_id")
    assert scored.filter(F.col("language") == F.col("lang")).count() >= 0.97 * scored.count()
    fitted.remove()


def test_sentiment_and_fallback(spark):
    train = spark.createDataFrame(
        [("POSITIVE", "good fine good"), ("NEGATIVE", "bad awful"), ("POSITIVE", "empty")], "label string, text string"
    )
    fitted = classify.fit(train, "text", "label", "words")
    frame = spark.createDataFrame([(1, "good"), (2, "awful bad"), (3, "  "), (4, None), (5, "!?")], "id int, text string")
    labels = dict(rows(classify.score_sentiment(frame, "id", "text", fitted).select("id", "sentiment_label")))
    assert labels == {1: "POSITIVE", 2: "NEGATIVE", 3: "POSITIVE", 4: "POSITIVE", 5: "POSITIVE"}
    fitted.remove()
    neutral = classify.with_neutral_sentiment(frame.select("id"))
    assert set(rows(neutral.select("sentiment_label", "sentiment_score"))) == {("NEUTRAL", 0.5)}
    partly = spark.createDataFrame([("POSITIVE", 0.9), (None, None)], "sentiment_label string, sentiment_score double")
    assert rows(classify.with_neutral_sentiment(partly)) == [("POSITIVE", 0.9), ("NEUTRAL", 0.5)]
    assert rows(classify.without_language_model(frame.select("id").limit(1))) == [(1, None, 0.0)]


def test_fit_needs_labels(spark):
    with pytest.raises(ValueError):
        classify.fit(spark.createDataFrame([(None, "x")], "label string, text string"), "text", "label")


def test_distinct_texts_and_join(spark):
    frame = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, "")], "id int, t string")
    distinct = classify.distinct_texts(frame, "t")
    assert sorted(column(distinct.select("t"))) == ["", "a"]
    scores = distinct.select("_text_key", F.length("t").alias("n"))
    assert sorted(rows(classify.join_text_scores(frame, "t", scores).select("id", "n"))) == [(1, 1), (2, 1), (3, 0), (4, 0)]


def test_hook(spark):
    frame = spark.createDataFrame([(2**60 + i, "boom" if i == 5 else "t" * i) for i in range(10)], "id bigint, text string").coalesce(1)

    def load():
        def model(texts):
            assert len(texts) <= 3
            if "boom" in texts:
                raise RuntimeError("broken batch")
            return [("L", float(len(t))) for t in texts]
        return model

    scored = rows(classify.score_with(frame, "text", load, batch_size=3, on_error="default").orderBy("id"))
    assert [r[2:] for r in scored] == [("NEUTRAL", 0.5) if 3 <= i < 6 else ("L", float(i)) for i in range(10)]
    assert scored[1][0] == 2**60 + 1
    with pytest.raises(Exception, match="broken batch"):
        classify.score_with(frame, "text", load, batch_size=3).collect()


def test_tasks_of_a_shuffled_model_follow_the_characters(spark, model, monkeypatch, capsys):
    """What a task counts by text is bounded, so a larger input has more tasks; counting by text moves nothing else."""
    frame = spark.createDataFrame([(i, "the thing " * 5) for i in range(40)], "id int, text string")
    monkeypatch.setattr(classify, "LETTERS_PER_TASK", 10)
    monkeypatch.setattr(classify, "LETTERS_PER_JOIN_TASK", 4)
    scored = classify.score_languages(frame, "id", "text", model, 0)
    scored.explain()
    plan = capsys.readouterr().out
    assert "REPARTITION_BY_NUM" in plan and ", 200), REPARTITION_BY_NUM" in plan
    assert plan.count("Exchange hashpartitioning(_key") == 2 and plan.count(", 500), REPARTITION_BY_NUM") == 2
    assert {r[1:] for r in rows(scored)} == {r[1:] for r in rows(classify.score_languages(frame, "id", "text", model))} and len(rows(scored)) == 40


@pytest.mark.parametrize("limit", [classify.BROADCAST_LIMIT, 0])
def test_no_list_of_all_grams(spark, model, limit, capsys):
    frame = spark.createDataFrame(TEXTS, "id int, text string")
    classify.score_languages(frame, "id", "text", model, limit).explain()
    plan = capsys.readouterr().out
    assert "concat(regexp_extract_all" not in plan and "sequence(" in plan


def test_grams_are_counted_before_they_become_rows(spark):
    """Fitting makes a row per 3-gram, class and batch, not one per place; the counts are those of a plain count."""
    texts = [("en", "aaaaaaaaaa" * 50), ("fr", "x\x00y\x00z \U0001F600\U0001F600\U0001F600"), (None, "new"), ("en", None), ("en", "ab"), ("fr", "aaaa")]
    frame = spark.createDataFrame(texts, "lang string, text string").coalesce(1)
    listed = classify._in_chunks(frame.select(F.col("lang").alias("_label"), F.col("text").alias("_text")), "char_grams", "_text", 100)
    want = {}
    for lang, text in texts:
        for i in range(len(text or "") - 2):
            row = want.setdefault(text[i:i + 3], {"en": 0, "fr": 0})
            if lang:
                row[lang] += 1
    made = rows(classify._gram_counts(listed, ["en", "fr"]))
    assert sum(r[2] for r in made) == sum(max(len(t or "") - 2, 0) for _, t in texts)
    assert len(made) == len({(r[0], r[1]) for r in made}) and len([r for r in made if r[1] == 0]) == 1
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    model = classify.fit(frame, "text", "lang")
    assert {r[0]: {"en": r[1], "fr": r[2]} for r in rows(model.table)} == want and model.rows == len(want)
    assert model.table.dtypes[1:] == [("n_0", "bigint"), ("n_1", "bigint")]
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before
    model.remove()
