import pytest
from conftest import column, rows
from pyspark.sql import functions as F

from chatterlake.operators import cleaning, labels, topics
from chatterlake.plans import jobs

KEYWORDS = ["subscribe", "free gift"]
CASES = [
    (None, None), ("", None), ("ab", None), ("  a  ", None), ("abc", "abc"), ("\u00a0ab\u2003", None),
    ("Great VIDEO", "great video"), ("  Padded  ", "  padded  "), ("Unsubscribed now", None), ("sooo", "sooo"),
    ("soooo", None), ("😂😂😂😂 ok", None), ("a    b", None), ("good Good", None), ("good goods", "good goods"),
    ("good, good", "good, good"), ("nice. nice.", None), ("it is so. It is so.", None), ("nice. nice", "nice. nice"),
    ("x1. y. z1. y. q", "x1. y. z1. y. q"), ("A. B. A. B.", None),
]


@pytest.fixture(scope="module")
def comments(spark):
    return spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "id int, comment string")


def test_cleaned_text(comments):
    got = cleaning.with_cleaned_text(comments, "comment", KEYWORDS).orderBy("id").select("cleaned_text")
    assert column(got) == [want for _, want in CASES]


def test_keep_clean_gives_the_same_rows(comments):
    kept = cleaning.keep_clean(comments, "comment", KEYWORDS)
    assert rows(kept.orderBy("id").select("id", "cleaned_text")) == [(i, w) for i, (_, w) in enumerate(CASES) if w]
    assert kept.columns == ["id", "comment", "cleaned_text"]


def test_reasons(comments):
    reasons = dict(rows(cleaning.with_spam_reason(comments, "comment", KEYWORDS).select("comment", "spam_reason")))
    assert reasons["ab"] == "too_short" and reasons["Unsubscribed now"] == "keyword"
    assert reasons["soooo"] == "repeated_letters" and reasons["good Good"] == "repeated_words"
    assert reasons["nice. nice."] in ("repeated_words", "repeated_sentences") and reasons["abc"] is None
    assert reasons["A. B. A. B."] == "repeated_sentences"


def test_removal_stats(spark, comments):
    assert rows(jobs.cleaned_removal_stats(comments, "comment", KEYWORDS)) == [(21, 8, 13, 61.9)]
    empty = comments.limit(0)
    assert rows(jobs.cleaned_removal_stats(empty)) == [(0, 0, 0, None)]


def test_keyword_table_equals_pattern(spark):
    texts = [(i, t) for i, t in enumerate(["the unSubscribed", "free  gift", "a free gift!", "zz", None, "xzzz"])]
    frame = spark.createDataFrame(texts, "id int, comment string")
    for keywords in (KEYWORDS, ["zz", "free gift"], ["z"]):
        table = spark.createDataFrame([(k,) for k in keywords], "keyword string")
        want = {i for i, t in texts if t and any(k in t.lower() for k in keywords)}
        assert set(column(cleaning.keyword_hits(frame, "id", "comment", table))) == want
    assert column(cleaning.keyword_hits(frame, "id", "comment", table.limit(0))) == []


def test_keyword_table_without_start_list(spark, monkeypatch):
    monkeypatch.setattr(cleaning, "MAX_STARTS", 0)
    frame = spark.createDataFrame([(1, "Unsubscribed"), (2, "subs")], "id int, comment string")
    table = spark.createDataFrame([("subscribe",), ("nothing",)], "keyword string")
    assert column(cleaning.keyword_hits(frame, "id", "comment", table)) == [1]


def test_keyword_windows_of_one_long_keyword(spark):
    """A keyword of 5,000 characters and a long text; short keywords beside it."""
    long_word = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(5000))
    words = [long_word, "qq", "z", "exactly16letters", "öäü"]
    table = spark.createDataFrame([(w,) for w in words], "keyword string")
    texts = {1: "the " * 50_000 + long_word + " the", 2: "the " * 50_000 + long_word[:-1], 3: "aQQ", 4: "Exactly16Letters!", 5: "ÖÄÜ", 6: "", 7: None, 8: "exactly16letter"}
    frame = spark.createDataFrame(list(texts.items()), "id int, comment string")
    for limit in (cleaning.MAX_STARTS, 2):
        cleaning.MAX_STARTS, old = limit, cleaning.MAX_STARTS
        try:
            small = frame if limit > 2 else frame.filter("id > 2")
            want = {i for i, t in texts.items() if t and any(w in t.lower() for w in words)} & {r.id for r in small.collect()}
            assert set(column(cleaning.keyword_hits(small, "id", "comment", table))) == want
        finally:
            cleaning.MAX_STARTS = old


def test_long_keyword_lists_take_the_join(spark, comments, monkeypatch):
    monkeypatch.setattr(jobs, "keyword_list", lambda keywords: None)
    table = spark.createDataFrame([(k,) for k in KEYWORDS], "keyword string")
    got = jobs.clean_with(comments, "comment", table).orderBy("id").select("cleaned_text")
    assert column(got) == [want for _, want in CASES]


def test_rules_run_once(comments, capsys):
    cleaning.keep_clean(comments, "comment", KEYWORDS).explain()
    plan = capsys.readouterr().out
    assert plan.count("EvalPython [") == plan.count("ArrowEvalPython [passages(") == 1 and plan.count("lower(") == 1


def test_topic_words(spark):
    texts = ["The beach, the BEACH & it's on!", "snake_case 2024 x", "हिन्दी", "ab", None]
    frame = spark.createDataFrame([(t,) for t in texts], "cleaned_text string")
    assert sorted(column(topics.topic_words(frame))) == ["2024", "beach", "beach", "snake_case"]
    assert rows(topics.top_words(frame, 2)) == [("beach", 2), ("2024", 1)]


def test_topics_by_language_keeps_top_languages(spark):
    data = [("en", "alpha beta beta")] * 5 + [("fr", "gamma")] * 3 + [("xx", "delta delta")] * 2 + [("de", "rare")] + [(None, "none")] * 9
    frame = spark.createDataFrame(data, "language string, cleaned_text string")
    got = rows(topics.topics_by_language(frame, 3, 1).orderBy("language"))
    assert got == [("en", "English", 1, "beta", 10), ("fr", "French", 1, "gamma", 3), ("xx", "xx", 1, "delta", 4)]
    weights = rows(topics.word_cloud(frame).filter("language = 'en'").select("topic", "weight").orderBy("topic"))
    assert weights == [("alpha", 0.5), ("beta", 1.0)]


def test_labels(spark):
    frame = spark.createDataFrame([(None,), ("Old San Juan!",), ("nice stripes",), ("nothing here",)], "comment string")
    labelled = labels.with_label(frame, "Tourism")
    assert column(labelled.select("Tourism_related")) == [0, 1, 1, 0]
    assert rows(labels.label_summary(labelled, "Tourism_related")) == [(4, 2, 2, 50.0, 50.0)]
    with pytest.raises(ValueError, match="tourism"):
        labels.with_label(frame, "sports")
    labels.register_label_type("Sports", ["Goal"])
    assert column(labels.with_label(frame.select(F.lit("GOAL").alias("comment")).limit(1), "sports").select("sports_related")) == [1]
