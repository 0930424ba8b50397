"""Text rules against plain-Python statements of them on random Unicode strings."""

import random
import re

import pytest
from conftest import column
from pyspark.sql import functions as F

from chatterlake.functions import spam, text
from chatterlake.functions.fixed_values import STOP_WORDS, TOURISM_PHRASES

ALPHABETS = ["ab. \n", "aàé́ि 1_", "x.  \x1c\x85\r\n\t ", "😂🙂 a.", "go od.,! ", "İΣσς ß"]


@pytest.fixture(scope="module")
def strings(spark):
    rng = random.Random(7)
    values = [
        "".join(rng.choice(rng.choice(ALPHABETS) if rng.random() < 0.1 else alphabet) for _ in range(rng.randint(0, 16)))
        for alphabet in ALPHABETS for _ in range(1500)
    ]
    return spark.createDataFrame([(v,) for v in values], "t string").repartition(4).cache()


def check(frame, column_expr, expected, at_least=1):
    got = frame.select("t", column_expr.alias("x")).collect()
    wrong = [(r.t, r.x, expected(r.t)) for r in got if r.x != expected(r.t)]
    assert not wrong, wrong[:5]
    assert sum(bool(r.x) for r in got) >= at_least


def test_strip_and_gates(strings):
    check(strings, text.strip("t"), str.strip)
    check(strings, text.is_valid_text("t"), lambda t: len(t.strip()) >= 3)
    check(strings, text.is_language_text("t"), lambda t: len(t.strip()) >= 5)
    check(strings, text.fill_blank("t"), lambda t: t if t.strip() else "empty")
    check(strings, text.stripped_length("t"), lambda t: len(t.strip()))


def test_repeated_letters(strings):
    check(strings, spam.repeated_letters(F.col("t")), lambda t: bool(re.search(r"(.)\1{3}", t)))


def test_repeated_words(strings):
    check(strings, spam.repeated_words(F.col("t")), lambda t: bool(re.search(r"\b(\w+)\s+\1\b", t)))


def test_repeated_sentences(strings):
    check(strings, spam.repeated_sentences(F.col("t")), lambda t: bool(re.search(r"(.+?)\.\s+\1\.", t)), 50)


def test_words(strings):
    def tokens(t):
        return re.sub(r"[^\w\s]", " ", t.lower()).split()

    check(strings, text.words("t"), tokens)
    check(strings, text.words("t", 3), lambda t: [w for w in tokens(t) if len(w) > 2])


def test_char_grams(strings):
    check(
        strings, F.sort_array(text.char_grams("t", 3)),
        lambda t: sorted((t.lower()[i:i + 3] for i in range(len(t.lower()) - 2)), key=lambda g: g.encode()),
    )


def test_truncate(strings):
    check(strings, text.truncate_text("t", 5), lambda t: t[:5] + "..." if len(t) > 5 else t)


def test_keywords(strings):
    keywords = ["a.", "go", "good", "1_", "😂a", "^-]", "x\\", "od,"]
    check(strings, spam.contains_any(F.col("t"), keywords), lambda t: any(k in t for k in keywords))


def test_many_keywords(spark):
    rng = random.Random(3)
    keywords = ["".join(rng.choice("abcde-[]^. ") for _ in range(rng.randint(3, 7))) for _ in range(3000)]
    texts = ["".join(rng.choice("abcdefgh-[]^. ") for _ in range(12)) for _ in range(2000)]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    check(frame, spam.contains_any(F.col("t"), keywords), lambda t: any(k in t for k in keywords))


def test_needed_keywords():
    assert spam.needed_keywords(["Visit", "visit us", "trip", ""]) == ["trip", "visit"]
    assert len(TOURISM_PHRASES) == 26 and len(STOP_WORDS) == 41


def test_percent(spark):
    frame = spark.createDataFrame([(1, 3), (0, 0)], "a int, b int")
    assert column(frame.select(text.percent("a", "b", 2))) == [33.33, None]


def test_long_texts_stay_linear(spark):
    """Inner runs of whitespace, long lines and very long words."""
    texts = ["a" + " " * 200_000 + "b", "ab" * 200_000, "word " * 50_000, "a. b, " * 20_000]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    got = frame.select(text.stripped_length("t"), spam.repeated_letters(F.col("t")), spam.repeated_words(F.col("t"))).collect()
    spaced = spark.createDataFrame([("x." + " " * 200_000 + "b. " + "c" * 100_000,), ("a b \t" * 50_000 + ".",)], "t string")
    assert column(spaced.select(spam.repeated_sentences(F.col("t")))) == [False, False]
    assert [tuple(r) for r in got] == [
        (200_002, True, False), (400_000, False, False), (249_999, False, True), (119_999, False, False),
    ]
