import pytest
from conftest import column, rows

from chatterlake.operators import coerce


def typed(spark, name, values, mode="compat"):
    frame = spark.createDataFrame([(v,) for v in values], f"`{name}` string")
    result = coerce.coerce_types(frame, mode)
    return column(result), result.dtypes[0][1]


@pytest.mark.parametrize("name, values, want, kind", [
    ("is_reply", ["True", "yes", "0", "maybe", None], [True, True, False, None, None], "boolean"),
    ("like_count", ["5", "abc", None], [5, 0, 0], "bigint"),
    ("like_count", ["5", "1.5", "abc"], [5.0, 1.5, None], "double"),
    ("like_count", ["9007199254740993", " 7 ", "1e3", "5.0", "1d"], [9007199254740993, 7, 1000, 5, 0], "bigint"),
    ("video_id", ["abc", "12"], [0, 12], "bigint"),
    ("timestamp", ["1700000000", "2024-01-01", None, "1.5"], [1700000000.0, 0.0, 0.0, 1.5], "double"),
    ("country", ["US"], [0], "bigint"),
    ("this_count", ["1", "7", "x"], [True, None, None], "boolean"),
    ("name", ["1"], ["1"], "string"),
])
def test_compat(spark, name, values, want, kind):
    assert typed(spark, name, values) == (want, kind)


def test_safe_keeps_what_would_be_lost(spark):
    assert typed(spark, "video_id", ["abc", "12"], "safe") == (["abc", "12"], "string")
    assert typed(spark, "country", ["US"], "safe") == (["US"], "string")
    assert typed(spark, "like_count", ["5", None], "safe") == ([5, 0], "bigint")
    frame = spark.createDataFrame([("abc", "1")], "video_id string, like_count string")
    assert coerce.lossy_columns(coerce.profile_strings(frame)) == ["video_id"]


def test_only_strings_are_touched(spark):
    frame = spark.createDataFrame([(1, 2.5)], "like_count int, timestamp double")
    assert coerce.coerce_types(frame).dtypes == frame.dtypes


def test_reader_types_come_first(spark):
    data = [("1", "1", "1", "True", None, "2.5"), ("0", None, "x", "False", None, "1")]
    frame = spark.createDataFrame(data, "is_spam string, like_count string, view_count string, is_reply string, empty string, price string")
    plan = coerce.plan_csv_types(frame)
    assert dict(coerce.apply_plan(frame, plan).dtypes) == {
        "is_spam": "bigint", "like_count": "double", "view_count": "bigint", "is_reply": "boolean",
        "empty": "double", "price": "double",
    }
    assert rows(coerce.apply_plan(frame, plan))[1] == (0, None, 0, False, None, 1.0)


def test_rules_and_names(spark):
    assert [coerce.rule_for(n) for n in ("Is_X", "created_epoch", "COUNTRY", "analysis_id", "text")] == [
        "boolean", "epoch", "count", "boolean", None,
    ]
    frame = spark.createDataFrame([("x", "1")], "`odd.name` string, `a_count` string")
    assert coerce.coerce_types(frame).columns == ["odd.name", "a_count"]
    with pytest.raises(ValueError, match="Available columns: odd.name, a_count"):
        coerce.rename_text_column(frame, "text")
    with pytest.raises(ValueError):
        coerce.plan_coercion({}, "other")
