import pytest
from conftest import column, rows
from pyspark.sql import functions as F

from chatterlake.operators import language, stats, validate, yearly


def test_languages(spark):
    assert language.parse_targets(" EN, fr ") == ["en", "fr"] and language.parse_targets(None) == []
    assert column(language.unsupported_targets(spark, "en,xx")) == ["xx"]
    assert language.supported_languages(spark).count() == 20
    data = [("en", 0.8), ("en", 0.79), ("fr", 0.9), (None, 1.0)]
    frame = spark.createDataFrame(data, "language string, language_confidence double")
    assert rows(language.keep_languages(frame, "en")) == [("en", 0.8)]
    assert sorted(rows(language.keep_languages(frame)), key=str) == [("en", 0.8), ("fr", 0.9), (None, 1.0)]


def test_distribution(spark):
    frame = spark.createDataFrame([("a",)] * 2 + [("b",)] + [("xx",)] * 3, "language string")
    assert rows(stats.distribution(frame, "language")) == [("xx", 3, 50.0), ("a", 2, 33.3), ("b", 1, 16.7)]
    assert rows(stats.language_distribution(frame))[0] == ("xx", "xx", 3, 50.0)
    assert rows(stats.distribution(frame.limit(0), "language")) == []


def test_english_sentiment(spark):
    data = [("en", "POSITIVE"), ("en", "NEGATIVE"), ("en", "POSITIVE"), ("en", None), ("fr", "POSITIVE")]
    frame = spark.createDataFrame(data, "language string, sentiment string")
    assert rows(stats.english_sentiment_distribution(frame)) == [("POSITIVE", 2, 66.7), ("NEGATIVE", 1, 33.3)]


def test_daily_counts_fill_gaps(spark):
    days = ["2024-01-01 10:00:00", "2024-01-01 12:00:00", "2024-01-04 00:00:00", "bad", None]
    frame = stats.parse_timestamp(spark.createDataFrame([(d,) for d in days], "timestamp string"), bad_col="bad")
    assert sum(column(frame.select(F.col("bad").cast("int")))) == 1
    got = rows(stats.daily_counts(frame).orderBy("day").select(F.col("day").cast("string"), "count"))
    assert got == [("2024-01-01", 2), ("2024-01-02", 0), ("2024-01-03", 0), ("2024-01-04", 1)]
    assert stats.daily_counts(frame.limit(0)).count() == 0


def test_distinct_counts_missing(spark):
    frame = spark.createDataFrame([("a",), (None,), (None,)], "language string")
    assert column(stats.distinct_values(frame, "language")) == [2]


def test_union_by_name(spark):
    both = stats.union_parts(spark.createDataFrame([(1, "a")], "x int, y string"), spark.createDataFrame([(2,)], "x int"))
    assert sorted(rows(both)) == [(1, "a"), (2, None)]


@pytest.mark.parametrize("n", [0, 1, 37, 999, 1000, 5000])
def test_large_samples_equal_small_ones(spark, n):
    frame = spark.range(1000)
    small = stats.sample_exact(frame, n, "id")
    large = stats.sample_exact(frame, n, "id", direct_rows=0)
    assert sorted(column(small)) == sorted(column(large))
    assert small.count() == (min(n, 1000) or 1000)


def test_sample_with_many_copies(spark, monkeypatch):
    """A group of equal rows larger than the direct limit is cut exactly."""
    monkeypatch.setattr(stats, "_COPIES_PER_TASK", 70)
    frame = spark.range(1200).select(F.when(F.col("id") < 900, 0).otherwise(F.col("id")).alias("v"))
    for n in (10, 400, 901, 1100):
        picked = column(stats.sample_exact(frame, n, direct_rows=5))
        assert sorted(picked) == sorted(column(stats.sample_exact(frame, n))) and len(picked) == n


def test_sample_keeps_rows_without_a_key(spark):
    frame = spark.range(100).select("id", F.when(F.col("id") >= 60, F.col("id")).alias("v"))
    for n in (30, 99, 100):
        picked = column(stats.sample_exact(frame, n, "v", direct_rows=5).select("id"))
        assert len(picked) == len(set(picked)) == n


def test_sample_with_a_key_shared_by_many_rows(spark):
    frame = spark.range(600).select("id", F.when(F.col("id") < 500, 0).otherwise(F.col("id")).alias("v"))
    for n in (50, 450, 590):
        picked = column(stats.sample_exact(frame, n, "v", direct_rows=5).select("id"))
        assert len(picked) == len(set(picked)) == n


def test_years(spark):
    frame = spark.createDataFrame([("2020-05-01",), ("01/02/2021",), ("no",)], "d string")
    assert column(yearly.with_year(frame, "d").select("year")) == [2020, None, None]
    assert column(yearly.with_year(frame, "d", "%d/%m/%Y").select("year")) == [None, 2021, None]
    assert yearly.spark_date_format("%Y-%m-%dT%H") == "yyyy-MM-dd'T'HH"
    with pytest.raises(ValueError):
        yearly.spark_date_format("%Q")


def test_write_by_year_prunes(spark, tmp_path, capsys):
    frame = spark.createDataFrame([("2020-05-01", 1), ("2021-05-01", 0), ("x", 1)], "d string, tourism_related int")
    path = yearly.write_by_year(frame, "d", str(tmp_path / "years"))
    table = spark.read.parquet(path)
    assert sorted(rows(yearly.yearly_trends(table)), key=str) == [(2020, 1, 1, 100.0), (2021, 1, 0, 0.0), (None, 1, 1, 100.0)]
    table.filter("year = 2020").explain()
    assert "PartitionFilters: [isnotnull(year" in capsys.readouterr().out


def test_compare_tables(spark):
    left = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (3, "c")], "x int, y string")
    right = spark.createDataFrame([(1, "a"), (2, None), (4, "d")], "x int, y string")
    assert rows(validate.compare_tables(left, right)) == [(4, 3, 2, 1, "", "", False)]
    assert rows(validate.compare_tables(left, left)) == [(4, 4, 0, 0, "", "", True)]
    differences = validate.table_differences(left, right)
    assert sorted(rows(differences)) == [("left", 1, 1, "a"), ("left", 1, 3, "c"), ("right", 1, 4, "d")]
    assert len(rows(validate.sample_differences(differences, 2))) == 2
    extra = right.withColumn("z", F.lit(1))
    assert rows(validate.compare_tables(right, extra))[0][5:] == ("z", False)
    assert rows(validate.compare_tables(left.limit(0), right.limit(0)))[0][:4] == (0, 0, 0, 0)


def test_profile(spark):
    frame = spark.createDataFrame([(1, "b", [1]), (2, None, None)], "x int, y string, z array<int>")
    got = rows(validate.profile_table(frame))
    assert got == [("x", 2, 0, "1", "2", 2), ("y", 2, 1, "b", "b", 1), ("z", 2, 1, None, None, None), ("z[]", 1, 0, "1", "1", None)]
    assert rows(validate.table_schema(frame))[2][:3] == (2, "z", "array<int>")
    assert validate.sample_rows(frame, 1).count() == 1


def test_sample_ties_do_not_depend_on_partitions(spark):
    frame = spark.range(3000).selectExpr("id", "id % 2 AS shared")
    chosen = {
        tuple(sorted(r.id for r in stats.sample_exact(frame.repartition(parts), 700, "shared", direct_rows=direct).collect()))
        for parts in (1, 3, 7) for direct in (10_000, 50)
    }
    assert len(chosen) == 1 and len(chosen.pop()) == 700


def test_epoch_timestamps(spark):
    frame = spark.createDataFrame([("1704067200",), ("1704067200.5",), ("2024-01-01 00:00:00",), ("2024",), ("?",), (None,)], "timestamp string")
    days = [r[0] for r in stats.parse_timestamp(frame).selectExpr("CAST(to_date(timestamp) AS string)").collect()]
    assert days == ["2024-01-01"] * 4 + [None, None]
    milli = spark.createDataFrame([(1704067200000,)], "timestamp long")
    assert stats.parse_timestamp(milli, epoch_unit="milliseconds").selectExpr("CAST(to_date(timestamp) AS string)").first()[0] == "2024-01-01"
