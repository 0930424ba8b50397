import json
import os

import pytest
from conftest import column, rows
from pyspark.sql import functions as F

from chatterlake.operators import classify
from chatterlake.operators.validate import fingerprints
from chatterlake.plans import jobs
from chatterlake.sources import csv
from chatterlake.streaming.comments import prepare_stream, write_stream

COMMENTS = """text,timestamp,n
the beach was lovely today,2024-01-01 10:00:00,1
The Beach was lovely today,2024-01-01 11:00:00,2
la plage est jolie aujourd'hui,2024-01-03 09:00:00,3
good good,2024-01-04 09:00:00,4
Subscribe now,2024-01-04 09:00:00,5
,2024-01-04 09:00:00,6
"""


@pytest.fixture(scope="module")
def models(spark):
    languages = classify.fit(spark.createDataFrame(
        [("en", "the beach was lovely and the day was good"), ("fr", "la plage est jolie et le jour est bon")],
        "lang string, text string"), "text", "lang")
    moods = classify.fit(spark.createDataFrame(
        [("POSITIVE", "lovely good"), ("NEGATIVE", "awful bad")], "label string, text string"), "text", "label", "words")
    yield languages, moods
    languages.remove()
    moods.remove()


@pytest.fixture
def inputs(tmp_path):
    (tmp_path / "comments.csv").write_text(COMMENTS)
    (tmp_path / "spam.txt").write_text("SUBSCRIBE\n")
    return str(tmp_path / "comments.csv"), str(tmp_path / "spam.txt"), str(tmp_path)


def test_analyze_comments(spark, inputs, models):
    source, keywords, folder = inputs
    output = f"{folder}/out.csv"
    reports = jobs.analyze_comments(spark, source, output, "text", keywords, None, 0.5, *models, charts=True)
    table = csv.read_csv(spark, output)
    got = rows(table.select("n", "cleaned_text", "language", "sentiment").orderBy("n"))
    assert got == [
        ("1", "the beach was lovely today", "en", "POSITIVE"), ("2", "the beach was lovely today", "en", "POSITIVE"),
        ("3", "la plage est jolie aujourd'hui", "fr", None),
    ]
    assert rows(reports["removal_stats"]) == [(6, 3, 3, 50.0)]
    assert rows(reports["language_distribution"]) == [("en", "English", 2, 66.7), ("fr", "French", 1, 33.3)]
    part = [f for f in os.listdir(f"{folder}/out_metadata.json") if f.endswith(".json")]
    document = json.loads(open(f"{folder}/out_metadata.json/{part[0]}").read())
    assert document["languages"]["en"]["name"] == "English"
    assert document["languages"]["en"]["topics"][0] == {"topic": "beach", "count": 2}
    days = spark.read.parquet(f"{folder}/out_charts/daily_counts").orderBy("day")
    assert column(days.select("count")) == [2, 0, 1]
    assert set(os.listdir(f"{folder}/out_charts")) == {
        "daily_counts", "language_distribution", "sentiment_distribution", "topics", "word_cloud",
    }


def test_analyze_without_models(spark, inputs):
    source, keywords, folder = inputs
    output = f"{folder}/plain.csv"
    reports = jobs.analyze_comments(spark, source, output, "text", None)
    table = csv.read_csv(spark, output)
    assert table.columns == ["comment", "timestamp", "n", "cleaned_text"] and table.count() == 4
    assert "language_distribution" not in reports and reports["topics"].columns == ["rank", "topic", "count"]
    part = [f for f in os.listdir(f"{folder}/plain_metadata.json") if f.endswith(".json")]
    assert "topics" in json.loads(open(f"{folder}/plain_metadata.json/{part[0]}").read())
    with pytest.raises(ValueError, match="has no column"):
        jobs.analyze_comments(spark, source, output, "absent", None)


def test_own_models(spark, inputs):
    """Loaders take the place of fitted models."""
    source, keywords, folder = inputs
    language = lambda: lambda texts: [("fr" if "plage" in t else "en", 0.9) for t in texts]

    def mood():
        def score(texts):
            raise RuntimeError("always fails")
        return score

    output = f"{folder}/own.csv"
    jobs.analyze_comments(spark, source, output, "text", keywords, "en", 0.8, language, mood)
    got = rows(csv.read_csv(spark, output).select("n", "language", "language_confidence", "sentiment", "sentiment_score").orderBy("n"))
    assert got == [("1", "en", "0.9", "NEUTRAL", "0.5"), ("2", "en", "0.9", "NEUTRAL", "0.5")]


def test_analyze_empty_input(spark, tmp_path):
    (tmp_path / "empty.csv").write_text("comment\n")
    reports = jobs.analyze_comments(spark, str(tmp_path / "empty.csv"), str(tmp_path / "out.csv"))
    assert rows(reports["removal_stats"]) == [(0, 0, 0, None)]


def test_filter_comments(spark, inputs, models):
    source, keywords, folder = inputs
    output = jobs.filter_comments(spark, source, f"{folder}/filtered.csv", "text", keywords, models[0], 0.5)
    assert sorted(column(csv.read_csv(spark, output).select("n"))) == ["1", "2"]


def test_label_comments(spark, tmp_path):
    (tmp_path / "c.csv").write_text("comment,id\nOld San Juan!,1\nnothing,2\n,3\nnothing,2\n")
    assert rows(jobs.label_comments(spark, str(tmp_path / "c.csv"))) == [(4, 1, 3, 25.0, 75.0)]
    assert csv.read_csv(spark, str(tmp_path / "labeled_c.csv")).count() == 4
    summary = jobs.label_comments(spark, str(tmp_path / "c.csv"), str(tmp_path / "o"), sample=3)
    assert summary.first()["total"] == 3


def test_analyze_sentiment(spark, tmp_path, models):
    (tmp_path / "c.csv").write_text("comment,id\ngood,1\nbad awful,2\n,3\n" + "x" * 500 + " bad,4\n")
    got = jobs.analyze_sentiment(spark, str(tmp_path / "c.csv"), model=models[1])
    assert sorted(rows(got)) == [("NEGATIVE", 3, 75.0), ("POSITIVE", 1, 25.0)]
    written = csv.read_csv(spark, str(tmp_path / "c_with_sentiment.csv"))
    assert dict(rows(written.select("id", "sentiment_label")))["1"] == "POSITIVE" and written.count() == 4


def test_analyze_sentiment_without_model(spark, tmp_path):
    (tmp_path / "c.csv").write_text("comment\ngood\nbad\n")
    assert rows(jobs.analyze_sentiment(spark, str(tmp_path / "c.csv"))) == [("NEUTRAL", 2, 100.0)]


def test_convert_tree_and_compare(spark, tmp_path):
    source, target = tmp_path / "in", tmp_path / "out"
    (source / "sub").mkdir(parents=True)
    (source / "a.csv").write_text("comment,like_count,is_reply\nx,5,True\ny,abc,no\n")
    (source / "sub" / "b.CSV").write_text("id,when\n1,2024\n2,2025\n")
    (source / "empty.csv").write_text("comment\n")
    (source / "sub" / "nothing.csv").write_text("")
    report = jobs.convert_tree(spark, str(source), str(target))
    assert sorted(rows(report.select("file", "converted"))) == [
        ("a.csv", True), ("empty.csv", False), ("sub/b.CSV", True), ("sub/nothing.csv", False)]
    assert rows(jobs.conversion_summary(report)) == [(2, 2)]
    typed = spark.read.parquet(str(target / "a.parquet"))
    assert typed.dtypes == [("comment", "string"), ("like_count", "bigint"), ("is_reply", "boolean")]
    assert sorted(rows(typed)) == [("x", 5, True), ("y", 0, False)]
    again = jobs.convert_tree(spark, str(source), str(target))
    assert rows(jobs.conversion_summary(again)) == [(0, 4)]
    assert rows(jobs.conversion_summary(jobs.convert_tree(spark, str(source), str(target), overwrite=True))) == [(2, 2)]
    sizes = jobs.size_report(spark, str(source), str(target)).first()
    assert sizes["bytes_before"] == sum(os.path.getsize(p) for p in (source / "a.csv", source / "sub" / "b.CSV", source / "empty.csv"))
    assert sizes["saved_percent"] == round((1 - sizes["bytes_after"] / sizes["bytes_before"]) * 100, 1)

    (source / "new.csv").write_text("a\n1\n")
    (source / "a.csv").write_text("comment,like_count,is_reply\nx,5,True\nz,7,no\n")
    compared = jobs.compare_folders(spark, str(source), str(target), str(tmp_path / "report"), samples=3)
    assert sorted(rows(compared.select("file", "equal"))) == [
        ("a", False), ("empty", True), ("new", False), ("sub/b", True), ("sub/nothing", False)]
    differing = compared.filter("file = 'a'").first()["differing"]
    assert [json.loads(x)["comment"] for x in differing] == ["y", "z"]
    assert spark.read.json(str(tmp_path / "report")).count() == 5


def test_trees_are_converted_in_few_jobs(spark, tmp_path):
    """Files alike in header and types go together, whatever their names; bad ones are named and stop no other."""
    def jobs_of(files, name):
        root = tmp_path / name
        (root / "a b").mkdir(parents=True)
        for k in range(files):
            (root / "a b" / f"f{k} [{k}] 100%.csv").write_text(f'x,like_count\n"l{k}\nm",{k}\n' if k % 2 else f"x,like_count\nt{k},{k}.5\nu,2\n")
        (root / "open.csv").write_text('x,like_count\n"a,1\n')
        spark.sparkContext.setJobGroup(name, name)
        report = jobs.convert_tree(spark, str(root), str(tmp_path / f"{name}-out"))
        found = {r.file: (r.converted, r.message) for r in report.collect()}
        assert found.pop("open.csv") == (False, "the file ends inside quotes")
        assert len(found) == files and set(found.values()) == {(True, None)}
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))

    few, many = jobs_of(4, "few"), jobs_of(24, "many")
    assert many <= few + 4
    odd = spark.read.parquet(str(tmp_path / "many-out" / "a b" / "f7 \\[7\\] 100%.parquet"))
    even = spark.read.parquet(str(tmp_path / "many-out" / "a b" / "f6 \\[6\\] 100%.parquet"))
    assert rows(odd) == [("l7\nm", 7)] and odd.dtypes[1] == ("like_count", "bigint")
    assert sorted(rows(even)) == [("t6", 6.5), ("u", 2.0)]


def test_equal_trees_are_compared_in_few_jobs(spark, tmp_path):
    """Only pairs that differ cost jobs of their own."""
    def jobs_of(files, name):
        root, target = tmp_path / name, tmp_path / f"{name}-out"
        (root / "a b").mkdir(parents=True)
        for k in range(files):
            (root / "a b" / f"f{k} [{k}] 100%.csv").write_text(f"x,like_count,none\nt{k},{k},\nu,2,\n" if k % 2 else f'x,like_count,none\n"l{k}\nm",{k},1\n')
        jobs.convert_tree(spark, str(root), str(target))
        spark.sparkContext.setJobGroup(name, name)
        got = jobs.compare_folders(spark, str(root), str(target), samples=2).collect()
        assert len(got) == files
        for r in got:
            n = 1 + int(r.file.split(" ")[1][3:]) % 2
            assert r[1:] == (n, n, 0, 0, "", "", True, [], None), r
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))

    few, many = jobs_of(4, "same-few"), jobs_of(24, "same-many")
    assert many <= few + 12  # a footer for each table with a column that has no value


def test_differing_trees(spark, tmp_path):
    """Pairs that the fingerprints do not settle give what comparing them one by one gives."""
    root, target = tmp_path / "left", tmp_path / "right"
    root.mkdir()
    lines = {
        "same": "x,y\na,1\nb,2\n", "copies": "x,y\na,1\na,1\nb,2\n", "nulls": "x,y\n,1\nb,2\n", "more": "x,y\na,1\n",
        "fewer": "x,y\na,1\n", "other": "x,y\na,1\n", "empty": "x,y\n", "broken": "x,y\na,1\n", "plain": "x,y\na,1\n",
    }
    for name, text in lines.items():
        (root / f"{name}.csv").write_text(text)
    def put(name, rows, schema):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(target / f"{name}.parquet"))

    put("same", [("b", 2), ("a", 1)], "x string, y bigint")
    put("copies", [("a", 1), ("b", 2), ("b", 2)], "x string, y bigint")
    put("nulls", [("1", None), ("b", 2)], "x string, y bigint")
    put("more", [("a", 1, "z")], "x string, y bigint, z string")
    put("fewer", [("a",)], "x string")
    put("other", [("a", "1")], "x string, y string")
    put("empty", [], "x string, y bigint")
    put("plain", [("a", 1)], "x string, y bigint")
    (target / "broken.parquet").write_text("no table")
    got = {r.file: tuple(r)[1:8] for r in jobs.compare_folders(spark, str(root), str(target)).collect()}
    assert got.pop("broken") == (*[None] * 6, False)
    assert got == {
        "same": (2, 2, 0, 0, "", "", True), "copies": (3, 3, 1, 1, "", "", False), "nulls": (2, 2, 1, 1, "", "", False),
        "more": (1, 1, 0, 0, "", "z", False), "fewer": (1, 1, 0, 0, "y", "", False), "other": (1, 1, 0, 0, "", "", True),
        "empty": (0, 0, 0, 0, "", "", True), "plain": (1, 1, 0, 0, "", "", True),
    }


def test_fingerprints(spark):
    """They follow what grouping takes as equal: 0.0 and -0.0, but not a NULL in another column."""
    table = spark.createDataFrame(
        [("a", 0.0, None, 1), ("b", -0.0, None, 1), ("c", 0.0, 1, None), ("d", 0.0, None, 1), ("d", 0.0, None, 1)], "k string, x double, y int, z int")
    got = {r["_key"]: tuple(r)[1:] for r in fingerprints(table, "k", ["x", "y", "z"]).collect()}
    assert got["a"] == got["b"] != got["c"] and got["a"] != got["d"] and got["d"][0] == 2
    with pytest.raises(ValueError):
        fingerprints(spark.createDataFrame([("a", [1])], "k string, x array<int>"), "k", ["x"])


def test_relative_paths(spark, tmp_path):
    inner = tmp_path / "data" / "a" / "x.csv"
    inner.mkdir(parents=True)
    (inner / "part-0.csv").write_text("a\n1\n")
    root = str(tmp_path / "data" / "a")
    for spelling in (root, root + "/", "file:" + root, "file://" + root):
        assert rows(jobs.convert_tree(spark, spelling, str(tmp_path / "out"), overwrite=True).select("file")) == [("x.csv/part-0.csv",)]
    assert rows(jobs.compare_folders(spark, root, str(tmp_path / "out")).select("file", "equal")) == [("x.csv/part-0", True)]


def test_json_to_csv(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"comments": [{"a": 1}, {"b": "x"}]}))
    assert rows(jobs.json_to_csv(spark, str(tmp_path / "c.json"))) == [(2, 2)]
    assert sorted(rows(csv.read_csv(spark, str(tmp_path / "c.csv"))), key=str) == [("1", None), (None, "x")]


@pytest.mark.parametrize("file_format", ["parquet", "csv"])
def test_yearly_jobs(spark, tmp_path, file_format):
    (tmp_path / "c.csv").write_text('comment,d,tourism_related\n"a\nb",03/2020,1\nx,04/2020,0\ny,01/2021,1\nz,?,0\n')
    folder = str(tmp_path / "years")
    counts = jobs.split_by_year(spark, str(tmp_path / "c.csv"), "d", folder, "%m/%Y", file_format)
    assert sorted(rows(counts), key=str) == [(2020, 2), (2021, 1), (None, 1)]
    trends = jobs.yearly_trends(spark, folder, output=str(tmp_path / "trends"), file_format=file_format)
    assert sorted(rows(trends), key=str) == [(2020, 2, 1, 50.0), (2021, 1, 1, 100.0), (None, 1, 0, 0.0)]
    assert spark.read.parquet(str(tmp_path / "trends")).count() == 3


def test_a_second_run_replaces_its_own_years_only(spark, tmp_path):
    folder = str(tmp_path / "years")
    for lines in ("a,2020-01-01\nb,2021-01-01\n", "c,2021-02-02\n"):
        (tmp_path / "c.csv").write_text("comment,d\n" + lines)
        counts = jobs.split_by_year(spark, str(tmp_path / "c.csv"), "d", folder)
    assert sorted(rows(counts)) == [(2020, 1), (2021, 1)]
    assert column(spark.read.parquet(folder).filter("year = 2021").select("comment")) == ["c"]


def test_label_results_per_file(spark, tmp_path):
    for name, lines in (("a.csv", "x,1\ny,0\n"), ("b.csv", "z,1\n")):
        (tmp_path / name).write_text("comment,tourism_related\n" + lines)
    got = jobs.label_results(spark, str(tmp_path))
    assert sorted((r[0].rsplit("/", 1)[1], *r[1:]) for r in rows(got)) == [("a.csv", 2, 1, 50.0), ("b.csv", 1, 1, 100.0)]


def test_examine_parquet(spark, tmp_path):
    spark.range(20).write.parquet(str(tmp_path / "t"))
    found = jobs.examine_parquet(spark, str(tmp_path / "t"), 3)
    assert found["samples"].count() == 3 and rows(found["profile"])[0][:5] == ("id", 20, 0, "0", "19")
    assert rows(found["schema"]) == [(0, "id", "bigint", True)]


def test_streams(spark, tmp_path):
    """Row-wise operators take a streaming frame and give what they give for a table."""
    frame = spark.createDataFrame([("Lovely Beach", "5"), ("good good", "6")], "comment string, like_count string")
    frame.write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).json(str(tmp_path / "in"))
    prepared = prepare_stream(stream, label_type="tourism", type_plan={"like_count": "count"})
    assert prepared.isStreaming
    write_stream(prepared, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).select("cleaned_text", "like_count", "tourism_related")
    assert rows(got) == [("lovely beach", 5, 1)]


def test_converted_tree_has_no_part_of_a_header_alone(spark, tmp_path):
    """Splits without a row group come first in a read, and make no file that counts as not converted."""
    import pyarrow as pa
    import pyarrow.parquet as pq
    from chatterlake.plans import queries

    for name, n in (("nation", 3), ("part", 1), ("orders", 20_000)):
        pq.write_table(pa.table({"key": list(range(n)), "word": [f"w{i}" for i in range(n)]}), tmp_path / f"{name}.parquet", row_group_size=n)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        assert spark.read.parquet(f"{tmp_path}/orders.parquet").rdd.glom().map(len).first() == 0
        assert sorted(rows(queries.job_convert(spark, str(tmp_path)))) == [("nation", True, True), ("orders", True, True), ("part", True, True)]
        assert rows(queries.conversion_summary(spark, str(tmp_path))) == [(True, 0, 0, True, 3)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
