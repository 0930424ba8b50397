import json

import pytest
from conftest import column, rows
from pyspark.sql import functions as F

from chatterlake.sources import csv, keywords, parquet, storage
from chatterlake.sources import json as json_source

LINES = 'text,n,code\n"He said ""hi""\nsecond line",1,abc\nNA,2,12\n"null",3,7\nshort\nx,4,5,EXTRA\ny,4,5,\nz,4,5,,\nw,,\n" a, b ",9,"c,d"\n\nlast,1,2'
WANT = [
    ('He said "hi"\nsecond line', "1", "abc"), (None, "2", "12"), (None, "3", "7"), ("short", None, None),
    ("w", None, None), (" a, b ", "9", "c,d"), ("last", "1", "2"),
]


@pytest.fixture
def comment_file(tmp_path):
    path = tmp_path / "comments.csv"
    path.write_text(LINES, encoding="utf-8")
    return str(path)


def test_lines_too_long_are_dropped_short_ones_padded(spark, comment_file):
    assert rows(csv.read_csv(spark, comment_file)) == WANT


def test_selecting_or_counting_does_not_change_which_rows_there_are(spark, comment_file):
    table = csv.read_csv(spark, comment_file)
    assert column(table.select("n")) == [w[1] for w in WANT]
    assert column(table.select("code").filter("code = 'abc'")) == ["abc"]
    assert table.count() == len(WANT)


def test_left_out_lines_can_be_listed(spark, comment_file):
    listed = csv.bad_lines(spark, comment_file)
    assert [r.strip() for r in column(listed.select("record"))] == ["x,4,5,EXTRA", "y,4,5,", "z,4,5,,"]
    assert listed.count() == 3


def test_too_long_lines_can_be_an_error(spark, comment_file, tmp_path):
    with pytest.raises(Exception, match="Too many fields"):
        csv.read_comments(spark, comment_file).collect()
    good = tmp_path / "good.csv"
    good.write_text("comment\nfine\n")
    assert rows(csv.read_comments(spark, str(good))) == [("fine",)]
    with pytest.raises(ValueError):
        csv.read_csv(spark, str(good), on_bad_lines="guess")


def test_delimiter(spark, tmp_path):
    path = tmp_path / "semi.csv"
    path.write_text("a;b\n1;2\n3;4;5\n")
    assert rows(csv.read_csv(spark, str(path), ";")) == [("1", "2")]


def test_folder_of_files_in_any_case(spark, tmp_path):
    (tmp_path / "deep" / "er").mkdir(parents=True)
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "deep" / "b.CSV").write_text("x,y\n3,4\n")
    (tmp_path / "deep" / "er" / "c.Csv").write_text("x,y\n5,6\n")
    (tmp_path / "deep" / "d.txt").write_text("x,y\n7,8\n")
    found = csv.find_csv(spark, str(tmp_path))
    assert sorted(p.rsplit("/", 1)[1] for p in column(found.select("path"))) == ["a.csv", "b.CSV", "c.Csv"]
    table = csv.read_csv(spark, str(tmp_path), file_name_col="file")
    assert sorted(rows(table.select("x", "y"))) == [("1", "2"), ("3", "4"), ("5", "6")]
    assert table.filter(F.col("file").endswith("b.CSV")).select("x").first()[0] == "3"


def test_files_of_other_columns_are_refused(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "b.csv").write_text("y,x\n3,4\n")
    with pytest.raises(Exception, match="header"):
        csv.read_csv(spark, str(tmp_path)).collect()


def test_csv_round_trip(spark, tmp_path):
    values = [' lead', 'trail ', 'a,b', 'q"q"', '"', 'line\nbreak', 'cr\r\nlf', 'tab\t', 'back\\slash', 'é😂', '\\"', None]
    frame = spark.createDataFrame(list(enumerate(values)), "i int, t string")
    path = csv.write_csv(frame, str(tmp_path / "out"))
    back = csv.read_csv(spark, path).select(F.col("i").cast("int"), "t").orderBy("i")
    assert rows(back) == list(enumerate(values))


def test_nested_values_become_json(spark, tmp_path):
    frame = spark.range(1).select(F.array(F.lit(1), F.lit(2)).alias("a"), F.struct(F.lit("x").alias("k")).alias("s"))
    back = csv.read_csv(spark, csv.write_csv(frame, str(tmp_path / "out")))
    assert rows(back) == [("[1,2]", '{"k":"x"}')]


def test_json_forms(spark, tmp_path):
    records = [{"b": 1, "text": "x"}, {"text": "y\nz", "a": {"k": [1]}}]
    for name, document in (("object", {"comments": records}), ("list", records)):
        path = tmp_path / f"{name}.json"
        path.write_text(json.dumps(document, indent=1))
        got = json_source.read_json_comments(spark, str(path))
        assert sorted(got.columns) == ["a", "b", "text"]
        assert rows(got.select("text", "b", F.to_json("a"))) == [("x", 1, None), ("y\nz", None, '{"k":[1]}')]
    bad = tmp_path / "bad.json"
    bad.write_text('{"comments": 3}')
    with pytest.raises(ValueError):
        json_source.read_json_comments(spark, str(bad))


def test_keywords(spark, tmp_path):
    path = tmp_path / "spam.txt"
    path.write_text("  Free Gift \n\n \t\nsubscribe\nSUBSCRIBE\n")
    found = keywords.read_keywords(spark, str(path))
    assert keywords.keyword_list(found) == ["free gift", "subscribe"]
    assert keywords.keyword_list(found, limit=1) is None
    assert keywords.keyword_list(keywords.read_keywords(spark, str(tmp_path / "none.txt"))) == []
    assert keywords.keyword_list(keywords.read_keywords(spark, None)) == []


@pytest.mark.parametrize("codec", ["snappy", "gzip", "zstd", "none"])
def test_parquet_codecs(spark, tmp_path, codec):
    path = str(tmp_path / "t")
    assert parquet.write_parquet(spark.range(3), path, codec)
    assert not parquet.write_parquet(spark.range(5), path, codec)
    assert spark.read.parquet(path).count() == 3
    assert parquet.write_parquet(spark.range(5), path, codec, overwrite=True)
    assert spark.read.parquet(path).count() == 5 and parquet.verify_parquet(spark, path)


def test_parquet_failures(spark, tmp_path):
    with pytest.raises(ValueError, match="brotli"):
        parquet.write_parquet(spark.range(1), str(tmp_path / "b"), "brotli")
    with pytest.raises(ValueError):
        parquet.write_parquet(spark.range(1), str(tmp_path / "x"), "lzma")
    parquet.write_parquet(spark.range(0), str(tmp_path / "empty"))
    assert not parquet.verify_parquet(spark, str(tmp_path / "empty"))
    assert not parquet.verify_parquet(spark, str(tmp_path / "absent"))


def test_staged_tables_are_removed(spark):
    with storage.staged(spark.range(4), "t") as table:
        path = table.inputFiles()[0].rsplit("/", 1)[0]
        assert table.count() == 4 and storage.path_exists(spark, path)
        assert path.split(":", 1)[-1].lstrip("/").startswith(storage.working_folder(spark).split(":", 1)[-1].lstrip("/"))
    assert not storage.path_exists(spark, path)


def test_spread_only_shuffles_small_tables(spark, tmp_path):
    spark.range(10).coalesce(1).write.parquet(str(tmp_path / "one"))
    one = spark.read.parquet(str(tmp_path / "one"))
    assert storage.spread(one, "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    many = spark.range(0, 100, 1, 16)
    assert storage.spread(many) is many


def test_json_kinds(spark, tmp_path):
    """Only an object is unwrapped; empty lists are empty, damaged documents an error."""
    def read(name, content):
        (tmp_path / name).write_text(content)
        return json_source.read_json_comments(spark, str(tmp_path / name))

    found = read("list.json", '[{"id":1,"comments":[{"x":1}]},{"id":2,"comments":[]}]')
    assert sorted((r.id, len(r.comments)) for r in found.collect()) == [(1, 1), (2, 0)]
    assert sorted(r.comments for r in read("text.json", ' [{"comments":"a"},{"comments":"b"}]').collect()) == ["a", "b"]
    assert read("empty.json", '{"comments": []}').count() == 0
    with pytest.raises(Exception):
        read("cut.json", '{"comments": [{"a": 1}, {"b"').collect()
    with pytest.raises(ValueError):
        read("number.json", '{"comments": [1, 2]}')


def test_csv_readers_agree(spark, tmp_path):
    """Where every line is strict, both readers give the same rows; the choice does not look at the size."""
    body = 'a,b,c\n1,"x, ""y""",2\n,,\n"q",,"w"\n1,2,3,4\nshort\n'
    (tmp_path / "t.csv").write_text(body)
    routes = [sorted(rows(csv.read_csv(spark, str(tmp_path / "t.csv"), multi_line=m)), key=str) for m in (None, False, True)]
    assert routes[0] == routes[1] == routes[2] and len(routes[0]) == 4
    assert not csv._needs_multi_line(spark, str(tmp_path / "t.csv"), ",")
    (tmp_path / "inch.csv").write_text('a,b,c\n1,5" tall,"first line\nsecond line",6" wide\n1,5" a,6" b,x\n1,5" a,b\n')
    assert csv._needs_multi_line(spark, str(tmp_path / "inch.csv"), ",")
    assert rows(csv.read_csv(spark, str(tmp_path / "inch.csv"))) == [("1", '5" a', "b")]
    assert csv.bad_lines(spark, str(tmp_path / "inch.csv")).count() == 2
    (tmp_path / "cr.csv").write_bytes(b"a,b\n1,2\r3,4\r\n5,6\n")
    assert sorted(rows(csv.read_csv(spark, str(tmp_path / "cr.csv")))) == [("1", "2"), ("3", "4"), ("5", "6")]
    for delimiter in ("|", "||", "\t"):
        (tmp_path / "d.csv").write_text(f'a{delimiter}b\n"x{delimiter}y"{delimiter}z\n"l1\nl2"{delimiter}w\n')
        assert csv.read_csv(spark, str(tmp_path / "d.csv"), delimiter).count() == 2


def test_empty_files_are_listed(spark, tmp_path):
    (tmp_path / "sub dir").mkdir()
    (tmp_path / "sub dir" / "none.CSV").write_text("")
    (tmp_path / "some.csv").write_text("a\n1\n")
    found = {r.path.rsplit("/", 1)[1]: r.length for r in csv.find_csv(spark, str(tmp_path)).collect()}
    assert found == {"none.CSV": 0, "some.csv": 4}


def test_missing_keyword_file_warns(spark, tmp_path):
    with pytest.warns(UserWarning, match="No keyword file"):
        assert keywords.read_keywords(spark, str(tmp_path / "none.txt")).count() == 0


def test_json_object_after_many_blanks(spark, tmp_path):
    from chatterlake.sources.json import read_json_comments

    (tmp_path / "blanks.json").write_text(" \n" * 5000 + '{"comments": [{"a": 1}, {"a": 2}]}')
    assert sorted(r.a for r in read_json_comments(spark, str(tmp_path)).collect()) == [1, 2]


def plain_records(data, delimiter=","):
    """Records of a file's bytes by Python's own reader."""
    import csv as python_csv
    import io

    return [r for r in python_csv.reader(io.StringIO(data.decode(), newline=""), delimiter=delimiter) if r]


def test_spanning_records_are_cut_in_any_split(spark, tmp_path):
    """Quoted breaks, bare quotes and all kinds of line ends, in splits of every size, against one reader over the whole file."""
    import random

    rng = random.Random(4)
    fields = ['"a\nb"', '"q""\r\n""x"', "plain", '5" tall', '""', '" , "', '"z"tail"', "é", '"\r"', ""]
    # A record of many lines reaches over several of the smallest splits.
    for trial in range(2):
        lines = ["h1,h2"]
        for _ in range(200):
            row = [rng.choice(fields) for _ in range(2)]
            if rng.random() < 0.1:
                row[1] = '"' + "long, line\n" * rng.randint(20, 60) + '"'
            lines.append(",".join(row))
        data = (rng.choice(["\n", "\r\n"]).join(lines) + "\n").encode()
        path = tmp_path / f"s{trial}.csv"
        path.write_bytes(data)
        want = [tuple(v or None for v in r) for r in plain_records(data)[1:]]
        for size in (197, 1 << 20):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", 1)
            try:
                table = csv.read_csv(spark, str(path), multi_line=True)
                assert size > 1000 or table.rdd.getNumPartitions() > 20
                assert sorted(rows(table.na.fill("").select(*[F.when(F.col(c) != "", F.col(c)).alias(c) for c in ("h1", "h2")])), key=str) == sorted(want, key=str)
            finally:
                spark.conf.unset("spark.sql.files.maxPartitionBytes")
                spark.conf.unset("spark.sql.files.openCostInBytes")


def test_csv_edges(spark, tmp_path):
    def file(name, data):
        (tmp_path / name).write_bytes(data)
        return str(tmp_path / name)

    with pytest.raises(ValueError, match="no header"):
        csv.read_csv(spark, file("none.csv", b""))
    assert csv.read_csv(spark, file("head.csv", b"a,b\n")).count() == 0
    twice = csv.read_csv(spark, file("twice.csv", b"a,a,A,,b\n1,2,3,4,5\n"))
    assert twice.columns == ["a", "a.1", "A.2", "Unnamed: 3", "b"] and [tuple(r) for r in twice.collect()] == [("1", "2", "3", "4", "5")]
    spanning = csv.read_csv(spark, file("twice2.csv", b'a,a\n"x\ny",2\n'))
    assert spanning.columns == ["a", "a.1"] and [tuple(r) for r in spanning.collect()] == [("x\ny", "2")]
    crlf = csv.read_csv(spark, file("crlf.csv", b'a,b\r\n"x\r\ny",2\r\nz,3\r\n'))
    assert [tuple(r) for r in crlf.collect()] == [("x\r\ny", "2"), ("z", "3")]
    with pytest.raises(ValueError, match="inside quotes"):
        csv.read_csv(spark, file("open.csv", b'a,b\n1,"x\n2,3\n4,5\n'))
    head = csv.read_csv(spark, file("wide.csv", '﻿"first\nname",b\n1,2\n'.encode()))
    assert head.columns == ["first\nname", "b"] and [tuple(r) for r in head.collect()] == [("1", "2")]
    (tmp_path / "mixed").mkdir()
    file("mixed/one.csv", b'a,b\n"x\ny",2\n')
    file("mixed/two.csv", b"a,b\n3,4\n")
    file("mixed/three.csv", b"")
    assert sorted(rows(csv.read_csv(spark, str(tmp_path / "mixed")))) == [("3", "4"), ("x\ny", "2")]
    file("mixed/four.csv", b"a,c\n3,4\n")
    with pytest.raises(Exception, match="header"):
        csv.read_csv(spark, str(tmp_path / "mixed")).collect()
    assert rows(csv.read_csv(spark, file("empty.csv", b'a,b\n"",\n"x\n",1\n'), missing_words=())) == [("", None), ("x\n", "1")]


def test_lines_tell_where_records_end():
    """Random characters, cut after every line that ends outside quotes, against one reader over the whole."""
    import random

    from chatterlake.sources import records

    rng = random.Random(1)
    for _ in range(20_000):
        text = "".join(rng.choice(['"', '"', ",", "a", "\n", "\r", "\r\n", " "]) for _ in range(rng.randint(1, 14)))
        inside, held, found = False, "", []
        for line in text.removesuffix("\n").split("\n"):
            held, inside = held + line + "\n", records.ends_inside(line, inside, ",")
            if not inside:
                found += [[v or "" for v in fields] for fields, _ in records.parse(held, ",")]
                held = ""
        assert inside or found == plain_records(text.encode())
