"""File sources and sinks on small files."""

import json

from quillspark.sources import files


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_json_lines_keep_maps_and_survive_broken_lines(spark, tmp_path):
    path = tmp_path / "b.json"
    path.write_text(json.dumps({"business_id": "x", "attributes": {"a": "True"}, "stars": 4.5}) + "\n{broken\n")
    got = files.json_lines(spark, str(path), files.BUSINESS).select("business_id", "attributes", "stars").collect()
    assert len(got) == 2 and {r.business_id for r in got} == {"x", None} and [r.attributes for r in got if r.attributes] == [{"a": "True"}]


def test_csv_with_quotes(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('day,customer,item\n"2000-01-01","a, b",7\n')
    assert rows(files.csv(spark, str(path), "day string, customer string, item int")) == [("2000-01-01", "a, b", 7)]


def test_points_drop_the_label(spark, tmp_path):
    path = tmp_path / "p.txt"
    path.write_text("0,3,1.5,2.5\n1,4,-1,0\n")
    assert [(r.idx, r.vector) for r in files.points(spark, str(path)).orderBy("idx").collect()] == [(0, [1.5, 2.5]), (1, [-1.0, 0.0])]


def test_folder_takes_the_key_from_the_name(spark, tmp_path):
    for name in ("12_com.csv", "7_com.csv", "7_tm.csv"):
        (tmp_path / name).write_text(f"sku,qty\n{name},1\n")
    assert rows(files.folder_csv(spark, str(tmp_path), "sku string, qty int", "*_com.csv")) == [("12_com.csv", 1, 12), ("7_com.csv", 1, 7)]


def test_text_tree_numbers_lines(spark, tmp_path):
    (tmp_path / "ABC").mkdir()
    (tmp_path / "ABC" / "2019.txt").write_text("one\ntwo")
    assert rows(files.text_tree(spark, str(tmp_path))) == [("ABC", "2019.txt", 0, "one"), ("ABC", "2019.txt", 1, "two")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, n int")
    files.write_csv(df, str(tmp_path / "c"), one_file=True)
    assert len(list((tmp_path / "c").glob("part-*"))) == 1 and rows(files.csv(spark, str(tmp_path / "c"), "k string, n int")) == [("a", 1), ("b", 2)]
    files.write_json_summary(df.limit(1), str(tmp_path / "j"))
    assert rows(files.json_lines(spark, str(tmp_path / "j"), "k string, n int")) == [("a", 1)]
    files.write_lines(df, "k", str(tmp_path / "l"), by="n")
    assert sorted(p.name for p in (tmp_path / "l").glob("n=*")) == ["n=1", "n=2"]
    files.write_missing(df, str(tmp_path / "m"))
    files.write_missing(df.limit(0), str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).count() == 2


def test_partitions_that_are_not_written_stay(spark, tmp_path):
    path = str(tmp_path / "p")
    files.write_partitioned(spark.createDataFrame([(1, 1), (2, 2)], "v int, k int"), path, ["k"])
    files.write_partitioned(spark.createDataFrame([(9, 2)], "v int, k int"), path, ["k"])
    assert rows(spark.read.parquet(path).select("k", "v")) == [(1, 1), (2, 9)]
