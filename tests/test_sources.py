"""Delimited files with headers of their own, read in byte ranges."""

import pytest
from pyspark.sql import functions as F

from cubemerge.sources import files


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_headers_differ_by_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text('title, one\nsecond title\nid, name ,v\n1,"x, y",10\n\n2,,\n3,z\n')
    (tmp_path / "b.csv").write_text("t\nt\nv,id\r\n5,4\r\n6,5,extra\r\n")
    (tmp_path / "c.csv").write_text("t\nt\n")
    (tmp_path / "d.csv").write_text("")
    (tmp_path / "e.csv").write_text("t\nt\nname,id,name\né,6,no")
    table = files.read_delimited(spark, str(tmp_path), skip_rows=2, stem="file")
    assert table.columns == ["id", "name", "v", "file"]
    assert rows(table) == sorted([
        ("1", "x, y", "10", "a"), ("2", None, None, "a"), ("3", "z", None, "a"), ("4", None, "5", "b"), ("5", None, "6", "b"), ("6", "é", None, "e"),
    ], key=repr)


def test_a_file_is_split_over_tasks(spark, tmp_path):
    lines = [f"{i},{'w' * (i % 13)}" for i in range(5000)]
    (tmp_path / "big.csv").write_text("list\nid,w\n" + "\n".join(lines) + "\n")
    (tmp_path / "other.csv").write_text("list\nw,id\nq,-1\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        table = files.read_delimited(spark, str(tmp_path), skip_rows=1, line="line")
        assert table.select(F.spark_partition_id()).distinct().count() > 3
        got = {int(r["id"]): r for r in table.collect()}
        in_order = [int(r["id"]) for r in table.where(F.col("line.path").endswith("big.csv")).orderBy("line").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert set(got) == {-1, *range(5000)} and in_order == list(range(5000))
    assert all(got[i]["w"] == ("w" * (i % 13) or None) for i in range(5000)) and got[-1]["w"] == "q"


@pytest.mark.parametrize("text", ["", "\n\n"])
def test_files_without_rows(spark, tmp_path, text):
    (tmp_path / "x.csv").write_text(text)
    assert files.read_delimited(spark, str(tmp_path)).count() == 0


def test_without_a_header(spark, tmp_path):
    (tmp_path / "x.csv").write_text("skip\n1;a\n2;b;c\n")
    assert rows(files.read_csv(spark, str(tmp_path / "x.csv"), sep=";", header=False, skip_rows=1)) == [("1", "a"), ("2", "b")]


def test_many_files_go_without_broadcast(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "BROADCAST_FILES", 0)
    for i in range(6):
        (tmp_path / f"{i}.csv").write_text("a,b\n1,2\n" if i % 2 else "b,a\n2,1\n")
    assert rows(files.read_glob(spark, str(tmp_path / "*.csv"))) == [("1", "2", str(i)) for i in range(6)] or rows(files.read_glob(spark, str(tmp_path / "*.csv"))) == [("2", "1", str(i)) for i in range(6)]
