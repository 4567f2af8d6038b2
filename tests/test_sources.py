import os

import pytest
from pyspark.sql import functions as F

from lexigraph.plans import jobs
from lexigraph.sources import scratch
from lexigraph.sources import text as files


def test_key_value_lines(spark, tmp_path):
    (tmp_path / "in").write_text("t1\tbody a\tb\nnokey\n\nT\t\n")
    rows = [(r.title, r.content) for r in files.corpus(spark, str(tmp_path / "in")).orderBy("row_id").collect()]
    assert rows == [("t1", "body a\tb"), ("nokey", ""), ("", ""), ("T", "")]


def test_several_inputs_told_apart_by_fields(spark, tmp_path):
    (tmp_path / "m").write_text("1 2 0.5\n2  2\t0.25\n")
    (tmp_path / "v").write_text("2\t0.1\n3 0.2\n")
    rows = files.lines(spark, str(tmp_path / "m"), str(tmp_path / "v"))
    assert sorted(files.parse_matrix(rows).collect()) == [(1, 2, 0.5), (2, 2, 0.25)]
    assert sorted(files.parse_vector(rows).collect()) == [(2, 0.1), (3, 0.2)]


def test_bad_lines_fail(spark):
    bad = spark.createDataFrame([("a b",)], "value string")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        files.parse_edges(bad).collect()
    assert files.parse_edges(bad, "string").first() == ("a", "b")


def test_matrix_and_pairs_round_trip(spark, tmp_path):
    cells = spark.createDataFrame([(1, 2, 1 / 3), (2, 1, 5e-4)], "i int, j int, a double")
    files.write_matrix(cells, str(tmp_path / "m"))
    assert sorted(files.parse_matrix(files.lines(spark, str(tmp_path / "m"))).collect()) == sorted(map(tuple, cells.collect()))
    files.write_pairs(cells, str(tmp_path / "kv"), "i", "a", one_file=True)
    assert [r.value for r in files.lines(spark, str(tmp_path / "kv")).collect()] == ["1\t0.3333333333333333", "2\t5.0E-4"]
    assert len(list((tmp_path / "kv").glob("part-*"))) == 1


def test_ordered_files_are_ranges_of_keys(spark, tmp_path):
    rows = spark.range(2000).selectExpr("format_string('k%04d', (id * 7919) % 2000) as k", "id as v").repartition(5)
    files.write_pairs(rows, str(tmp_path / "kv"), "k", "v", ordered=True)
    parts = sorted((tmp_path / "kv").glob("part-*"))
    keys = [line.split("\t")[0] for part in parts for line in part.read_text().splitlines()]
    assert keys == [f"k{i:04d}" for i in range(2000)]


def test_lines_of_three_fields_or_more(spark):
    rows = spark.createDataFrame([(x,) for x in ("1 2 .5", "1 3 .5 more", "4 .5", "5")], "value string")
    assert sorted(files.parse_matrix(rows, exact=False).collect()) == [(1, 2, 0.5), (1, 3, 0.5)]
    assert files.parse_matrix(rows).collect() == [(1, 2, 0.5)]


def test_jobs_from_paths_to_paths(spark, tmp_path):
    at = lambda name: str(tmp_path / name)
    (tmp_path / "corpus").write_text("a\tcat dog\nb\tcat\na\tcat fish\n")
    (tmp_path / "stop").write_text("dog\n")
    jobs.build_index(spark, at("corpus"), at("index"), at("stop"))
    assert sorted(r.value for r in files.lines(spark, at("index")).collect()) == ["cat\tb:0.58496\ta:0.29248", "fish\ta:0.79248"]
    (tmp_path / "edges").write_text("1 2\n2 1\n2 3\n")
    jobs.build_matrix(spark, at("edges"), at("matrix"))
    (tmp_path / "vector").write_text("1 0.5\n2 0.5\n")
    jobs.multiply(spark, at("matrix"), at("vector"), at("product"))
    assert sorted(r.value for r in files.lines(spark, at("product")).collect()) == ["1\t0.25", "2\t0.5", "3\t0.25"]
    jobs.prune(spark, at("edges"), at("pruned"))
    assert sorted(r.value for r in files.lines(spark, at("pruned")).collect()) == ["1\t2", "2\t1"]


def test_index_round_trip_with_colons_in_titles(spark, tmp_path):
    kind = "term string, postings array<struct<title:string,weight:double>>"
    index = spark.createDataFrame([("cat", [("a:b", 0.5), ("c", 5e-4)]), ("dog", [("d", 0.0)])], kind)
    files.write_index(index, str(tmp_path / "index"), one_file=True)
    lines = files.lines(spark, str(tmp_path / "index"))
    assert [r.value for r in lines.collect()] == ["cat\ta:b:0.5\tc:5.0E-4", "dog\td:0.0"]
    assert sorted(files.parse_index(lines).collect()) == sorted(index.collect())


def test_materialised_tables_live_in_the_shared_folder(spark):
    made = scratch.materialise(spark.range(10).withColumn("part", F.spark_partition_id()), "test", few=True)
    assert made.count() == 10 and all(scratch.shared_dir(spark) in f for f in made.inputFiles())
    assert scratch.materialise(spark.range(0), "empty").count() == 0


def test_discarded_tables_are_gone_and_clusters_need_a_shared_folder(spark, monkeypatch):
    made = scratch.materialise(spark.range(3), "gone")
    folder = made.inputFiles()[0].removeprefix("file:").replace("///", "/").rpartition("/")[0]
    assert os.path.isdir(folder)
    scratch.discard(made)
    assert not os.path.exists(folder)

    class Remote:
        master = "spark://host:7077"
        getConf = staticmethod(lambda: {})

    class Session:
        conf, sparkContext = {}, Remote

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.shared_dir(Session)


def test_postings_of_lines_are_parsed_one_by_one(spark):
    lines = spark.createDataFrame([("cat\ta:b:0.5\tc:5.0E-4",), ("dog\td:0.0",), ("none",)], "value string")
    found = files.parse_postings(lines)
    assert sorted(map(tuple, found.collect())) == [("cat", "a:b", 0.5), ("cat", "c", 5e-4), ("dog", "d", 0.0)]
    assert found._jdf.queryExecution().executedPlan().toString().count("split(") == 1
