"""JSON arrays from many tasks: order, layouts, attempts and failures."""

import json
import os
from types import SimpleNamespace

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chomeflow.sources import json_array
from chomeflow.sources.json_array import JsonArrayWriter, write_json_array


def _rows(spark, n, parts=6):
    return spark.range(0, n, 1, parts).select("id", F.when(F.col("id") % 3 > 0, F.concat(F.lit('区"\\\n'), "id")).alias("name"), F.array(F.lit(1), F.lit(None)).alias("a"))


def _want(n):
    return [{"id": i, "name": f'区"\\\n{i}' if i % 3 else None, "a": [1, None]} for i in range(n)]


def test_files_of_arrays_keep_order_and_size(spark, tmp_path):
    at = tmp_path / "deep" / "out"
    write_json_array(_rows(spark, 1000).orderBy("id"), str(at), rows_per_file=70)
    parts = [json.loads((at / f).read_text("utf-8")) for f in sorted(os.listdir(at))]
    assert [r for p in parts for r in p] == _want(1000) and max(map(len, parts)) <= 70 and len(parts) > 14
    assert os.listdir(tmp_path / "deep") == ["out"]
    back = spark.read.schema("id long, name string, a array<int>").option("multiLine", True).json(str(at))
    assert sorted(back.collect()) == sorted(_rows(spark, 1000).collect())
    write_json_array(_rows(spark, 5), str(at), mode="append")
    assert back.sparkSession.read.option("multiLine", True).json(str(at)).count() == 1005


def test_one_file_of_any_number_of_rows(spark, tmp_path):
    at = tmp_path / "all.json"
    for n in (20_011, 3, 0):
        write_json_array(_rows(spark, n).orderBy("id"), f"file://{at}", single=True)
        assert json.loads(at.read_text("utf-8")) == _want(n)
    with pytest.raises(Exception, match="all.json"):
        write_json_array(_rows(spark, 1), str(at), single=True, mode="append")
    assert json.loads(at.read_text("utf-8")) == [] and os.listdir(tmp_path) == ["all.json"]


def test_no_rows_are_an_empty_array(spark, tmp_path):
    for df in (_rows(spark, 0), spark.createDataFrame([], "x int").where("x > 1")):
        write_json_array(df, f"{tmp_path}/none")
        assert [json.loads((tmp_path / "none" / f).read_text()) for f in os.listdir(tmp_path / "none")] == [[]]


def test_a_failed_write_leaves_the_target(spark, tmp_path):
    at = str(tmp_path / "out")
    write_json_array(_rows(spark, 10).orderBy("id"), at)
    before = sorted(os.listdir(at))
    with pytest.raises(Exception, match="broken row"):
        write_json_array(_rows(spark, 1000).withColumn("x", F.when(F.col("id") == 999, F.raise_error(F.lit("broken row")))), at)
    assert sorted(os.listdir(at)) == before and os.listdir(tmp_path) == ["out"]


def test_only_committed_attempts_count(tmp_path, monkeypatch):
    writer = JsonArrayWriter(f"file://{tmp_path}/out", False, 2, True)

    def attempt(partition, number, values):
        monkeypatch.setattr(json_array, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: partition, taskAttemptId=lambda: number)))
        return writer.write(iter([pa.RecordBatch.from_arrays([pa.array(values)], ["value"])]))

    attempt(0, 1, ["1", "2"])  # lost with its executor
    late, early = attempt(1, 2, ["4"]), attempt(0, 3, ["1", "2", None])
    writer.commit([late, early])
    assert [json.loads((tmp_path / "out" / f).read_text()) for f in sorted(os.listdir(tmp_path / "out"))] == [[1, 2], [None], [4]]
    assert os.listdir(tmp_path) == ["out"]
