import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import dataflow
from ledgerlens.sources import records

SCHEMA = "question_id string, n int"


def test_json_scans(spark, tmp_path):
    path = tmp_path / "rows.jsonl"
    path.write_text('{"question_id": "a", "n": 1}\n\n{"question_id": "b", "n": 2}\n')
    assert records.read_jsonl(spark, str(path), SCHEMA).count() == 2
    path.write_text('{"question_id": "a", "n": 1}\n{broken\n')
    assert [r.question_id for r in records.read_jsonl(spark, str(path), SCHEMA, "tolerant").collect()] == ["a"]
    with pytest.raises(Exception):
        records.read_jsonl(spark, str(path), SCHEMA).collect()
    for text in ('[{"question_id": "x", "n": 3}]', '{"records": [{"question_id": "x", "n": 3}]}'):
        path.write_text(text)
        assert [tuple(r) for r in records.read_document(spark, str(path), SCHEMA).collect()] == [("x", 3)]


def test_unique_and_submission(spark):
    good = spark.createDataFrame([("a", 0), ("b", 1)], SCHEMA)
    assert records.require_unique(good, "question_id").count() == 2
    with pytest.raises(Exception):
        records.require_unique(good.unionByName(good), "question_id").collect()
    rows = good.select(F.col("n").alias("id"), F.col("question_id").alias("pred_sql"))
    assert [r.id for r in records.submission(rows).collect()] == [0, 1]
    with pytest.raises(Exception):
        records.submission(rows.where("id = 1")).collect()


def test_bags(spark):
    a = spark.createDataFrame([(1, 0.1), (1, 0.1), (2, None)], "x int, y double")
    b = spark.createDataFrame([(2.0, None), (1.0, 0.1000000001), (1.0, 0.1)], "p double, q double")
    assert dataflow.bags_equal(a, b)
    assert not dataflow.bags_equal(a, b.limit(2)) and not dataflow.bags_equal(a, b.select("p"))


def test_csv_sink(spark, tmp_path):
    frame = spark.sql("SELECT 1 AS id, named_struct('a', 2) AS s, CAST(NULL AS STRING) AS t")
    records.write_csv(frame, str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).first().s == '{"a":2}'
    with pytest.raises(Exception):
        records.write_csv(frame, str(tmp_path / "out"))
