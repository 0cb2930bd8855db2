import json

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import reports, rows
from ledgerlens.plans import contradict
from ledgerlens.sources import records, scratch


def test_subsets(spark):
    frame = spark.range(10).repartition(3)
    assert [r.id for r in rows.subset(frame, 3, 4, "id").collect()] == [3, 4, 5, 6] and rows.subset(frame, 20, 4, "id").collect() == []
    assert [r.id for r in rows.head(frame, 2, "id").collect()] == [0, 1] and rows.head(frame, None, "id").count() == 10
    for bad in (lambda: rows.subset(frame, -1, 4), lambda: rows.subset(frame, 0, 0), lambda: rows.head(frame, 0, "id")):
        with pytest.raises(ValueError):
            bad()


def test_shuffles(spark):
    import random

    want = list(range(50))
    random.Random(7).shuffle(want)
    frame = spark.range(50).repartition(3)
    assert [r.id for r in rows.shuffled(frame, "id", 7, exact=True).collect()] == want and [r.id for r in rows.shuffled(frame, "id", 7, 5, exact=True).collect()] == want[:5]
    once = [r.id for r in rows.shuffled(frame, "id", 7).collect()]
    assert once == [r.id for r in rows.shuffled(frame.repartition(5), "id", 7).collect()] and sorted(once) == list(range(50)) and once != [r.id for r in rows.shuffled(frame, "id", 8).collect()]


def test_few_shot(spark):
    frame = spark.createDataFrame([(2, "train", "Easy"), (1, "train", " easy"), (3, "train", "medium"), (4, "test", "hard"), (5, "train", "hard")], "idx int, split string, level string")
    assert [r.idx for r in rows.few_shot(frame).collect()] == [1, 3, 5]
    with pytest.raises(Exception, match="no training record of level hard"):
        rows.few_shot(frame.where("idx < 4")).collect()


def test_previews_and_projections(spark):
    frame = spark.range(5).withColumn("_x", F.lit(1))
    assert rows.without_internal(frame).columns == ["id"]
    shown = rows.preview(frame.select("id").orderBy("id"), 2)
    assert shown == {"row_count": 5, "truncated": True, "rows": [[0], [1]]} and rows.preview(frame.limit(0))["row_count"] == 0
    held = rows.annotation_rows(spark.createDataFrame([("q", "x")], "question_id string, other string"))
    assert held.columns == [*rows.ANNOTATED, *rows.LABELS] and held.first().question_id == "q"


def test_contradiction_reports(spark):
    pairs = [(contradict.HARD, True, False, ["output_shape_warning"]), (contradict.HARD, False, False, []), (contradict.NONE, True, True, ["output_shape_warning"]), (contradict.NONE, None, False, []), (contradict.UNKNOWN, False, None, [])]
    frame = spark.createDataFrame(pairs, "status string, execution_match boolean, excluded_from_primary_metrics boolean, warnings array<string>")
    got = reports.contradiction_report(frame).first()
    assert (got.total, got.evaluable, got.hard_pass, got.hard_fail, got.none_pass, got.none_fail, got.without_match, got.measured, got.measured_pass) == (5, 4, 1, 1, 1, 0, 1, 3, 1) and got.hard_rate == 0.5
    found = {r.code: (r.n, r.rate) for r in reports.warning_rates(frame).collect()}
    assert found["output_shape_warning"] == (2, 0.5) and set(found) == set(contradict.WARNINGS) and found["financial_scope_warning"] == (0, 0.0)
    none = reports.contradiction_report(frame.limit(0)).first()
    assert none.total == 0 and none.hard_rate == 0.0 and all(r.rate == 0.0 for r in reports.warning_rates(frame.limit(0)).collect())


def test_sets_side_by_side(spark):
    frame = spark.createDataFrame([("a", "before", 1, 5), ("a", "before", 2, 6), ("a", "after", 3, 7), ("b", "after", 4, 8)], "question_id string, set string, at int, v int")
    got = {r.question_id: (r.before and r.before.v, r.after and r.after.v) for r in reports.split_sets(frame).collect()}
    assert got == {"a": (6, 7), "b": (None, 8)}
    with pytest.raises(Exception, match="unknown set"):
        reports.split_sets(spark.createDataFrame([("a", "later", 1, 5)], frame.schema)).collect()


def test_breakdowns(spark):
    frame = spark.createDataFrame([(1, ["b", "a"]), (1, ["a", "b"]), (None, None)], "x int, y array<string>")
    assert [tuple(r) for r in reports.breakdown(frame, "x").collect()] == [("1", 2), ("None", 1)] and {tuple(r) for r in reports.breakdown(frame, "y").collect()} == {('["a","b"]', 2), ("[]", 1)}
    assert {(r.name, r.value, r.n) for r in reports.histograms(frame.select("x"), ["x"]).collect()} == {("x", "1", 2), ("x", None, 1)}


def test_lines_that_hold_no_object(spark, tmp_path):
    path = str(tmp_path / "a.jsonl")
    (tmp_path / "a.jsonl").write_text('{"id": "1"}\n\n[1]\n{"id": "1"}\n{bad\n')
    assert [(r.line, r.text) for r in records.bad_lines(spark, path).collect()] == [(3, "[1]"), (5, "{bad")]
    with pytest.raises(ValueError, match="line 3"):
        records.read_checked(spark, path, "id string")
    (tmp_path / "a.jsonl").write_text('{"id": "1"}\n{"id": "1"}\n')
    assert records.read_checked(spark, path, "id string").count() == 2
    with pytest.raises(ValueError):
        records.read_checked(spark, path, "id string", "id")


def test_names_of_files_tell_group_and_mode(spark):
    frame = spark.createDataFrame([("verified_groupA_probe.jsonl", None, None), ("x.jsonl", "B_wrong_executable", "none"), ("verified_groupB_direct.jsonl", "", "")], "file_name string, evaluation_group string, probing_mode string")
    got = [(r.origin_group, r.origin_mode) for r in records.with_origin(frame).collect()]
    assert got == [("A_correct_executable", "probe"), ("B_wrong_executable", "direct"), ("B_wrong_executable", "direct")]
    with pytest.raises(Exception, match="no "):
        records.with_origin(frame.where("file_name = 'x.jsonl'").withColumn("evaluation_group", F.lit(None).cast("string"))).collect()


def test_question_records(spark):
    frame = spark.createDataFrame([("q", "s", "easy", " Dev"), ("r", "t", "hard", "train")], "Query string, SQL string, Levels string, split string").coalesce(1)
    got = records.question_records(frame, "ledger")
    assert [(r.question_id, r.split, r.db_id) for r in got.collect()] == [("booksql_000000", "validation", "ledger"), ("booksql_000001", "train", "ledger")]
    assert records.load_records(got, "text", "dev").first().schema == "text" and records.load_records(got.drop("gold_sql"), "text", gold=False).count() == 2
    for bad in (lambda: records.question_records(frame.drop("SQL"), "x"), lambda: records.load_records(got, "text", "test"), lambda: records.load_records(got.drop("gold_sql"), "text")):
        with pytest.raises(ValueError):
            bad()


def test_schema_texts(spark):
    tables = {"b": spark.range(1), "a": spark.createDataFrame([("x",)], "name string")}
    text = records.schema_text(tables, {"b": "id"}, [("a", "name", "b", "id")])
    assert text.index("Table: a") < text.index("Table: b") and "id" in text
    assert records.annotation_template(tables)["a"] == {"name": {"description": "", "semantic_role": None, "measure_type": None, "unit": None}}
    with pytest.raises(ValueError):
        records.schema_text({})


def test_written_records(spark, tmp_path):
    frame = spark.createDataFrame([(2, None, "x"), (1, "b", "y")], "id int, v string, _hidden string")
    path = str(tmp_path / "out")
    records.write_jsonl(frame, path, "id")
    assert [json.loads(r.value) for r in spark.read.text(path).collect()] in ([{"id": 1, "v": "b"}, {"id": 2, "v": None}], [{"id": 2, "v": None}, {"id": 1, "v": "b"}])
    with pytest.raises(FileExistsError):
        records.guarded(spark, [path])
    records.guarded(spark, [path], overwrite=True)
    records.write_document({"a": [1]}, str(tmp_path / "doc"), spark)
    assert scratch.exists(spark, str(tmp_path / "doc")) and not scratch.exists(spark, str(tmp_path / "none"))
