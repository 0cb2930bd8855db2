import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import marks
from ledgerlens.streaming.resume import append_routed, resume
from ledgerlens.streaming.sink import Sink
from ledgerlens.streaming.windows import last_figures, on_time, run_windows, windowed


def test_stream_resumes(spark, tmp_path):
    source, sink, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"id": "x", "n": 1}\n{"id": "y", "n": 2}\n{"id": "x", "n": 1}\n')
    resume(spark, source, "id string, n int", sink, state, ["id"]).awaitTermination()
    (tmp_path / "in" / "b.json").write_text('{"id": "y", "n": 2}\n{"id": null, "n": 3}\n')
    resume(spark, source, "id string, n int", sink, state, ["id"]).awaitTermination()
    assert sorted((r.id or "", r.n) for r in Sink(spark, sink).rows("id string, n int").collect()) == [("", 3), ("x", 1), ("y", 2)]


def test_a_driver_lost_between_write_and_log_adds_nothing(spark, tmp_path, monkeypatch):
    sink = Sink(spark, str(tmp_path / "sink"))
    one = spark.createDataFrame([("a", 2), ("a", 1), (None, 5), ("b", 3)], "id string, n int")
    with monkeypatch.context() as m:
        m.setattr(Sink, "_enter", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            sink.append(0, one, ["id"], "n")
    read = lambda: sorted((r.id or "", r.n, r._batch) for r in Sink(spark, sink.path).rows("id string, n int").collect())
    assert read() == [] and sink.append(0, one, ["id"], "n") and not sink.append(0, one, ["id"], "n")
    assert read() == [("", 5, 0), ("a", 1, 0), ("b", 3, 0)]
    two = spark.createDataFrame([("a", 0), ("c", 4), (None, 6)], "id string, n int")
    assert sink.append(1, two, ["id"], "n")
    assert read() == [("", 5, 0), ("a", 1, 0), ("b", 3, 0), ("c", 4, 1)]
    assert sink.vacuum() == 1 and sink.vacuum() == 0 and len(read()) == 4
    assert not sink._enter(1, {"folder": "data/none", "rows": 0}) and len(read()) == 4


def test_routes_have_their_own_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(k, "even" if k % 2 == 0 else "odd") for k in range(6)], "k int, way string")
    sinks = {n: Sink(spark, str(tmp_path / n)) for n in ("even", "odd")}
    assert append_routed(0, rows, F.col("way"), sinks, ["k"]) == {"even": True, "odd": True} == {n: not again for n, again in append_routed(0, rows, F.col("way"), sinks, ["k"]).items()}
    assert sorted(r.k for r in sinks["odd"].rows(rows.schema).collect()) == [1, 3, 5]
    with pytest.raises(ValueError):
        append_routed(1, rows.withColumn("way", F.lit(None).cast("string")), F.col("way"), sinks, ["k"])


def test_bit_sets_never_lose_a_key(spark, tmp_path):
    rows = spark.range(3000).select(F.when(F.col("id") % 100 != 0, F.col("id")).alias("a"), (F.col("id") % 7).cast("string").alias("b"))
    marks.bits_of(rows.limit(1500), ["a", "b"]).write.parquet(str(tmp_path / "1"))
    marks.bits_of(rows.where("a >= 1400"), ["a", "b"]).write.parquet(str(tmp_path / "2"))
    held = marks.merged(spark, [str(tmp_path / "1"), str(tmp_path / "2")])
    assert marks.maybe_marked(rows.where("a IS NOT NULL OR b = '0'").limit(1200), ["a", "b"], held, "m").where("NOT m").isEmpty()
    other = marks.maybe_marked(spark.range(10_000, 14_000).select(F.col("id").alias("a"), F.lit("x").alias("b")), ["a", "b"], held, "m")
    assert other.where("m").count() < 40


def test_late_and_repeated_records_across_a_restart(spark, tmp_path):
    source, sink, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    (tmp_path / "in").mkdir()
    schema = "id int, ts timestamp, v int"

    def put(name, rows):
        (tmp_path / "in" / name).write_text("\n".join('{"id": %d, "ts": "2024-01-01 %s", "v": %d}' % r for r in rows))

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(source)
        windows = windowed(on_time(stream, "ts", "1 hour", ["id"]), "ts", [], {"n": F.count("*"), "total": F.sum("v")}, length="1 hour")
        run_windows(windows, sink, state, "append")
        return sorted((r.window_start.hour, r.n, r.total) for r in last_figures(spark, sink, windows.schema, ["window_start"], "append").collect())

    put("a.json", [(1, "00:10:00", 1), (2, "00:20:00", 2), (1, "00:10:00", 1), (3, "01:30:00", 4)])
    assert run() == []  # the watermark is at 00:30
    put("b.json", [(2, "00:20:00", 2), (4, "00:50:00", 8), (5, "03:40:00", 16)])
    # a repeated record counts once, a late one within the watermark counts
    assert run() == [(0, 3, 11), (1, 1, 4)]
    put("c.json", [(6, "01:59:00", 32), (7, "02:50:00", 64), (8, "06:00:00", 128)])
    # record 6 is behind the watermark (02:40) and is dropped; its window was given out once
    assert run() == [(0, 3, 11), (1, 1, 4), (2, 1, 64), (3, 1, 16)] == run()
