"""Event-time windows over streams: tumbling, sliding and session windows with late and repeated records.

A watermark says how long a window stays open for late records; state older than
it is dropped. Every micro-batch's windows go to a sink under the batch's number,
so a restart adds nothing twice, and a window's last figures are those that count.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.sources.scratch import fresh_path
from ledgerlens.streaming.sink import Sink


def on_time(stream: DataFrame, ts: str, delay: str, unique: list[str] | None = None) -> DataFrame:
    """A stream with a watermark; of records with one key in ``unique`` that come within it only the first is kept."""
    out = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    return out.dropDuplicatesWithinWatermark(unique) if unique else out


def windowed(stream: DataFrame, ts: str, by: list[str], figures: dict[str, Column], length: str | None = None, slide: str | None = None, gap: str | None = None) -> DataFrame:
    """Figures of each window and group: windows of ``length``, one every ``slide``, or sessions that end after ``gap`` without a record."""
    if (length is None) == (gap is None):
        raise ValueError("either a length or a gap")
    window = F.session_window(ts, gap) if gap else F.window(ts, length, slide)
    grouped = stream.groupBy(window.alias("w"), *by).agg(*[c.alias(n) for n, c in figures.items()])
    return grouped.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, *figures)


def run_windows(windows: DataFrame, sink: str, checkpoint: str, mode: str = "update") -> None:
    """Runs a stream of windows over all that its source has now. ``append``: closed windows only; ``update``: those that changed; ``complete``: all (sessions have no ``update``)."""
    target = Sink(windows.sparkSession, sink)
    query = windows.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(lambda batch, number: target.append(number, batch)).trigger(availableNow=True).start()
    query.awaitTermination()


def last_figures(spark: SparkSession, sink: str, schema, keys: list[str], mode: str = "update") -> DataFrame:
    """The figures that count: each window's of its last batch, or the whole last batch of ``complete``."""
    rows = Sink(spark, sink).rows(schema)
    if mode == "complete":
        last = max(Sink(spark, sink).log(), default=-1)
        return rows.where(F.col("_batch") == last).drop("_batch")
    if mode == "append":
        return rows.drop("_batch")
    names = [c for c in rows.columns if c != "_batch"]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*names), "_batch").alias("r")).select("r.*")


def events_windows(spark: SparkSession, path: str, make: Callable[[DataFrame], DataFrame], keys: list[str], mode: str) -> DataFrame:
    """Windows over a table of events, read as a stream."""
    schema = spark.read.parquet(path).schema
    # as a pattern: a stream takes folders, and single files only by a pattern
    windows = make(spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]"))
    sink = fresh_path(spark, "windows")
    run_windows(windows, sink, fresh_path(spark, "windows-state"), mode)
    return last_figures(spark, sink, windows.schema, keys, mode)
