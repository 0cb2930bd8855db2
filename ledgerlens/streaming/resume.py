"""Incremental evaluation: new records are appended to a sink unless their run key is there already."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerlens.streaming.sink import Sink


def resume(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, keys: list[str], order: str | None = None) -> StreamingQuery:
    """A stream of JSON records from a folder into a sink; a repeated batch adds nothing, so a restart is safe."""
    stream = spark.readStream.schema(schema).json(source)
    target = Sink(spark, sink)
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, number: target.append(number, batch, keys, order)).trigger(availableNow=True).start()


def append_routed(batch: int, rows: DataFrame, route: Column, sinks: dict[str, Sink], keys: list[str], order: str | None = None) -> dict[str, bool]:
    """Appends each route's rows to its sink, every sink once for a batch; rows of no given route are an error before anything is written."""
    named = rows.withColumn("_route", route)
    unknown = named.where(~F.coalesce(F.col("_route").isin(*sinks), F.lit(False))).select("_route").first()
    if unknown:
        raise ValueError(f"no sink for route {unknown[0]!r}")
    return {name: sink.append(batch, named.where(F.col("_route") == name).drop("_route"), keys, order) for name, sink in sinks.items()}
