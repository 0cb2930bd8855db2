"""A Parquet sink that takes every batch once, whatever fails between its steps.

A batch is written to a folder of its own first; then one small file, made only
if it is not there, enters the folder in the log under the batch's number.
Readers see the folders of the log alone. If a driver is lost between the two
steps, the folder stays unseen, and the batch, given again, is written anew; a
batch that is in the log adds nothing.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.operators.dataflow import pending
from ledgerlens.operators.marks import bits_of, maybe_marked, merged
from ledgerlens.sources.scratch import remove


class Sink:
    """A sink at ``path``, in any file system that makes a new file atomically."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def log(self) -> dict[int, dict]:
        """The batches that were taken, by number: folder and how many rows it has."""
        if not self._fs.exists(self._at("log")):
            return {}
        out = {}
        for status in self._fs.listStatus(self._at("log")):
            stream = self._fs.open(status.getPath())
            try:
                text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            if text:  # an empty file is one whose writer was lost: the batch is not taken
                out[int(status.getPath().getName())] = json.loads(text)
        return out

    def _enter(self, batch: int, entry: dict) -> bool:
        """Enters a batch in the log; False if another driver has done so."""
        target, staged = self._at(f"log/{batch}"), self._at(f"entries/{uuid.uuid4().hex}")
        self._fs.mkdirs(self._at("log"))
        stream = self._fs.create(staged, False)
        try:
            stream.write(json.dumps(entry).encode())
        finally:
            stream.close()
        if self._fs.exists(target) or not self._fs.rename(staged, target):
            self._fs.delete(staged, False)
            return False
        return True

    def rows(self, schema, upto: int | None = None) -> DataFrame:
        """All rows taken, of batches up to a number if one is given, each with its batch in ``_batch``."""
        out = self.spark.createDataFrame([], schema).withColumn("_batch", F.lit(0).cast("long"))
        folders = [(b, e) for b, e in sorted(self.log().items()) if upto is None or b <= upto]
        if not folders:
            return out
        names = self.spark.createDataFrame([(b, e["folder"]) for b, e in folders], "_batch long, _folder string")
        read = self.spark.read.schema(schema).parquet(*[f"{self.path}/{e['folder']}" for _, e in folders])
        folder = F.regexp_extract(F.col("_metadata.file_path"), r"/(data/[^/]+)/[^/]+$", 1)
        return read.select("*", folder.alias("_folder")).join(F.broadcast(names), "_folder").drop("_folder")  # a row for each batch

    def append(self, batch: int, rows: DataFrame, keys: list[str] | None = None, order: str | None = None) -> bool:
        """Takes a batch of rows; False if it was taken before.

        With ``keys`` (nulls equal), only rows whose key no earlier batch has are
        taken, and of rows with one key the first by ``order`` (else any). A bit
        set of the keys is kept with every batch; only rows that it may hold are
        compared with the sink's rows.
        """
        log = self.log()
        if batch in log:
            return False
        folder = f"data/{batch}-{uuid.uuid4().hex}"
        if keys:
            first = F.min_by(F.struct(*rows.columns), order or F.lit(0)).alias("r")
            rows = rows.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(first).select("r.*")
            if log:
                marks = merged(self.spark, [f"{self.path}/{e['folder'].replace('data/', 'keys/', 1)}" for e in log.values()])
                rows = maybe_marked(rows, keys, marks, "__maybe")
                fresh = rows.where("NOT __maybe").drop("__maybe")
                rows = fresh.unionByName(pending(rows.where("__maybe").drop("__maybe"), self.rows(rows.drop("__maybe").schema).select(*keys), keys))
        rows.write.parquet(f"{self.path}/{folder}")
        taken = self.spark.read.schema(rows.schema).parquet(f"{self.path}/{folder}")
        if keys:
            bits_of(taken, keys).write.parquet(f"{self.path}/{folder.replace('data/', 'keys/', 1)}")
        return self._enter(batch, {"folder": folder, "rows": taken.count()})

    def vacuum(self) -> int:
        """Removes folders that no log entry names (not while a batch is being written); their number."""
        known = {e["folder"].split("/")[1] for e in self.log().values()}
        gone = 0
        for part in ("data", "keys", "entries"):
            if self._fs.exists(self._at(part)):
                for status in self._fs.listStatus(self._at(part)):
                    if status.getPath().getName() not in known:
                        remove(self.spark, status.getPath().toString())
                        gone += part == "data"
        return gone
