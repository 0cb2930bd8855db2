"""Uniform shuffle of a table into shards of exact sizes (law ``rows``: counts at most one apart).

How many rows each input partition sends to each shard is one draw of a
communication matrix with fixed row sums (partition sizes) and column sums
(shard sizes): a multivariate hypergeometric law. Each partition permutes its
own rows to hand out its row of the matrix, the rows are exchanged once, and
each shard permutes what it received. Every arrangement of the rows is equally
likely, up to the pseudo-random generator.

The matrix is never held: halves of the partitions split the shards' room by a
hypergeometric draw seeded by the half, down to the single partition, so each
task draws its own row from the partition sizes alone. Shards over
``ROWS`` rows are made of equal sub-shards, so no task sorts more rows than that.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlens.llm.common import clear_of, written

SHARDS = 40
SEED = 20240607
#: Rows that one task permutes after the exchange.
ROWS = 100_000
#: From so many rows on, numpy draws no hypergeometric numbers.
_NUMPY_LIMIT = 10**9


def hypergeometric(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """A hypergeometric number of any size, by ratio of uniforms."""
    if good + bad < _NUMPY_LIMIT:
        return int(rng.hypergeometric(good, bad, sample))
    total = good + bad
    low, high = max(0, sample - bad), min(good, sample)
    if low == high:
        return low
    mean = sample * good / total
    spread = math.sqrt(mean * (bad / total) * ((total - sample) / max(1, total - 1)) + 0.5)
    mode = min(high, max(low, (sample + 1) * (good + 1) // (total + 2)))

    def weight(k: int) -> float:
        return -(math.lgamma(k + 1) + math.lgamma(good - k + 1) + math.lgamma(sample - k + 1) + math.lgamma(bad - sample + k + 1))

    # the hat's width for any log-concave law: 2 sqrt(2/e) deviations, and 3 - 2 sqrt(3/e)
    width = 2 * math.sqrt(2 / math.e) * spread + 3 - 2 * math.sqrt(3 / math.e)
    top = weight(mode)
    while True:
        u, v = 1.0 - rng.random(), rng.random()
        x = mean + 0.5 + width * (v - 0.5) / u
        if low <= x < high + 1 and 2 * math.log(u) <= weight(int(x)) - top:
            return int(x)


def split_room(rng: np.random.Generator, room: np.ndarray, rows: int) -> np.ndarray:
    """How many of ``rows`` rows, drawn without return, fall to each shard's room."""
    left = int(room.sum())
    if left < _NUMPY_LIMIT:
        return rng.multivariate_hypergeometric(room, rows, method="marginals")
    out = np.zeros_like(room)
    for k, own in enumerate(room.tolist()):
        left -= own
        out[k] = hypergeometric(rng, own, left, rows)
        rows -= int(out[k])
    return out


def matrix_row(before: np.ndarray, room: np.ndarray, part: int, seed: int) -> np.ndarray:
    """Row ``part`` of the communication matrix. ``before``: running sums of the partition sizes, from 0."""
    low, high = 0, len(before) - 1
    while high - low > 1:
        middle = (low + high) // 2
        first = split_room(np.random.default_rng([seed, low, high]), room, int(before[middle] - before[low]))
        if part < middle:
            room, high = first, middle
        else:
            room, low = room - first, middle
    return room


def shard_sizes(rows: int, shards: int) -> np.ndarray:
    return rows // shards + (np.arange(shards) < rows % shards)


def shuffled_shards(df: DataFrame, shards: int = SHARDS, seed: int = SEED, rows_per_task: int = ROWS, is_scan: bool = False) -> DataFrame:
    """All rows and columns of ``df`` with ``shard`` (0 to ``shards`` - 1) and ``slot`` (gapless from 0 in each shard).

    Shard counts differ by at most one. Repeated rows, null ids and nulls
    anywhere are rows like others, as nothing is dealt by a column's value. A
    column of ``df`` named shard or slot becomes shard_in or slot_in. An empty
    table gives an empty result.

    ``df`` is read twice (the first time for partition sizes alone), so its
    partitions must come out the same: say ``is_scan`` for a plain table scan;
    anything else is first written to the shared folder. A row beyond its
    partition's counted size stops the job, never bends the result. As the
    result is read later, the number of pieces that scans are split by stays
    pinned in the session, if nobody has set it.
    """
    spark = df.sparkSession
    if spark.conf.get("spark.sql.leafNodeDefaultParallelism", None) is None:
        # how a scan is split must not follow executors that come or go between the two reads
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", spark.sparkContext.defaultParallelism)
    if not is_scan:
        df = written(df, "shard-input")
    df = clear_of(df, ["shard", "slot", "_row", "_part"])
    found = dict(map(tuple, df.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()))
    sizes = np.array([found.get(p, 0) for p in range(max(found, default=0) + 1)], np.int64)
    rows = int(sizes.sum())
    parts = max(1, -(-rows // (shards * rows_per_task)))
    whole = shard_sizes(rows, shards)
    room = np.concatenate([shard_sizes(int(n), parts) for n in whole])
    sent = spark.sparkContext.broadcast(np.r_[0, np.cumsum(sizes)])  # a number for each input partition

    @F.pandas_udf("int")
    def target(ids: Iterator[pd.Series]) -> Iterator[pd.Series]:
        held, dealt = -1, np.empty(0, np.int32)
        for series in ids:
            out = np.empty(len(series), np.int32)
            values = series.to_numpy()
            own, at = values >> 33, values & ((1 << 33) - 1)
            for part in np.unique(own).tolist():
                if part != held:
                    before = sent.value
                    if part >= len(before) - 1:
                        raise RuntimeError("the input was split anew between two reads; write it to a table first")
                    dealt = np.repeat(np.arange(len(room), dtype=np.int32), matrix_row(before, room, part, seed))
                    dealt, held = np.random.default_rng([seed, 1, part]).permutation(dealt), part
                here = own == part
                if at[here].max() >= len(dealt):
                    raise RuntimeError("the input was split anew between two reads; write it to a table first")
                out[here] = dealt[at[here]]
            yield pd.Series(out)

    marked = df.withColumn("_row", F.monotonically_increasing_id())
    marked = marked.withColumn("_part", target("_row"))
    met = marked.repartitionById(len(room), F.col("_part"))
    order = Window.partitionBy("_part").orderBy(F.xxhash64(F.lit(seed), "_row"), "_row")
    shard, sub = F.floor(F.col("_part") / F.lit(parts)), F.col("_part") % F.lit(parts)
    own = F.lit(rows // shards) + F.when(shard < F.lit(rows % shards), 1).otherwise(0)
    begin = sub * F.floor(own / F.lit(parts)) + F.least(sub, own % F.lit(parts))
    out = met.withColumn("slot", F.row_number().over(order) - 1 + begin).withColumn("shard", shard.cast("int"))
    return out.withColumn("slot", F.col("slot").cast("long")).drop("_row", "_part")


def write_shards(sharded: DataFrame, path: str) -> None:
    """Writes one folder for each shard, rows in order of slot."""
    sharded.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def shard_digest(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", shards: int = SHARDS, seed: int = SEED, is_scan: bool = False) -> DataFrame:
    """The sharded rows by id, size (UTF-8 bytes of the text, null: none, plus 16), text_crc32 (null as empty), law, shard, slot, grown_shard (null)."""
    out = shuffled_shards(df.select(F.col(id_column), F.col(text_column)), shards, seed, is_scan=is_scan)
    size = F.coalesce(F.octet_length(text_column), F.lit(0)).cast("long") + 16
    crc = F.crc32(F.coalesce(F.col(text_column), F.lit("")).cast("binary"))
    return out.select(F.col(id_column), size.alias("size"), crc.alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
