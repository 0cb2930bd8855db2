"""Bit sets of keys: they say surely that a key was not seen, they merge, and their size is bounded."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: 64-bit words of a set at most, and bits that a key sets.
WORDS, HASHES = 1 << 18, 3


def _hash(keys: list[str], k: int) -> Column:
    return F.xxhash64(F.lit(k), *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in keys])


def bits_of(df: DataFrame, keys: list[str]) -> DataFrame:
    """The set of a table's keys: (place, bits), a row for each word that has a bit."""
    hashes = df.select(F.explode(F.array(*[_hash(keys, k) for k in range(HASHES)])).alias("h"))
    place = F.pmod(F.shiftright("h", 6), F.lit(WORDS)).alias("place")
    return hashes.groupBy(place).agg(F.bit_or(F.expr("shiftleft(1L, CAST(h & 63 AS INT))")).alias("bits"))


def merged(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Written sets as one."""
    return spark.read.schema("place long, bits long").parquet(*paths).groupBy("place").agg(F.bit_or("bits").alias("bits"))


def maybe_marked(df: DataFrame, keys: list[str], marks: DataFrame, name: str) -> DataFrame:
    """``df`` with a boolean ``name``: false only where the set surely lacks the key. The set is broadcast, ``WORDS`` rows at most."""
    found = []
    for k in range(HASHES):
        own = marks.select(F.col("place").alias(f"__p{k}"), F.col("bits").alias(f"__b{k}"))
        df = df.withColumn(f"__h{k}", _hash(keys, k))
        df = df.join(F.broadcast(own), F.pmod(F.shiftright(f"__h{k}", 6), F.lit(WORDS)) == F.col(f"__p{k}"), "left")
        found.append(F.coalesce(F.expr(f"(shiftrightunsigned(__b{k}, CAST(__h{k} & 63 AS INT)) & 1L) = 1"), F.lit(False)))
    return df.withColumn(name, reduce(lambda a, b: a & b, found)).drop(*[f"__{c}{k}" for k in range(HASHES) for c in "hpb"])
