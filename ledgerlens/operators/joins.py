"""Joins beyond equality, and joins whose keys are uneven."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of one key from which on it is dealt over several tasks, at least; and keys of a side that can be so at most.
HEAVY, KEYS = 10_000, 1000


def _hot(df: DataFrame, keys: list[str], heavy: int, name: str) -> DataFrame:
    """Keys with more rows than ``heavy`` and than a thousandth of all (so a thousand at most), and over how many parts to deal them."""
    counts = df.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])).groupBy(*keys).agg(F.count("*").alias("n"))
    bound = max(heavy, df.count() // KEYS)
    return counts.where(F.col("n") > bound).select(*keys, F.ceil(F.col("n") / bound).cast("int").alias(name))


def even_left_join(left: DataFrame, right: DataFrame, keys: list[str], heavy: int = HEAVY) -> DataFrame:
    """``left.join(right, keys, "left")`` with hot keys of either side dealt over several tasks.

    A hot key's rows are dealt over as many parts as it has times the bound, and
    the other side's rows of that key go to each part. A key that is hot on the
    right is there, so its left rows need no outer join, which a part without a
    match would otherwise end wrongly. Nulls match nothing.
    """
    spark = left.sparkSession
    hot = _hot(left, keys, heavy, "_a").join(_hot(right, keys, heavy, "_b"), keys, "full")
    rows = hot.select(*keys, F.coalesce("_a", F.lit(1)).alias("_a"), F.coalesce("_b", F.lit(1)).alias("_b")).collect()  # at most twice ``KEYS`` keys
    if not rows:
        return left.join(right, keys, "left")
    table = F.broadcast(spark.createDataFrame(rows, left.select(*keys, F.lit(1).alias("_a"), F.lit(1).alias("_b")).schema))

    def dealt(df: DataFrame, own: str, other: str, place: str, copy: str) -> DataFrame:
        marked = df.join(table, keys, "left").withColumns({"_a": F.coalesce("_a", F.lit(1)), "_b": F.coalesce("_b", F.lit(1))})
        spread = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col(own)).cast("int")
        return marked.withColumn(place, spread).withColumn(copy, F.explode(F.sequence(F.lit(0), F.col(other) - 1)))

    one, two = dealt(left, "_a", "_b", "_i", "_j"), dealt(right, "_b", "_a", "_j", "_i").drop("_a", "_b")
    on = [*keys, "_i", "_j"]
    rare = one.where("_b = 1").join(two, on, "left")
    common = one.where("_b > 1").join(two, on)
    return rare.unionByName(common).drop("_a", "_b", "_i", "_j")


def within(points: DataFrame, ranges: DataFrame, keys: list[str], at: str, begin: str, end: str, width: int) -> DataFrame:
    """Points (whole numbers or days in ``at``) with the ranges of their key that hold them, both ends included.

    Ranges are cut into bins of ``width``; a point meets the ranges of its bin by equality.
    """
    number = lambda df, c: F.datediff(F.col(c), F.lit("1970-01-01")) if df.schema[c].dataType.typeName() == "date" else F.col(c)
    bins = F.sequence(F.floor(number(ranges, begin) / width), F.floor(number(ranges, end) / width))
    cut = ranges.where(F.col(begin) <= F.col(end)).withColumn("_bin", F.explode(bins))
    return points.withColumn("_bin", F.floor(number(points, at) / width)).join(cut, [*keys, "_bin"]).where(F.col(at).between(F.col(begin), F.col(end))).drop("_bin")


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, values: list[str], bin_of: Column) -> DataFrame:
    """Each left row with the last right row of its key at or before its time: ``values``, null without one.

    Both sides lie in one table by key and bin of time, so a key's rows are
    sorted bin by bin, not all in one task; what a bin begins with is the last
    value of the bins before it, a row for each key and bin. Of right rows at one time the one with the largest values counts.
    """
    struct = F.struct(*[F.col(v) for v in values])
    both = left.withColumn("_v", F.lit(None).cast(right.select(struct.alias("s")).schema["s"].dataType)).withColumn("_left", F.lit(1))
    extra = [c for c in left.columns if c not in (*keys, at)]
    other = right.select(*keys, at, struct.alias("_v"), F.lit(0).alias("_left"), *[F.lit(None).cast(left.schema[c].dataType).alias(c) for c in extra])
    both = both.unionByName(other).withColumn("_bin", bin_of)
    inside = Window.partitionBy(*keys, "_bin").orderBy(at, "_left", "_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = both.withColumn("_own", F.last("_v", ignorenulls=True).over(inside))
    ends = other.withColumn("_bin", bin_of).groupBy(*keys, "_bin").agg(F.max(F.struct(F.col(at), F.col("_v"))).alias("_e"))
    bins = both.select(*keys, "_bin").distinct().join(ends, [*keys, "_bin"], "left")
    before = F.last("_e", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1))
    carried = bins.select(*keys, "_bin", before.alias("_c"))
    found = held.where("_left = 1").join(carried, [*keys, "_bin"], "left")
    return found.select(*left.columns, *[F.coalesce(F.col(f"_own.{v}"), F.col(f"_c._v.{v}")).alias(v) for v in values])
