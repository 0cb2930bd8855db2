"""Operators between sets of evaluation records: dedupe, joins, routing, comparison of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlens.sources.ledger import A, B, C, D
from ledgerlens.sources.scratch import written


def dedupe(df: DataFrame, key: str, order: str, keep: str = "first") -> DataFrame:
    """One row of each key: the first or the last by ``order``. As an aggregate, it combines before the shuffle."""
    pick = F.min_by if keep == "first" else F.max_by
    return df.groupBy(key).agg(pick(F.struct(*df.columns), order).alias("_r")).select("_r.*")


def pending(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose run key (nulls equal) is not among those done."""
    match = None
    for k in keys:
        one = rows[k].eqNullSafe(done[k])
        match = one if match is None else match & one
    return rows.join(done, match, "left_anti")


def complement(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows outside a frozen set of ids."""
    return rows.join(ids, key, "left_anti")


def cached_rows(rows: DataFrame, cache: DataFrame, by: str, key: str = "question_id", hashed: str = "question_hash") -> DataFrame:
    """Rows that a cache covers, by id, by hash, or by either. ``either`` asks twice, each by one key, and keeps a row if one says yes."""
    if by != "either":
        return rows.join(cache, key if by == "id" else hashed, "left_semi")
    one = cache.select(key).distinct().withColumn("_one", F.lit(True))
    two = cache.select(hashed).distinct().withColumn("_two", F.lit(True))
    return rows.join(one, key, "left").join(two, hashed, "left").where("_one or _two").select(*rows.columns)


def looked_up(rows: DataFrame, cache: DataFrame, value: str, order: str, key: str = "question_id", hashed: str = "question_hash") -> DataFrame:
    """A cached value by id, else by hash; of several cached rows the last by ``order`` holds."""
    by_id = cache.groupBy(key).agg(F.max_by(value, order).alias("_a"))
    by_hash = cache.groupBy(hashed).agg(F.max_by(value, order).alias("_b"))
    found = rows.join(by_id, key, "left").join(by_hash, hashed, "left")
    return found.withColumn(value, F.coalesce("_a", "_b")).drop("_a", "_b")


def route(group: Column) -> Column:
    """Where a group's rows go on: to verification, repair, or nowhere. Reading the route of an unknown or null group fails."""
    unknown = F.raise_error(F.concat(F.lit("unknown evaluation group: "), F.coalesce(group, F.lit("null")))).cast("string")
    return F.when(group.isin(A, B), "verify").when(group == C, "repair").when(group == D, "skip").otherwise(unknown)


#: From here on a double has no sixth decimal to round.
_COARSE = float(1 << 33)


def round6(x: Column) -> Column:
    """A double rounded to six decimals by its exact value, ties to even, with built-in arithmetic alone.

    ``x * 10**6`` is taken as a product and its rounding error (by splitting the
    factors in halves), so the fraction that decides is exact.
    """
    scale, split = 1e6, float((1 << 27) + 1)
    low = lambda v: v - (v * split - (v * split - v))  # noqa: E731  the lower half of a double's digits
    size = F.abs(x)
    product = size * scale
    scale_low = float(scale - (scale * split - (scale * split - scale)))
    scale_high = scale - scale_low
    x_low = low(size)
    x_high = size - x_low
    error = ((x_high * scale_high - product) + x_high * scale_low + x_low * scale_high) + x_low * scale_low
    whole = F.floor(product)
    rest = (product - whole) - 0.5 + error
    up = (rest > 0) | ((rest == 0) & (whole % 2 == 1))
    rounded = (whole + F.when(up, 1).otherwise(0)).cast("double") / scale
    return F.when(size < _COARSE, F.when(x < 0, -rounded).otherwise(rounded)).otherwise(x)


NUMBERS = ("byte", "short", "integer", "long", "float", "double", "boolean")


def cell(column: Column, kind: str) -> Column:
    """A value as text that says its kind: numbers of all types are one kind, truths count as 0 and 1, dates are text."""
    if kind == "boolean":
        column, kind = column.cast("int"), "integer"
    if kind in ("byte", "short", "integer", "long"):
        return F.concat(F.lit("n:"), column.cast("string"))
    if kind in ("float", "double") or kind.startswith("decimal"):
        x = round6(column.cast("double"))
        whole = (x == F.floor(x)) & (F.abs(x) < 1e15)
        return F.concat(F.lit("n:"), F.when(whole, F.floor(x).cast("string")).otherwise(x.cast("string")))
    if kind == "binary":
        return F.concat(F.lit("b:"), F.hex(column))
    if kind in ("struct", "array", "map"):
        return F.concat(F.lit("t:"), F.to_json(column))
    return F.concat(F.lit("t:"), column.cast("string"))


def canonical(df: DataFrame, columns: bool = False) -> DataFrame | list[Column]:
    """Columns by position, each value as text with its kind; null stays null. With ``columns`` only the expressions, over ``c0``, ``c1``, ..."""
    cells = [cell(F.col(f"c{n}"), f.dataType.typeName()) for n, f in enumerate(df.schema)]
    return cells if columns else df.toDF(*[f"c{n}" for n in range(len(cells))]).select(*[c.alias(f"c{n}") for n, c in enumerate(cells)])


def row_hash(seed: int, *columns: str) -> Column:
    """A 64-bit hash of a row that tells null from any value."""
    marked = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in columns]
    return F.xxhash64(F.lit(seed), *marked)


def result_digest(*columns: str) -> Column:
    """An aggregate that is the same for the same bag of rows: their number and the sums of two hashes, which combine before any shuffle."""
    total = lambda seed: F.coalesce(F.sum(row_hash(seed, *columns).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).cast("string")
    return F.concat_ws(":", F.count("*").cast("string"), total(1), total(2))


#: Buckets of a level of a digest tree.
BUCKETS = 1024


def unequal_rows(left: DataFrame, right: DataFrame, buckets: int = BUCKETS, levels: int = 2) -> DataFrame:
    """Canonical rows whose counts differ, with the difference, as ``bag_difference`` gives them, by a tree of digests.

    Each level deals the rows of the buckets that still differ over ``buckets``
    finer ones each and compares their digests, a row for each bucket; only rows
    of the last level's unequal buckets are exchanged. A level at which all
    buckets differ narrows nothing.
    """
    a, b = canonical(left), canonical(right)
    if len(a.columns) != len(b.columns):
        raise ValueError("the results differ in their number of columns")
    names = a.columns
    both = a.withColumn("_w", F.lit(1)).unionByName(b.withColumn("_w", F.lit(-1)))
    narrowed = both
    for level in range(levels):
        bucket = F.pmod(row_hash(100 + level, *names), F.lit(buckets)).cast("int")
        signed = [F.sum(row_hash(seed, *names).cast("decimal(38,0)") * F.col("_w")) for seed in (1, 2)]
        sums = narrowed.groupBy(bucket.alias("_b")).agg(F.sum("_w").alias("n"), *[s.alias(f"s{k}") for k, s in enumerate(signed)])
        open_ = [r._b for r in sums.where("n <> 0 OR s0 <> 0 OR s1 <> 0").select("_b").collect()]  # at most ``buckets`` numbers
        if not open_:
            return both.where(F.lit(False)).groupBy(*names).agg(F.sum("_w").alias("surplus"))
        if len(open_) < buckets:
            narrowed = narrowed.where(bucket.isin(open_) if len(open_) <= 32 else F.array_contains(F.lit(open_), bucket))
    return narrowed.groupBy(*names).agg(F.sum("_w").alias("surplus")).where("surplus <> 0")


def bag_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Canonical rows whose counts differ, with the difference; one shuffle for both sides."""
    a, b = canonical(left), canonical(right)
    if len(a.columns) != len(b.columns):
        raise ValueError("the results differ in their number of columns")
    both = a.withColumn("_w", F.lit(1)).unionByName(b.withColumn("_w", F.lit(-1)))
    return both.groupBy(*a.columns).agg(F.sum("_w").alias("surplus")).where("surplus <> 0")


def bags_equal(left: DataFrame, right: DataFrame) -> bool:
    """Equality of two results as bags of rows, whatever their column names: their digests are compared, one row each."""
    if len(left.columns) != len(right.columns):
        return False
    one, two = (canonical(x).agg(result_digest(*[f"c{n}" for n in range(len(x.columns))]).alias("d")).first().d for x in (left, right))
    return one == two


def numbered(df: DataFrame, name: str = "at") -> DataFrame:
    """Rows with their place, from 0, in the order that ``df`` has; rows are not gathered.

    The rows are written once, so that their places hold; partitions are counted
    and each begins after the rows of those before it (a row for each partition).
    """
    part, row = F.shiftright("_row", 33), F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))
    placed = written(df.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    order = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(order), F.lit(0)).alias("_start"))
    return placed.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + row).drop("_row", "_part", "_start")


def ordered_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Places at which two ordered results differ, or only one has a row: place, and the rows as arrays."""
    if len(left.columns) != len(right.columns):
        raise ValueError("the results differ in their number of columns")
    rows = lambda df, name: numbered(canonical(df)).select("at", F.array(*[c for c in canonical(df).columns]).alias(name))
    return rows(left, "left").join(rows(right, "right"), "at", "full").where(~F.col("left").eqNullSafe(F.col("right")))


def raw_equal(left: DataFrame, right: DataFrame) -> bool:
    """Equality row by row as the values stand, without rounding; numbers of all types are one kind."""
    if len(left.columns) != len(right.columns):
        return False
    exact = lambda df: df.toDF(*[f"c{n}" for n in range(len(df.columns))]).select(*[_exact(F.col(f"c{n}"), f.dataType.typeName()).alias(f"c{n}") for n, f in enumerate(df.schema)])
    a, b = (numbered(exact(x)) for x in (left, right))
    same = F.lit(True)
    for c in (c for c in a.columns if c != "at"):
        same = same & a[c].eqNullSafe(b[c])
    return a.join(b, a["at"].eqNullSafe(b["at"]) & same, "full").where(a["at"].isNull() | b["at"].isNull()).isEmpty()


def _exact(column: Column, kind: str) -> Column:
    if kind == "boolean":
        column, kind = column.cast("int"), "integer"
    if kind in NUMBERS or kind.startswith("decimal"):
        whole = column.cast("double") == F.floor(column.cast("double"))
        return F.concat(F.lit("n:"), F.when(whole, column.cast("decimal(38,0)").cast("string")).otherwise(column.cast("double").cast("string")))
    return F.concat(F.lit("t:"), column.cast("string"))
