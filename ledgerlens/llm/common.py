"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlens.sources.scratch import forget, fresh_path, shared_dir, written  # noqa: F401 - the operators take all helpers from here

_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)

#: Rows of one key from which on ``split_join`` takes it out of the shuffle, at least.
HEAVY = 1000


def split_join(many: DataFrame, one: DataFrame, key: str, rows: int, columns: list[str]) -> DataFrame:
    """Inner join of ``many`` with ``columns`` of ``one``, which has one row for each key and in ``n`` the key's rows in ``many``.

    Keys with over a thousandth of all ``rows`` rows (so at most a thousand of
    them) are broadcast, and their rows stay where they are; the rest is shuffled.
    """
    heavy = one.where(F.col("n") > max(HEAVY, rows // 1000)).select(key, *columns).collect()
    if not heavy:
        return many.join(one.select(key, *columns), key)
    hot = many.sparkSession.createDataFrame(heavy, one.select(key, *columns).schema)
    rest = many.join(F.broadcast(hot.select(key)), key, "left_anti").join(one.select(key, *columns), key)
    return many.join(F.broadcast(hot), key).unionByName(rest)


#: 64-bit words of a set of marks: its size, however much is in it.
MARK_WORDS = 1 << 19


def marks_of(keys: DataFrame, column: str) -> DataFrame:
    """The hashes in a long column as a bit set of ``MARK_WORDS`` words at most: (place, bits)."""
    place = F.pmod(F.shiftright(column, 6), F.lit(MARK_WORDS)).alias("place")
    return keys.select(place, F.expr(f"shiftleft(1L, CAST(`{column}` & 63 AS INT))").alias("bit")).groupBy("place").agg(F.bit_or("bit").alias("bits"))


def with_mark(df: DataFrame, marks: DataFrame, column: str, name: str) -> DataFrame:
    """``df`` with a boolean ``name``: false only where the hash in ``column`` is not in the set. The set is bounded and broadcast."""
    own = marks.select(F.col("place").alias("__place"), F.col("bits").alias("__bits"))
    joined = df.join(F.broadcast(own), F.pmod(F.shiftright(df[column], 6), F.lit(MARK_WORDS)) == own["__place"], "left")
    bit = F.expr(f"shiftrightunsigned(__bits, CAST(`{column}` & 63 AS INT)) & 1L") == 1
    return joined.withColumn(name, F.coalesce(bit, F.lit(False))).drop("__place", "__bits")


def clear_of(df: DataFrame, names: list[str]) -> DataFrame:
    """Renames input columns that clash with an operator's own output: ``x`` becomes ``x_in``."""
    taken = {n.lower() for n in names}
    held = {c.lower() for c in df.columns} | taken
    for column in df.columns:
        if column.lower() in taken:
            new = f"{column}_in"
            while new.lower() in held:
                new += "_in"
            held.add(new.lower())
            df = df.withColumnRenamed(column, new)
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: str, folds: int):
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % F.lit(folds)


#: Draws are hashes of whole rows, so that rows that share an id are drawn each by itself, from 0 to this.
DRAWS = 1 << 30


def draw_of(name: str, *columns: str):
    """A row's draw, from 0 to ``DRAWS``."""
    return F.pmod(F.xxhash64(F.lit(name), *columns), F.lit(DRAWS))


def share_of(wanted: int, rows: int) -> int:
    """Draws below this leave about ``wanted`` of ``rows`` rows."""
    return min(DRAWS, int(DRAWS * wanted / max(1, rows)) + 1)


def bounded_rows(rows: DataFrame, group: str, draw: str, text: str, most: int, most_bytes: int, least: int = 2) -> DataFrame:
    """Of each group's rows, in order of their draw, those up to ``most`` rows or the one that reaches ``most_bytes`` bytes of text, and ``least`` rows at least.

    No row is left out for its length. Rows with one draw are repeated rows and
    count once. ``rows`` must be drawn already: the sizes of a group's rows are
    sorted in one task, without the texts.
    """
    sizes = rows.groupBy(group, draw).agg(F.max(F.octet_length(text)).alias("bytes"), F.count("*").alias("n"))
    order = Window.partitionBy(group).orderBy(draw)
    before = F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, -1))
    ranked = sizes.select(group, draw, "n", F.row_number().over(order).alias("rank"), F.coalesce(before, F.lit(0)).alias("before"))
    ranked = ranked.where((F.col("rank") <= least) | (F.col("rank") <= most) & (F.col("before") < most_bytes)).select(group, draw, "n")
    chosen = ranked.collect()  # at most ``most`` rows of each group, without texts
    own = rows.sparkSession.createDataFrame(chosen, ranked.schema)
    out = rows.join(F.broadcast(own.where("n = 1").drop("n")), [group, draw], "left_semi")
    if any(r.n > 1 for r in chosen):
        out = out.unionByName(rows.join(F.broadcast(own.where("n > 1").drop("n")), [group, draw], "left_semi").dropDuplicates([group, draw]))
    return out


#: Characters of texts (in bytes) that a worker turns into Python strings at once.
PART_BYTES = 1 << 19


def text_parts(batch: pa.RecordBatch, column: str, part_bytes: int = PART_BYTES) -> Iterator[tuple[int, list[str]]]:
    """The texts of an Arrow batch in runs of about ``part_bytes`` (a longer text is a run of its own), each with its first row; null counts as empty.

    At the end of a batch the worker gives free memory back, as workers live on and share a machine.
    """
    own = batch.column(batch.schema.get_field_index(column))
    ends = np.cumsum(pc.fill_null(pc.binary_length(own), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < len(own):
        before = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, before + part_bytes, "right")))
        yield begin, [t or "" for t in own.slice(begin, end - begin).to_pylist()]
        begin = end
    del own
    give_back()


def give_back() -> None:
    """Returns free memory of the Arrow pool and of the C library to the system."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """The texts of an Arrow batch; null counts as empty."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(column)).to_pylist()]
