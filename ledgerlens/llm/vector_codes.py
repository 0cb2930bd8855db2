"""Vector codes: each part of a vector becomes the number of its nearest entry in that part's codebook.

Components are whole numbers (floor of 4096 times the component), and so are
entries and squared distances, so codes do not depend on the order of sums. The
entries of each part position stand in a vantage-point tree. A search goes down
the nearer side first and visits a side unless the triangle inequality shows
that all its entries are farther than the best so far: distances and the sides'
radii are whole numbers too, rounded so that the bound is never too high, a side
at exactly the bound is visited, and every entry that is met is compared by its
whole squared distance, ties to the smaller number. So the answer is that of a
comparison with all entries.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import split_join, written

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Components beyond this count as this, so that sums over any table fit 38 digits; no long holds errors of such size.
LARGEST = 2.0**80
#: Errors beyond this count as this.
MOST = (1 << 63) - 1
#: Vectors that a task holds as whole numbers at once.
CHUNK = 16_384


def kept(column: str, width: int | None = None):
    """True for vectors that take part: not null or empty, every component there and finite, of ``width`` components if given."""
    values = F.col(column)
    bad = F.exists(values, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return values.isNotNull() & (F.size(values) > 0 if width is None else F.size(values) == width) & ~bad


def whole_numbers(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x): 64-bit integers where their squared distances surely fit, else Python's own."""
    scaled = np.floor(np.clip(x, -LARGEST, LARGEST) * SCALE)  # a power of two: no rounding
    if not scaled.size or float(np.abs(scaled).max()) < _narrow(x.shape[1]):
        return scaled.astype(np.int64)
    return np.array([[int(c) for c in row] for row in scaled.tolist()], object)


def _narrow(width: int) -> int:
    """Components below this have squared distances over ``width`` components below 2**62."""
    return math.isqrt((1 << 60) // max(1, width))


def roots(squares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The whole roots of whole numbers, rounded down and rounded up."""
    if squares.dtype == object:
        low = np.array([math.isqrt(s) for s in squares], object)
    else:
        low = np.sqrt(squares.astype(np.float64)).astype(np.int64)
        low -= low * low > squares
        low += (low + 1) * (low + 1) <= squares
    return low, low + (low * low != squares)


@dataclass
class Side:
    """The entries on one side of a vantage point: the node that holds them, and bounds of their distances to the point."""

    node: Node
    low: int
    high: int


@dataclass
class Node:
    entry: int
    near: Side | None
    far: Side | None


class VantageTree:
    """The entries of one part position."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.root = self._node(list(range(len(entries))))
        self.visits = 0

    def _node(self, own: list[int]) -> Node:
        point, rest = own[0], own[1:]
        if not rest:
            return Node(point, None, None)
        squares = {k: int(((self.entries[k] - self.entries[point]) ** 2).sum()) for k in rest}
        rest.sort(key=lambda k: (squares[k], k))
        sides = [self._side(some, squares) for some in (rest[: (len(rest) + 1) // 2], rest[(len(rest) + 1) // 2 :])]
        return Node(point, *sides)

    def _side(self, own: list[int], squares: dict[int, int]) -> Side | None:
        if not own:
            return None
        low, high = min(squares[k] for k in own), max(squares[k] for k in own)
        return Side(self._node(sorted(own)), math.isqrt(low), math.isqrt(high) + (math.isqrt(high) ** 2 != high))

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each point's nearest entry, ties to the smaller number, and the squared distance to it."""
        best = ((points - self.entries[self.root.entry]) ** 2).sum(1)
        own = np.full(len(points), self.root.entry, np.int64)
        self.visits += len(points)
        self._below(self.root, points, np.arange(len(points)), best.copy(), best, own)
        return own, best

    def _visit(self, node: Node, points: np.ndarray, rows: np.ndarray, best: np.ndarray, own: np.ndarray) -> None:
        squares = ((points[rows] - self.entries[node.entry]) ** 2).sum(1)
        self.visits += len(rows)
        better = (squares < best[rows]) | (squares == best[rows]) & (node.entry < own[rows])
        best[rows[better]] = squares[better]
        own[rows[better]] = node.entry
        self._below(node, points, rows, squares, best, own)

    def _below(self, node: Node, points: np.ndarray, rows: np.ndarray, squares: np.ndarray, best: np.ndarray, own: np.ndarray) -> None:
        if node.near is None or not len(rows):
            return
        low, high = roots(squares)
        inner = low <= node.near.high
        for some, order in ((inner, (node.near, node.far)), (~inner, (node.far, node.near))):
            at = np.flatnonzero(some)
            for side in order:
                if side is None or not len(at):
                    continue
                bound = roots(best[rows[at]])[1]
                open_ = (low[at] - side.high <= bound) & (side.low - high[at] <= bound)
                self._visit(side.node, points, rows[at[open_]], best, own)


class Codebooks:
    """The entries of every part position: a list of matrices of whole numbers, one for each part."""

    def __init__(self, parts: list[list[list[int]]]):
        width = sum(len(p[0]) for p in parts) if parts else 0
        wide = any(abs(c) >= _narrow(width) for part in parts for entry in part for c in entry)
        self.parts = [np.array(p, object if wide else np.int64) for p in parts]
        self.trees = [VantageTree(p) for p in self.parts]

    def assign(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers (a row for each vector, a column for each part) and squared distances."""
        size = vectors.shape[1] // len(self.parts)
        found = [tree.nearest(np.ascontiguousarray(vectors[:, k * size : (k + 1) * size])) for k, tree in enumerate(self.trees)]
        return np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)

    def text(self) -> str:
        """All entries' components by part, entry and position, in decimals joined by commas."""
        return ",".join(str(c) for part in self.parts for entry in part.tolist() for c in entry)

    def vectors(self, numbers: np.ndarray) -> np.ndarray:
        """The vectors that codes stand for: the middle of each component's cell of width 1/SCALE."""
        whole = np.concatenate([part[numbers[:, k]] for k, part in enumerate(self.parts)], 1)
        return (whole.astype(np.float64) + 0.5) / SCALE


def _matrices(batches: Iterator[pa.RecordBatch], column: int, width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for whole in batches:
        for s in range(0, whole.num_rows, CHUNK):
            batch = whole.slice(s, CHUNK)
            yield batch, batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def first_vectors(vectors: DataFrame, entries: int, width: int) -> list[list[int]]:
    """The vectors of the smallest different ids, as whole numbers; a null id is the last. Of several vectors with one id the smallest is taken.

    Every task gives its own smallest, so few rows are exchanged.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch, x in _matrices(batches, 1, width):
            ids = batch.column(0)
            worst = max(held) if len(held) >= entries else None
            for k in np.lexsort((np.arange(len(ids)), ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False))).tolist():
                own = ids[k].as_py()
                key = (own is None, own or 0)
                if worst is not None and key > worst or len(held) >= entries and key not in held and key > max(held):
                    break
                row = x[k].tolist()
                if key not in held or row < held[key]:
                    held[key] = row
            for key in sorted(held)[entries:]:
                del held[key]
        keys = sorted(held)
        yield pa.RecordBatch.from_arrays([pa.array([None if k[0] else k[1] for k in keys], pa.int64()), pa.array([held[k] for k in keys], pa.list_(pa.float64()))], names=["v", "x"])

    found = vectors.select("v", "x").mapInArrow(run, "v long, x array<double>").groupBy("v").agg(F.min("x").alias("x"))
    rows = found.orderBy(F.col("v").asc_nulls_last()).limit(entries).collect()
    return [[int(c) for c in row] for row in whole_numbers(np.array([r.x for r in rows], np.float64).reshape(-1, width)).tolist()]


def fit(vectors: DataFrame, width: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks of ``parts`` part positions after ``rounds`` rounds over all vectors (v, x).

    A round is one pass over the vectors; every task gives the counts and sums
    of its parts by entry, so what is exchanged is bounded by codebooks and tasks.
    """
    if width % parts:
        raise ValueError(f"vectors of {width} components have no {parts} equal parts")
    size = width // parts
    first = first_vectors(vectors, entries, width)
    books = [[row[k * size : (k + 1) * size] for row in first] for k in range(parts)]

    def totals(sent):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = Codebooks(sent.value)
            counts = np.zeros((parts, len(first)), np.int64)
            sums = np.zeros((parts, len(first), size), object)
            for _, x in _matrices(batches, 0, width):
                vectors = whole_numbers(x)
                numbers = own.assign(vectors)[0]
                for k in range(parts):
                    counts[k] += np.bincount(numbers[:, k], minlength=len(first))
                    for e in np.flatnonzero(np.bincount(numbers[:, k], minlength=len(first))).tolist():
                        sums[k, e] += vectors[numbers[:, k] == e, k * size : (k + 1) * size].sum(0).astype(object)
            seen = np.repeat(counts.ravel() > 0, size)
            places = np.flatnonzero(seen)
            columns = [pa.array(places.astype(np.int32)), pa.array(np.repeat(counts.ravel(), size)[seen]), pa.array([Decimal(int(s)) for s in sums.ravel()[seen]], pa.decimal128(38, 0))]
            yield pa.RecordBatch.from_arrays(columns, names=["place", "n", "total"])

        return run

    for _ in range(rounds):
        sent = vectors.sparkSession.sparkContext.broadcast(books)  # bounded by the entries
        found = vectors.select("x").mapInArrow(totals(sent), "place int, n long, total decimal(38,0)").groupBy("place").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        books = [[list(entry) for entry in part] for part in books]
        for r in found.collect():  # a row for each component of an entry that was used
            part, rest = divmod(r.place, len(first) * size)
            books[part][rest // size][rest % size] = int(r.total) // int(r.n)
    return Codebooks(books)


def coded(vectors: DataFrame, books: Codebooks, width: int, keep: tuple[str, ...] = ("v",)) -> DataFrame:
    """``keep`` columns of every vector (x) with code (two hex digits for each part) and error (squared distances summed over parts)."""
    sent = vectors.sparkSession.sparkContext.broadcast([p.tolist() for p in books.parts])
    digits = np.array([f"{k:02x}" for k in range(256)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Codebooks(sent.value)
        for batch, x in _matrices(batches, 0, width):
            numbers, far = own.assign(whole_numbers(x))
            codes = ["".join(row) for row in digits[numbers].tolist()]
            errors = np.minimum(far.sum(1), MOST).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(codes, pa.string()), pa.array(errors)], names=[*keep, "code", "error"])

    fields = ", ".join(f"{c} {vectors.schema[c].dataType.simpleString()}" for c in keep)
    return vectors.select("x", *keep).mapInArrow(run, f"{fields}, code string, error long")


def compressed(df: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label") -> DataFrame:
    """The code of every vector, with codebooks fitted on all of them.

    Columns: vec_id, code, error (held at the largest long), label_error (error
    summed over all vectors with an equal label, nulls together; held likewise)
    and codebooks_sha256. Vectors that are null, empty, or hold null or
    non-finite components, and those whose length is not the most frequent one
    (ties to the shorter), take no part. Repeated rows count and are returned as
    often as they come; a null id has a code like any other; with fewer than
    ``entries`` different ids, codebooks have that many entries. Other columns
    are ignored. An empty table, or one without a vector that takes part, gives
    an empty result.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits")
    spark = df.sparkSession
    vectors = df.select(F.col(id_column).cast("long").alias("v"), F.col(vector_column).cast("array<double>").alias("x"), F.col(label_column).alias("l"))
    sizes = vectors.where(kept("x")).groupBy(F.size("x").alias("w")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string").withColumnRenamed("vec_id", id_column)
    width = sizes[0].w
    vectors = vectors.where(kept("x", width))
    books = fit(vectors, width, parts, entries, rounds)
    # labels are told apart by their text form, and null by having none
    own = written(coded(vectors, books, width, ("v", "l")).select("v", "code", "error", F.coalesce(F.concat(F.lit("="), F.col("l").cast("string")), F.lit("")).alias("key")), "codes")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(MOST).cast("decimal(38,0)")).cast("long")
    sums = written(own.groupBy("key").agg(total.alias("label_error"), F.count("*").alias("n")), "label-errors")
    digest = hashlib.sha256(books.text().encode()).hexdigest()
    joined = split_join(own, sums, "key", sizes[0].n, ["label_error"])
    return joined.select(F.col("v").alias(id_column), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
