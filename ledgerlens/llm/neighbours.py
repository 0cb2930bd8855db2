"""Nearest neighbours by an adaptive dimension scan in probed lists.

Centroids of a bounded sample part the vectors into lists. All vectors are
turned by one random rotation, after which the squared distance over the first
d of D dimensions estimates the whole one. A list's vectors lie in blocks of
columns; the queries that probe a list scan it block by block, and after each
block the pairs whose partial distance shows, by a hypothesis test, that the
vector is farther than the query's tenth nearest so far are abandoned. What
remains has its exact distance computed from the original vectors in double
precision.

A query probes lists by one rule at every size. Around a list's centroid, the
squared distances of its vectors to the query are nearly normal; with mean and
variance of every list counted over all its vectors, this tells how many of the
query's neighbours each list holds. Lists are probed, best first, until those
left out hold less than ``MISSED`` of them by expectation: few lists where the
vectors form clusters, many where they do not.

The sample serves the centroids, and each query's first bound: the distance of
the tenth nearest of the sample's vectors in the lists that it probes. Every
vector is in a list and is searched.

Lists lie in cells of about equal size: short lists share one, a long list is
dealt over several. Vectors go to their cells, and a query to every cell that
holds a list it probes, with the numbers of these lists; so no query passes
through the driver, and the vectors are read and exchanged once. A task holds
the vectors of one cell at a time and takes its queries as they come, so its
memory does not grow with them. A cell returns only what lies within a query's
bound, ten at most, and the ten nearest of all cells are the answer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlens.llm.common import written

#: Vectors that the centroids are fitted on, at most about this many.
SAMPLE = 16_384
#: Lists: the root of the number of vectors, at most this many.
MOST_LISTS = 4096
#: Share of a query's neighbours that the lists it does not probe may hold, by expectation.
MISSED = 0.04
#: Vectors of a cell at most (but for chance), cells at least, queries that a task searches for at once, and pairs of one step.
CHUNK, CELLS, QUERIES, PAIRS = 65_536, 64, 4096, 1 << 20
#: Columns of one block, and the test's confidence (deviations).
COLUMNS, EPSILON = 16, 2.1
SEED = 29


def usable(column: str):
    """True for vectors that take part: not null or empty, every component finite, not all zero."""
    values = F.col(column)
    bad = F.exists(values, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return values.isNotNull() & (F.size(values) > 0) & ~bad & F.exists(values, lambda x: x != 0)


def squares(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``left`` to all of ``right``."""
    return np.maximum((left**2).sum(1)[:, None] + (right**2).sum(1)[None, :] - 2 * left @ right.T, 0)


@dataclass
class Lists:
    """Centroids, the rotation of all vectors, and the sample with its ids and lists."""

    centroids: np.ndarray
    rotation: np.ndarray
    sample: np.ndarray
    sample_ids: np.ndarray
    sample_lists: np.ndarray


def fit_lists(sample: np.ndarray, ids: np.ndarray, lists: int, rounds: int = 8, seed: int = SEED) -> Lists:
    """k-means over a sample, and a random rotation."""
    rng = np.random.default_rng(seed)
    sample = sample.astype(np.float64)
    width = sample.shape[1]
    centres = sample[np.sort(rng.permutation(len(sample))[: min(lists, len(sample))])].copy()
    for _ in range(rounds):
        own = nearest_of(sample, centres)[0]
        counts = np.bincount(own, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, own, sample)
        centres[counts > 0] = total[counts > 0] / counts[counts > 0][:, None]
    q, r = np.linalg.qr(rng.standard_normal((width, width)))
    return Lists(centres, q * np.sign(np.diag(r)), sample, ids, nearest_of(sample, centres)[0])


def nearest_of(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each vector's nearest centroid and the squared distance to it."""
    own, far = np.empty(len(x), np.int64), np.empty(len(x))
    for s in range(0, len(x), 4096):
        d = squares(x[s : s + 4096], centres)
        own[s : s + 4096] = d.argmin(1)
        far[s : s + 4096] = d.min(1)
    return own, far


def _below(z: np.ndarray) -> np.ndarray:
    """About the share of a normal law below ``z`` deviations."""
    z = np.clip(z, -12, 12)
    return 1 / (1 + np.exp(-z * (1.5976 + 0.07056 * z * z)))


def probes(distances: np.ndarray, counts: np.ndarray, means: np.ndarray, variances: np.ndarray, width: int, k: int, missed: float) -> np.ndarray:
    """Which lists each query probes, from its squared distances to the centroids and the lists' counts and residuals (mean and variance of their squares)."""
    centre = distances + means[None, :]
    spread = np.sqrt(variances[None, :] + 4 * distances * means[None, :] / width) + 1e-9 * (1 + centre)
    low, high = np.zeros(len(distances)), (centre + 12 * spread).max(1)
    for _ in range(40):
        middle = (low + high) / 2
        few = (counts[None, :] * _below((middle[:, None] - centre) / spread)).sum(1) < k
        low, high = np.where(few, middle, low), np.where(few, high, middle)
    held = counts[None, :] * _below((high[:, None] - centre) / spread)
    order = np.argsort(-held, axis=1, kind="stable")
    sorted_held, sorted_counts = np.take_along_axis(held, order, 1), counts[order]
    before = np.cumsum(sorted_held, 1) - sorted_held
    # and on until they hold enough vectors for a full answer
    take = (before < (1 - missed) * held.sum(1)[:, None]) | (np.cumsum(sorted_counts, 1) - sorted_counts < k + 1)
    out = np.zeros(held.shape, bool)
    np.put_along_axis(out, order, take, 1)
    return out & (counts > 0)[None, :]


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def best_of(query: np.ndarray, ids: np.ndarray, far: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's ``k`` nearest, ties to the smaller id; an id at one distance counts once."""
    order = np.lexsort((ids, far, query))
    q, i, d = query[order], ids[order], far[order]
    order = order[np.r_[True, (q[1:] != q[:-1]) | (i[1:] != i[:-1]) | (d[1:] != d[:-1])][: len(order)]]
    q = query[order]
    first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]][: len(q)])
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
    return order[rank < k]


class Cell:
    """Vectors that are searched together, by list."""

    def __init__(self, rotation: np.ndarray, x: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int):
        keep = _distinct(x, ids, k + 1)
        keep = keep[np.argsort(own[keep], kind="stable")]
        self.x, self.ids, own = x[keep], ids[keep], own[keep]
        self.rotated = self.x @ rotation
        self.largest = float((self.x**2).sum(1).max(initial=0))
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]][: len(own)])
        self.lists = {int(own[a]): (int(a), int(b)) for a, b in zip(first, np.r_[first[1:], len(own)])}


class Search:
    """The nearest in a cell of a block of queries, each with the lists that it probes and the squared distance of the farthest that may be an answer."""

    def __init__(self, rotation: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, bounds: np.ndarray, k: int, columns: int = COLUMNS, epsilon: float = EPSILON):
        self.k, self.columns, self.epsilon = k, columns, epsilon
        self.queries, self.query_ids = queries, query_ids
        self.turned = queries @ rotation
        self.bounds = bounds.copy()
        self.query, self.ids, self.far = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)

    def _scan(self, asked: np.ndarray, cell: Cell, begin: int, end: int, slack: np.ndarray):
        """Pairs (query, vector, exact squared distance) of one list's vectors that no test abandons."""
        rotated, x, ids = (v[begin:end] for v in (cell.rotated, cell.x, cell.ids))
        width, first = x.shape[1], min(self.columns, x.shape[1])
        bounds = self.bounds[asked]
        head = squares(self.turned[asked, :first], rotated[:, :first])
        q, c = np.nonzero(head <= self._limit(bounds, first, width, slack[asked])[:, None])
        part = head[q, c]
        for begin in range(first, width, self.columns):
            end = min(width, begin + self.columns)
            part = part + ((self.turned[asked[q], begin:end] - rotated[c, begin:end]) ** 2).sum(1)
            alive = part <= self._limit(bounds[q], end, width, slack[asked[q]])
            q, c, part = q[alive], c[alive], part[alive]
        q = asked[q]
        # a row is no candidate for itself; another vector under its id is one
        other = (ids[c] != self.query_ids[q]) | (x[c] != self.queries[q]).any(1)
        q, c = q[other], c[other]
        return q, ids[c], ((x[c] - self.queries[q]) ** 2).sum(1)

    def _limit(self, bounds: np.ndarray, seen: int, width: int, slack: np.ndarray) -> np.ndarray:
        """Partial distances over ``seen`` columns above this are farther than the bound, by the test (all columns: surely)."""
        room = (seen / width) * (1 + self.epsilon / np.sqrt(seen)) ** 2 if seen < width else 1.0
        return bounds * room + slack

    def add(self, cell: Cell, probed: list[list[int]]) -> None:
        """Scans a cell for all queries; ``probed`` has the lists of each."""
        slack = 1e-9 * (1 + (self.queries**2).sum(1) + cell.largest)
        asking: dict[int, list[int]] = {}
        for q, own in enumerate(probed):
            for number in own:
                asking.setdefault(number, []).append(q)
        for number, own in asking.items():
            a, b = cell.lists.get(number, (0, 0))
            found = []
            for s in range(a, b, 4096):
                end = min(b, s + 4096)
                step = max(1, PAIRS // (end - s))
                for t in range(0, len(own), step):
                    found.append(self._scan(np.array(own[t : t + step]), cell, s, end, slack))
            if found:
                self._merge(found)

    def _merge(self, found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        query, near, far = (np.concatenate(c) for c in zip((self.query, self.ids, self.far), *found))
        best = best_of(query, near, far, self.k)
        self.query, self.ids, self.far = query[best], near[best], far[best]
        counts = np.bincount(self.query, minlength=len(self.queries))
        last = np.cumsum(counts) - 1
        full = counts >= self.k
        self.bounds[full] = np.minimum(self.bounds[full], self.far[last[full]])


def _distinct(x: np.ndarray, ids: np.ndarray, copies: int) -> np.ndarray:
    """Places of the vectors, of equal ones the ``copies`` with the smallest ids, an id once."""
    bits = np.ascontiguousarray(x).view(np.uint64)
    mark = (bits * (np.arange(x.shape[1], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xD1B54A32D192ED03))).sum(1)
    order = np.lexsort((ids, mark))
    copy = np.r_[False, (mark[order][1:] == mark[order][:-1]) & (x[order][1:] == x[order][:-1]).all(1)][: len(order)]
    again = copy & np.r_[False, ids[order][1:] == ids[order][:-1]][: len(order)]
    order, copy = order[~again], copy[~again]
    first = np.flatnonzero(~copy)
    rank = np.arange(len(order)) - np.repeat(first, np.diff(np.r_[first, len(order)]))
    return order[rank < copies]


def nearest(df: DataFrame, query_step: int = 100, k: int = 10, id_column: str = "vec_id", vector_column: str = "embedding", missed: float = MISSED, sample: int = SAMPLE, chunk: int = CHUNK, block: int = QUERIES) -> DataFrame:
    """The ``k`` nearest found of every query (a row whose id is divisible by ``query_step``) among all other rows.

    Columns: query_id, rank (from 1), vec_id, score (Euclidean distance of the
    original vectors in double precision), nearest first, ties to the smaller
    vec_id; all candidates if there are fewer than ``k``. Rows with a null id,
    and vectors that are null, empty, zero, hold null or non-finite components,
    or have another length than most, take no part. Rows of one id and vector
    are one row: as a query, an id is searched once for each different vector
    (each answer has its ranks from 1), a row is no candidate for itself, and an
    id at one distance takes one rank. Other columns are ignored; an empty table
    gives an empty result. ``chunk`` and ``block`` change memory, not results.
    """
    spark = df.sparkSession
    vectors = df.select(F.col(id_column).cast("long").alias("v"), F.col(vector_column).alias("x")).where(F.col("v").isNotNull() & usable("x"))
    schema = "query_id long, rank int, vec_id long, score double"
    sizes = vectors.groupBy(F.size("x").alias("w")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], schema)
    width, rows = sizes[0].w, sizes[0].n
    vectors = vectors.where(F.size("x") == width)
    scale = 1 << 30
    drawn = vectors.where(F.pmod(F.xxhash64(F.lit("sample"), "v", "x"), F.lit(scale)) < min(scale, int(scale * sample / rows) + 1)).distinct().limit(2 * sample)
    drawn = drawn.toArrow()
    if not drawn.num_rows:
        drawn = vectors.limit(1).toArrow()
    drawn = drawn.sort_by("v").combine_chunks()
    points = _matrix(drawn.column("x").combine_chunks())
    count = int(min(MOST_LISTS, max(1, round(rows**0.5)), max(1, len(points) // 16)))
    sent = spark.sparkContext.broadcast(fit_lists(points, drawn.column("v").to_numpy(), count))  # bounded by the sample

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own, far = nearest_of(_matrix(batch.column(1)), sent.value.centroids)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own.astype(np.int32)), pa.array(far)], names=["v", "x", "list", "far"])

    kind = vectors.schema["x"].dataType.simpleString()
    placed = written(vectors.mapInArrow(assign, f"v long, x {kind}, list int, far double"), "listed")
    counts, means, variances = np.zeros(count, np.int64), np.zeros(count), np.zeros(count)
    for r in placed.groupBy("list").agg(F.count("*").alias("n"), F.avg("far").alias("m"), F.var_pop("far").alias("s")).collect():  # a row for each list
        counts[r.list], means[r.list], variances[r.list] = r.n, r.m, r.s
    cell_size = int(min(chunk, max(1, -(-rows // CELLS))))
    before = np.cumsum(counts) - counts
    first_cell, last_cell = before // cell_size, (before + np.maximum(counts, 1) - 1) // cell_size
    held = spark.sparkContext.broadcast((counts, means, variances, first_cell, last_cell))  # bounded by the lists
    ask_fields = f"cell long, asks int, v long, x {kind}, list int, lists array<int>, bound double"

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The cells of vectors: those of a long list by a draw."""
        counts, begins = held.value[0], before
        rng = np.random.default_rng([SEED, TaskContext.get().partitionId()])
        for batch in batches:
            own = batch.column(2).to_numpy()
            cell = (begins[own] + (rng.random(len(own)) * counts[own]).astype(np.int64)) // cell_size
            none = [pa.nulls(len(own), t) for t in (pa.list_(pa.int32()), pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(np.zeros(len(own), np.int32)), *batch.columns, *none], names=names)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries, once for each cell that they probe."""
        lists = sent.value
        *figures, first, last = held.value
        for whole in batches:
            for s in range(0, whole.num_rows, 256):
                batch = whole.slice(s, 256)
                x, ids = _matrix(batch.column(1)), batch.column(0).to_numpy()
                use = probes(squares(x, lists.centroids), *figures, width, k, missed)
                far = squares(x, lists.sample)
                far[~use[:, lists.sample_lists] | (lists.sample_ids[None, :] == ids[:, None])] = np.inf
                # of copies of one id in the sample only one counts
                bounds = np.full(len(x), np.inf)
                for q, d in enumerate(far):
                    near = np.flatnonzero(np.isfinite(d))
                    near = near[np.argsort(d[near], kind="stable")[: 4 * k]]
                    own = near[np.sort(np.unique(lists.sample_ids[near], return_index=True)[1])]
                    if len(own) >= k:
                        bounds[q] = ((lists.sample[own[k - 1]] - x[q]) ** 2).sum()
                at, cells, listed = [], [], []
                for q, row in enumerate(use):
                    by_cell: dict[int, list[int]] = {}
                    for number in np.flatnonzero(row).tolist():
                        for cell in range(int(first[number]), int(last[number]) + 1):
                            by_cell.setdefault(cell, []).append(number)
                    at += [q] * len(by_cell)
                    cells += by_cell
                    listed += by_cell.values()
                for t in range(0, len(at), 4096):
                    some = pa.array(at[t : t + 4096], pa.int64())
                    n = len(some)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(cells[t : t + n], pa.int64()), pa.array(np.ones(n, np.int32)), batch.column(0).take(some), batch.column(1).take(some), pa.nulls(n, pa.int32()),
                        pa.array(listed[t : t + n], pa.list_(pa.int32())), pa.array(bounds[at[t : t + n]]),
                    ], names=names)

    names = ["cell", "asks", "v", "x", "list", "lists", "bound"]
    vectors_of = placed.select("v", "x", "list").mapInArrow(deal, ask_fields)
    asked = placed.where(F.pmod("v", F.lit(query_step)) == 0).select("v", "x").distinct().mapInArrow(probe, ask_fields)
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    met = vectors_of.unionByName(asked).repartition(tasks, "cell").sortWithinPartitions("cell", "asks")
    found = met.mapInArrow(_searcher(sent, k, block), "q long, h long, c long, score double")
    found = found.dropDuplicates(["q", "h", "c", "score"])
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("q", "h").orderBy("score", "c"))).where(F.col("rank") <= k)
    return ranked.select(F.col("q").alias("query_id"), "rank", F.col("c").alias("vec_id"), "score")


def _searcher(sent, k: int, block: int):
    """Searches the cells of a task: of each, first the vectors come, then the queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rotation = sent.value.rotation
        held: list[pa.RecordBatch] = []
        cell, number = None, None
        for whole in batches:
            if not whole.num_rows:
                continue
            key = whole.column(0).to_numpy() * 2 + whole.column(1).to_numpy()
            edges = np.r_[0, np.flatnonzero(key[1:] != key[:-1]) + 1, len(key)].tolist()
            for a, b in zip(edges[:-1], edges[1:]):
                batch, own, asks = whole.slice(a, b - a), int(key[a]) >> 1, int(key[a]) & 1
                if own != number:
                    held, cell, number = [], None, own
                if not asks:
                    held.append(batch)
                    continue
                if cell is None and held:
                    x = np.concatenate([_matrix(v.column(3)) for v in held])
                    cell = Cell(rotation, x, *(np.concatenate([v.column(c).to_numpy() for v in held]) for c in (2, 4)), k)
                    held = []
                if cell is None:
                    continue  # no vector fell into this part of a long list
                for s in range(0, b - a, block):
                    some = batch.slice(s, block)
                    search = Search(rotation, _matrix(some.column(3)), some.column(2).to_numpy(), some.column(6).to_numpy(), k)
                    search.add(cell, some.column(5).to_pylist())
                    marks = _marks(search.queries)
                    yield pa.RecordBatch.from_arrays([pa.array(search.query_ids[search.query]), pa.array(marks[search.query]), pa.array(search.ids), pa.array(np.sqrt(search.far))], names=["q", "h", "c", "score"])

    return run


def _marks(x: np.ndarray) -> np.ndarray:
    """64-bit hashes of vectors, which tell those of one id apart."""
    bits = np.ascontiguousarray(x + 0.0).view(np.uint64)
    mixed = bits * (np.arange(x.shape[1], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xD1B54A32D192ED03))
    mixed ^= mixed >> np.uint64(31)
    return (mixed * np.uint64(0xBF58476D1CE4E5B9)).sum(1, dtype=np.uint64).view(np.int64)
