"""Best-fit packing of documents into sequences of bounded length, by large-item matching.

Token counts are whole numbers up to the capacity, so the packing is planned on
how many pieces there are of each length, a table with one row for each length
however many documents there are. Pieces above a third of the capacity meet at
most twice in a sequence: they are matched greedily, the longest first, each
with the longest that still fits, which pairs as many as can be paired. Smaller
pieces, longest first, go where the gap that they fit in is smallest. The plan
consists of runs: of the pieces of one length, those of consecutive ranks lie in
consecutive sequences at one offset. Every piece then finds its place by its
length and its rank among the pieces of its length, which is its rank in its
task and the counts of the tasks before.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlens.llm.common import written
from ledgerlens.llm.segments import ByteEncoder, Ragged, SegmentMemo, cut, text_bytes

#: Tokens of a sequence at most, and the id behind every document.
CAPACITY, END_ID = 1024, 2
#: Distinct segments of a worker's memo, and ids that it holds.
WORDS, HELD = 1_500_000, 12_000_000


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Runs (length, first rank, pieces, first sequence, pieces in a sequence, offset), sorted by length and rank.

    ``counts`` has the number of pieces of each length from 1 to ``capacity``.
    Rank r of a run lies in sequence first + (r - first rank) // per, behind
    (r - first rank) % per others of its length from the offset on. The number
    of runs depends on the capacity, not on the number of pieces.
    """
    if any(not 1 <= length <= capacity for length, n in counts.items() if n):
        raise ValueError("a piece is longer than a sequence, or empty")
    left = dict(counts)
    used: dict[int, int] = defaultdict(int)
    runs: list[tuple[int, ...]] = []
    groups: dict[int, list[tuple[int, int]]] = defaultdict(list)  # by gap: (first sequence, sequences)
    gaps: list[int] = []
    sequences = 0

    def put(length: int, pieces: int, first: int, per: int, offset: int) -> None:
        runs.append((length, used[length], pieces, first, per, offset))
        used[length] += pieces
        left[length] -= pieces

    def keep(gap: int, first: int, n: int) -> None:
        if n and gap:
            if not groups[gap]:
                insort(gaps, gap)
            groups[gap].append((first, n))

    lengths = sorted((k for k, n in counts.items() if n), reverse=True)
    large = sorted(k for k in lengths if 3 * k > capacity)
    for a in reversed(large):
        while left[a]:
            at = bisect_left(large, min(a, capacity - a) + 1) - 1
            while at >= 0 and left[large[at]] < (2 if large[at] == a else 1):
                at -= 1
            b = large[at] if at >= 0 else None
            n = left[a] if b is None else left[a] // 2 if b == a else min(left[a], left[b])
            put(a, 2 * n if b == a else n, sequences, 2 if b == a else 1, 0)
            if b is not None and b != a:
                put(b, n, sequences, 1, a)
            keep(capacity - a - (b or 0), sequences, n)
            sequences += n
    for length in (k for k in lengths if 3 * k <= capacity):
        for gap in gaps[bisect_left(gaps, length) :]:
            if not left[length]:
                break
            per, rest = gap // length, []
            for first, n in groups.pop(gap):
                whole = min(n, left[length] // per)
                if whole:
                    put(length, whole * per, first, per, capacity - gap)
                    keep(gap - per * length, first, whole)
                few = left[length] if whole < n and left[length] < per else 0
                if few:
                    put(length, few, first + whole, few, capacity - gap)
                    keep(gap - few * length, first + whole, 1)
                    whole += 1
                if whole < n:
                    rest.append((first + whole, n - whole))
            if rest:
                groups[gap] = rest + groups.get(gap, [])
            elif not groups.get(gap):
                gaps.remove(gap)
        per = capacity // length
        for each in (per, left[length] % per):
            if each and left[length] >= each:
                n = left[length] // each
                put(length, n * each, sequences, each, 0)
                keep(capacity - each * length, sequences, n)
                sequences += n
    return np.array(sorted(runs), np.int64).reshape(-1, 6)


class _Ids:
    """The ids of a memo's segments."""

    def __init__(self, path: str):
        self.encode, self.ids = ByteEncoder(path, plain=False), Ragged(np.int32)

    def clear(self) -> None:
        self.ids.clear()

    def full(self) -> bool:
        return self.ids.used > HELD

    def add(self, segments: list[str]) -> None:
        self.ids.add(*self.encode(segments))


@lru_cache(maxsize=1)
def memo(path: str, words: int = WORDS) -> SegmentMemo:
    """One memo for a worker and file; every node has the file at this path."""
    return SegmentMemo(_Ids(path), words)


def _ranks(values: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Each value's number among the equal ones, from those ``seen`` on, which are counted on."""
    order = np.argsort(values, kind="stable")
    own = values[order]
    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]][: len(own)])
    out = np.empty(len(values), np.int64)
    out[order] = np.arange(len(own)) - np.repeat(first, np.diff(np.r_[first, len(own)]))
    out += seen[values]
    seen += np.bincount(values, minlength=len(seen))
    return out


def pieces(df: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Every document's pieces: doc_id, piece, start, length, ids_crc32, ids, and the task (part) with the piece's rank in it among those of its length.

    Only documents of over ``capacity`` ids are cut; the first piece takes what
    the others leave over.
    """
    kind = df.schema[id_column].dataType.simpleString()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids", "part", "place"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part = memo(tokenizer_path), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for first, raw, sizes in text_bytes(batch, "t"):
                begins, lengths, counts = cut(raw, sizes)
                ids, n = own.store.ids.take(own.numbers(raw, begins, lengths))
                stops = np.r_[0, np.cumsum(n)][np.cumsum(counts)]
                ids = np.insert(ids, stops, end_id).astype("<u4")
                tokens = np.diff(stops, prepend=0) + 1
                many = -(-tokens // capacity)
                doc = np.repeat(np.arange(len(tokens)), many)
                number = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
                head = (tokens - (many - 1) * capacity)[doc]
                length = np.where(number == 0, head, capacity)
                start = np.where(number == 0, 0, head + (number - 1) * capacity)
                edges = np.r_[0, np.cumsum(length)]
                crcs = [zlib.crc32(ids[a:b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
                columns = [
                    batch.column(0).take(pa.array(first + doc)), pa.array(number.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crcs, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(ids.astype(np.int32))), pa.array(np.full(len(doc), part, np.int32)), pa.array(_ranks(length, seen)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    held = df.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("t"))
    return held.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, ids array<int>, part int, place long")


def packed(df: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_column: str = "doc_id", text_column: str = "text", with_ids: bool = False) -> DataFrame:
    """A sequence and a place in it for every piece of every document.

    Columns: doc_id, piece (from 0), start (ids of the document before it),
    length, ids_crc32 (unsigned, of the ids as little-endian unsigned 32-bit
    integers), sequence_id (from 0 on, without gaps), offset (places of a
    sequence are taken from 0 without gaps), and with ``with_ids`` the ids. A
    null text counts as empty and is the end id alone; repeated rows and null
    ids are rows like any other; other columns are ignored; an empty table gives
    an empty result.
    """
    spark = df.sparkSession
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else []), "part", "place"]
    cuts = written(pieces(df, tokenizer_path, capacity, end_id, id_column, text_column).select(*columns), "pieces")
    counted = cuts.groupBy("part", "length").agg(F.count("*").alias("n"))
    totals = {r.length: r.n for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # a row for each length
    runs = spark.sparkContext.broadcast(plan(totals, capacity))  # bounded by the capacity
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    counted = counted.select("part", "length", F.coalesce(before, F.lit(0)).alias("before"))
    ranked = cuts.join(counted, ["part", "length"]).withColumn("rank", F.col("before") + F.col("place")).drop("part", "place", "before")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length0, rank0, _, sequence0, per, offset0 = runs.value.T
        shift = np.int64(1) << np.int64(40)
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in (0, batch.num_columns - 1))
            run = np.searchsorted(length0 * shift + rank0, length * shift + rank, "right") - 1
            rank = rank - rank0[run]
            sequence = sequence0[run] + rank // per[run]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset0[run] + rank % per[run] * length)], names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema.fields if f.name != "rank")
    out = ranked.mapInArrow(put, f"{fields}, sequence_id long, offset long")
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else []), "sequence_id", "offset").withColumnRenamed("doc_id", id_column)
