"""Benchmark decontamination: short test items inside long documents.

An item is contained in a document when the document holds at least 80 % of the
item's distinct shingles of five words. Items are parted by size (number of
distinct shingles, in classes that double), and every class has an index and a
threshold of its own. An item's signature is its bottom MinHash values: the
smallest hashes of its shingles, ``SPARE`` more than an item of the class's
upper size may miss. A document that contains the item misses no more shingles
than its size allows, so it holds at least the signature's other values: the
search finds every contained item, however long the document is. The pairs it
finds are verified by counting the item's shingles in the document word by word.

The items are a stated query set: they go to the workers in blocks of bounded
size, each block against all documents in one pass that reads no more of a
document than its words.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import text_parts

SHINGLE = 5
THRESHOLD = 0.8
#: Characters of items that one block holds; a longer item is a block of its own.
BLOCK_CHARS = 32 << 20
#: Values of a signature beyond those that an item of the class may miss.
SPARE = 3
SEED = 17

_WORD = re.compile(r"[^\W_]+")
_MIX = np.random.default_rng(SEED).integers(1 << 62, size=SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters and digits."""
    return _WORD.findall(text.lower())


def shingles_of(words: list[str], width: int = SHINGLE) -> set[tuple[str, ...]]:
    """Distinct shingles; fewer words than a shingle are one shingle, no word gives none."""
    if not words:
        return set()
    width = min(width, len(words))
    return {tuple(words[k : k + width]) for k in range(len(words) - width + 1)}


def shingle_hashes(marks: np.ndarray, width: int) -> np.ndarray:
    """A hash of every ``width`` neighbouring words from the words' hashes."""
    count = len(marks) - width + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(count, np.uint64)
    for k in range(width):
        total += marks[k : k + count] * _MIX[k]
    total ^= total >> np.uint64(31)
    total *= np.uint64(0xBF58476D1CE4E5B9)
    return total ^ (total >> np.uint64(29))


def _marks(words: list[str]) -> np.ndarray:
    """Hashes of words, equal within a worker; the search is exact for any hash."""
    return np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)


def needed(size: int, threshold: float = THRESHOLD) -> int:
    """Shingles of an item of ``size`` that a document must hold."""
    return max(1, math.ceil(threshold * size - 1e-9))


class SizeClass:
    """The index of one size class: items of like size whose shingles have one width."""

    def __init__(self, members: list[tuple[int, np.ndarray]], upper: int, threshold: float):
        count = upper - needed(upper, threshold) + SPARE
        signatures = [hashes[:count] for _, hashes in members]
        self.numbers = np.array([number for number, _ in members])
        #: Values of its signature that a document which contains the item holds at least.
        self.least = np.array([len(own) - (len(hashes) - needed(len(hashes), threshold)) for own, (_, hashes) in zip(signatures, members)])
        values = np.concatenate(signatures)
        owners = np.repeat(np.arange(len(members)), [len(own) for own in signatures])
        order = np.argsort(values, kind="stable")
        self.values, self.owners = values[order], owners[order]
        bits = min(26, max(12, int(len(values) * 32).bit_length()))
        self.mask = np.uint64((1 << bits) - 1)
        #: The signature values by their low bits.
        self.seen = np.zeros(1 << bits, bool)
        self.seen[(values & self.mask).astype(np.int64)] = True

    def candidates(self, hashes: np.ndarray) -> list[int]:
        """Items of which a document with these shingles holds enough values."""
        hashes = hashes[self.seen[(hashes & self.mask).astype(np.int64)]]
        if not len(hashes):
            return []
        hashes = np.unique(hashes)
        low, high = np.searchsorted(self.values, hashes, "left"), np.searchsorted(self.values, hashes, "right")
        runs = high - low
        held = self.owners[np.repeat(low - (np.cumsum(runs) - runs), runs) + np.arange(int(runs.sum()))]
        owners, counts = np.unique(held, return_counts=True)
        return self.numbers[owners[counts >= self.least[owners]]].tolist()


class ItemIndex:
    """A block of items, indexed by size class."""

    def __init__(self, items: list[tuple[object, str]], threshold: float = THRESHOLD, width: int = SHINGLE):
        self.items, self.threshold, self.width = items, threshold, width
        parts: dict[tuple[int, int], list[tuple[int, np.ndarray]]] = defaultdict(list)
        for number, (_, text) in enumerate(items):
            words = words_of(text)
            if words:
                hashes = np.unique(shingle_hashes(_marks(words), min(width, len(words))))
                parts[min(width, len(words)), len(hashes).bit_length()].append((number, hashes))
        self.classes: dict[int, list[SizeClass]] = defaultdict(list)
        for (wide, bits), members in sorted(parts.items()):
            self.classes[wide].append(SizeClass(members, (1 << bits) - 1, threshold))
        self.shingles = lru_cache(maxsize=4096)(self._shingles)

    def _shingles(self, number: int) -> set[tuple[str, ...]]:
        return shingles_of(words_of(self.items[number][1]), self.width)

    def search(self, text: str) -> list[tuple[object, int, int]]:
        """Items contained in a text: id, shingles held, shingles of the item."""
        words = words_of(text)
        if not words:
            return []
        marks = _marks(words)
        candidates: set[int] = set()
        for wide, classes in self.classes.items():
            hashes = shingle_hashes(marks, wide)
            for own in classes:
                candidates.update(own.candidates(hashes))
        held: dict[int, set[tuple[str, ...]]] = {}
        found = []
        for number in sorted(candidates):
            own = self.shingles(number)
            wide = len(next(iter(own)))
            if wide not in held:
                held[wide] = set(zip(*(words[k:] for k in range(wide))))
            count = len(own & held[wide])
            if count >= needed(len(own), self.threshold):
                found.append((self.items[number][0], count, len(own)))
        return found


def blocks(items: Iterable[tuple[object, str]], chars: int = BLOCK_CHARS) -> Iterator[list[tuple[object, str]]]:
    block: list[tuple[object, str]] = []
    held = 0
    for item in items:
        if block and held + len(item[1]) > chars:
            yield block
            block, held = [], 0
        block.append(item)
        held += len(item[1])
    if block:
        yield block


def contained_items(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text_column: str = "text", threshold: float = THRESHOLD, width: int = SHINGLE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Pairs (id, item_id) of documents that contain items, with held and shingles (counts of distinct shingles) and containment.

    Null and empty texts, and texts without a word, contain nothing and are
    contained in nothing. An item of fewer words than a shingle is one shingle
    of that many words. Rows repeat as documents and items do: each row of
    ``docs`` is searched by itself, equal items are reported each. Other columns
    are ignored; an empty table on either side gives an empty result.
    """
    kinds = docs.schema[id_column].dataType.simpleString(), benchmark.schema[item_column].dataType.simpleString()
    item_type = pa.int64() if kinds[1] in ("bigint", "int") else pa.string()
    schema = f"i {kinds[0]}, item_id {'bigint' if item_type == pa.int64() else 'string'}, held long, shingles long"
    session, source, out = docs.sparkSession, docs.select(F.col(id_column).alias("i"), F.col(text_column).alias("t")), None
    for block in _item_blocks(benchmark, item_column, item_text_column, item_type, block_chars):
        part = source.mapInArrow(_searcher(_index(session.sparkContext.broadcast(block), threshold, width), item_type), schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = session.createDataFrame([], schema)
    return out.select(F.col("i").alias(id_column), "item_id", "held", "shingles", (F.col("held") / F.col("shingles")).alias("containment"))


def _item_blocks(benchmark: DataFrame, item_column: str, text_column: str, item_type: pa.DataType, chars: int) -> Iterator[list[tuple[object, str]]]:
    """Items in blocks of at most ``chars`` characters or one item; one block at a time is on the driver."""
    rows = benchmark.select(F.col(item_column).alias("k"), F.coalesce(text_column, F.lit("")).alias("t")).toLocalIterator(prefetchPartitions=True)
    return blocks(((r.k if item_type == pa.int64() or r.k is None else str(r.k), r.t) for r in rows), chars)


_BUILT: dict[tuple, ItemIndex] = {}


def _index(block, threshold: float, width: int):
    """A function that gives a worker's index of a broadcast block; the worker keeps the last one."""
    number = block._jbroadcast.id()

    def built() -> ItemIndex:
        key = (number, threshold, width)
        if key not in _BUILT:
            _BUILT.clear()
            _BUILT[key] = ItemIndex(block.value, threshold, width)
        return _BUILT[key]

    return built


def _searcher(found, item_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = found()
        for batch in batches:
            at, items, held, sizes = [], [], [], []
            for k, text in enumerate(t for _, part in text_parts(batch, "t") for t in part):
                for item, count, size in index.search(text):
                    at.append(k)
                    items.append(item)
                    held.append(count)
                    sizes.append(size)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(items, item_type), pa.array(held, pa.int64()), pa.array(sizes, pa.int64())], names=["i", "item_id", "held", "shingles"])

    return run


def without_items(docs: DataFrame, benchmark: DataFrame, text_column: str = "text", item_column: str = "item_id", item_text_column: str = "text", threshold: float = THRESHOLD, width: int = SHINGLE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs``, with all their columns, that contain no item; nothing is shuffled."""
    for block in _item_blocks(benchmark, item_column, item_text_column, pa.string(), block_chars):
        found = _index(docs.sparkSession.sparkContext.broadcast(block), threshold, width)

        def run(batches: Iterator[pa.RecordBatch], found=found) -> Iterator[pa.RecordBatch]:
            index = found()
            for batch in batches:
                yield batch.filter(pa.array([not index.search(t) for _, part in text_parts(batch, text_column) for t in part], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


#: DuckDB SQL for the registered query; rows of both tables count each, and items of fewer than five words are one shingle of that width.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS dr, doc_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
b AS (SELECT row_number() OVER () AS br, item_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark WHERE text IS NOT NULL),
wide AS (SELECT DISTINCT least(5, len(w)) AS n FROM b WHERE len(w) > 0),
ds AS (SELECT DISTINCT dr, n, array_to_string(w[k : k + n - 1], ' ') AS s FROM (SELECT dr, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d JOIN wide ON len(w) >= n)),
bs AS (SELECT DISTINCT br, n, array_to_string(w[k : k + n - 1], ' ') AS s FROM (SELECT br, w, least(5, len(w)) AS n, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS k FROM b WHERE len(w) > 0)),
size AS (SELECT br, count(*) AS shingles FROM bs GROUP BY br),
held AS (SELECT dr, br, count(*) AS held FROM ds JOIN bs USING (n, s) GROUP BY dr, br)
SELECT doc_id, item_id, CAST(held AS BIGINT) AS held, CAST(shingles AS BIGINT) AS shingles, held / shingles AS containment
FROM held JOIN size USING (br) JOIN d USING (dr) JOIN (SELECT br, item_id FROM b) USING (br) WHERE held >= 0.8 * shingles - 1e-9
"""
