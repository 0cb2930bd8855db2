"""Token ids of documents in ORC files.

Files hold documents in ascending id order: ids as run-length-encoded integers,
row indexes for every few thousand rows and Bloom filters on the document id,
so that a lookup reads only stripes that can hold the id, and stripes are read
in parallel. Texts are dealt by ranges of the id before they are encoded, so
the encoding runs once and the files follow each other in id order.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import fresh_path, text_parts
from ledgerlens.llm.memo import slices

#: Appended to every document.
END_ID = 1
STRIPE_BYTES = 16 << 20
INDEX_ROWS = 2000
#: Small Latin letters, on which all libraries agree.
_SMALL = "a-z\u00df-\u00f6\u00f8-\u024f"
#: Words of these and of ASCII signs and digits (no apostrophe: some begin a pre-token with letters) are cut into pre-tokens here.
_EASY = re.compile(f"[!-&(-~{_SMALL}]+").fullmatch
_PIECES = re.compile(f"[{_SMALL}]+|[0-9]|[!-&(-/:-@\\[-`{{-~]+").findall
#: Words of the memo at most, bytes of a word that it holds at most, and words of one call of the library.
WORDS = 1_500_000
WIDEST = 23
CALL = 2048
#: Bytes of texts that are encoded at once.
PART = 4 << 20

_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_ODD = np.random.default_rng(5).integers(1 << 62, size=4, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class WordTable:
    """A hash table in arrays from words of up to ``WIDEST`` bytes to entry numbers.

    A word's key is its bytes and its length in three 64-bit integers, so equal
    keys are equal words. Many words are looked up and entered at once.
    """

    def __init__(self, words: int):
        self.limit = words
        self.bits = max(4, int(words * 2).bit_length())
        self.clear()

    def clear(self) -> None:
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.keys = np.empty((3, self.limit), np.uint64)
        self.count = 0

    @staticmethod
    def key(raw: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Keys of words in a buffer of bytes that goes on for 24 bytes after the last word."""
        loads = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
        key = np.empty((3, len(begins)), np.uint64)
        for k, most in enumerate((8, 8, 7)):
            np.bitwise_and(loads[begins + 8 * k], _MASKS[np.clip(sizes - 8 * k, 0, most)], out=key[k])
        key[2] |= sizes.astype(np.uint64) << np.uint64(56)
        return key

    @staticmethod
    def mixed(key: np.ndarray) -> np.ndarray:
        h = (key[0] * _ODD[0]) ^ ((key[1] + (key[0] >> np.uint64(32))) * _ODD[1]) ^ (key[2] * _ODD[2])
        h ^= h >> np.uint64(32)
        h *= _ODD[3]
        return h

    def find(self, key: np.ndarray, mixed: np.ndarray) -> np.ndarray:
        """Each word's entry, or -1."""
        last = len(self.slots) - 1
        at = (mixed >> np.uint64(64 - self.bits)).astype(np.int64)
        found = self.slots[at]
        todo = np.flatnonzero((found >= 0) & ~self._same(found, key))
        while len(todo):
            at[todo] = (at[todo] + 1) & last
            found[todo] = self.slots[at[todo]]
            todo = todo[(found[todo] >= 0) & ~self._same(found[todo], key[:, todo])]
        return found

    def _same(self, entry: np.ndarray, key: np.ndarray) -> np.ndarray:
        same = self.keys[0][entry] == key[0]
        same &= self.keys[1][entry] == key[1]
        same &= self.keys[2][entry] == key[2]
        return same

    def enter(self, key: np.ndarray, mixed: np.ndarray) -> np.ndarray:
        """Enters words that are not in the table, each once; their entries count on from the last."""
        entry = np.arange(self.count, self.count + key.shape[1], dtype=np.int32)
        self.keys[:, entry] = key
        self.count += len(entry)
        at = (mixed >> np.uint64(64 - self.bits)).astype(np.int64)
        todo = np.arange(len(entry))
        while len(todo):
            free = todo[self.slots[at[todo]] < 0]
            self.slots[at[free]] = entry[free]  # of several words for one slot the last one stays
            todo = todo[self.slots[at[todo]] != entry[todo]]
            at[todo] = (at[todo] + 1) & (len(self.slots) - 1)
        return entry


def first_of_each(key: np.ndarray, mixed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the first of each distinct word, and for each word the number of its first."""
    firsts, number = [], np.empty(key.shape[1], np.int64)
    todo, count = np.arange(key.shape[1]), 0
    while len(todo):
        _, first, own = np.unique(mixed[todo], return_index=True, return_inverse=True)
        first = todo[first]
        same = (key[:, todo] == key[:, first[own]]).all(0)
        number[todo[same]] = own[same] + count
        firsts.append(first)
        count += len(first)
        todo = todo[~same]
    return (np.concatenate(firsts) if firsts else np.empty(0, np.int64)), number


# The steps before the model that the words below rely on, and the mark that ends a pre-token.
_STEPS = ["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"], "</w>"
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def works_by_words(made: dict) -> bool:
    """Whether a tokenizer file (as JSON) lower-cases and composes texts, cuts them by the pattern above, drops white space and ends pre-tokens by a mark."""
    listed = lambda part, key: [s["type"] for s in (made[part] or {}).get(key, [])]
    if (listed("normalizer", "normalizers"), listed("pre_tokenizer", "pretokenizers"), made["model"].get("end_of_word_suffix")) != _STEPS:
        return False
    space, split = made["normalizer"]["normalizers"][1], made["pre_tokenizer"]["pretokenizers"][0]
    plain = not made["post_processor"] and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or not t["content"].startswith("<|") for t in made["added_tokens"])
    return plain and (space["pattern"], space["content"]) == ({"Regex": r"\s+"}, " ") and split["pattern"] == {"Regex": _PATTERN} and split["invert"] and split["behavior"] == "Removed"


class WordTokenizer:
    """A tokenizer whose normaliser and pre-tokenizer work on each white-space-separated word by itself; other files are refused.

    Words are encoded by the library once and remembered in a table of at most
    ``words`` words, which is emptied when it is full. Easy words go to the
    library many at a time, cut into pre-tokens by spaces: the ids that end a
    pre-token part them again.
    """

    def __init__(self, path: str, words: int = WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        if not works_by_words(json.loads(self.tokenizer.to_str())):
            raise ValueError(f"{path} does not work word by word")
        self.bare = Tokenizer.from_file(path)
        steps = [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        self.bare.normalizer, self.bare.pre_tokenizer = None, pre_tokenizers.Sequence(steps)
        size = self.tokenizer.get_vocab_size()
        self.ends = np.array([(self.tokenizer.id_to_token(k) or "").endswith("</w>") for k in range(size)])
        self.table = WordTable(words)
        self._forget()

    def _forget(self) -> None:
        """Empties the memo: the ids of its words lie in ``pool``, entry by entry."""
        self.table.clear()
        self.pool, self.used = np.empty(1 << 16, np.int32), 0
        self.at = np.empty(self.table.limit, np.int64)
        self.size = np.empty(self.table.limit, np.int32)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        """The library's ids of whole texts."""
        return [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, one after the other, and how many each has."""
        sizes = np.zeros(len(words), np.int64)
        easy = np.fromiter((_EASY(w) is not None for w in words), bool, len(words))
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        which = np.flatnonzero(easy)
        for k in range(0, len(which), CALL):
            pieces = [_PIECES(words[n]) for n in which[k : k + CALL].tolist()]
            found = np.array(self.bare.encode_batch_fast([" ".join([" ".join(p) for p in pieces])], add_special_tokens=False)[0].ids, np.int32)
            stops = np.flatnonzero(self.ends[found]) + 1
            last = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces))) - 1
            if len(stops) != last[-1] + 1 or stops[-1] != len(found):
                raise RuntimeError("ids that end a pre-token do not part the words")
            sizes[which[k : k + CALL]] = np.diff(stops[last], prepend=0)
            parts.append((which[k : k + CALL], found))
        rest = np.flatnonzero(~easy)
        for k in range(0, len(rest), CALL):
            found = self.whole([words[n] for n in rest[k : k + CALL].tolist()])
            sizes[rest[k : k + CALL]] = np.fromiter(map(len, found), np.int64, len(found))
            parts.append((rest[k : k + CALL], np.concatenate(found)))
        ids = np.empty(int(sizes.sum()), np.int32)
        begins = np.cumsum(sizes) - sizes
        for own, found in parts:
            ids[_runs(begins[own], sizes[own])] = found
        return ids, sizes

    def _resolve(self, text: bytes, raw: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each word's ids lie in a pool, how many they are, and the pool."""
        at, count = np.empty(len(begins), np.int64), np.empty(len(begins), np.int64)
        short = np.flatnonzero(sizes <= WIDEST)
        key = WordTable.key(raw, begins[short], sizes[short])
        mixed = WordTable.mixed(key)
        entry = self.table.find(key, mixed)
        missing = np.flatnonzero(entry < 0)
        first, number = first_of_each(key[:, missing], mixed[missing])
        if self.table.count + len(first) > self.table.limit:
            self._forget()
            entry[:] = -1
            missing = np.arange(len(short))
            first, number = first_of_each(key, mixed)
        fresh = missing[first]
        where = short[fresh]
        wide = np.flatnonzero(sizes > WIDEST)
        spans = np.concatenate([where, wide])
        words = [text[a:b].decode("utf-8", "surrogatepass") for a, b in zip(begins[spans].tolist(), (begins[spans] + sizes[spans]).tolist())]
        ids, lengths = self._encode(words)
        kept = int(lengths[: len(where)].sum())
        if len(fresh) <= self.table.limit:
            new = self.table.enter(key[:, fresh], mixed[fresh])
            while self.used + kept > len(self.pool):
                self.pool = np.concatenate([self.pool, np.empty(len(self.pool), np.int32)])
            self.pool[self.used : self.used + kept] = ids[:kept]
            self.size[new] = lengths[: len(where)]
            self.at[new] = self.used + np.cumsum(lengths[: len(where)]) - lengths[: len(where)]
            self.used += kept
            entry[missing] = new[number]
            at[short], count[short] = self.at[entry], self.size[entry]
            pool = np.concatenate([self.pool[: self.used], ids[kept:]]) if len(wide) else self.pool
            base = self.used
        else:
            # one part has more distinct words than the memo: nothing is remembered
            at[short], count[short] = (np.cumsum(lengths) - lengths)[number], lengths[number]
            pool, base = ids, kept
        at[wide] = base + np.cumsum(lengths[len(where) :]) - lengths[len(where) :]
        count[wide] = lengths[len(where) :]
        return at, count, pool

    def encode_flat(self, texts: list[str], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one text after the other, each with ``end`` behind it if given; and each text's number of ids."""
        odd, shown = [], []
        for k, t in enumerate(texts):
            low = t.lower()
            # special tokens, letters whose lower case depends on their place, and text that the normaliser composes
            if "<|" in t or not t.isascii() and ("\u03a3" in t or not unicodedata.is_normalized("NFC", t) or not unicodedata.is_normalized("NFC", low)):
                odd.append(k)
                low = ""
            shown.append(low.encode("utf-8", "surrogatepass"))
        text = b" ".join(shown) + b" " * 32
        raw = np.frombuffer(text, np.uint8)
        owner_end = np.cumsum(np.fromiter(map(len, shown), np.int64, len(shown)) + 1)
        del shown
        gap = (raw == 32) | (raw == 9) | (raw == 10) | (raw == 13)
        edges = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        if not gap[0]:
            edges = np.r_[0, edges]
        begins, stops = edges[::2], edges[1::2]
        at, count, pool = self._resolve(text, raw, begins, stops - begins)
        ids, before = pool[_runs(at, count)], np.r_[0, np.cumsum(count)]
        sizes = np.diff(before[np.searchsorted(begins, owner_end)], prepend=0)
        if odd or end is not None:
            found = dict(zip(odd, self.whole([texts[k] for k in odd])))
            tail = np.array([] if end is None else [end], np.int32)
            parts, stop = [], np.cumsum(sizes)
            if not odd:
                ids = np.insert(ids, stop, end)
            else:
                for k, (a, b) in enumerate(zip((stop - sizes).tolist(), stop.tolist())):
                    parts += [found.get(k, ids[a:b]), tail]
                    sizes[k] = len(parts[-2])
                ids = np.concatenate(parts)
            sizes = sizes + len(tail)
        return ids, sizes

    def encode_many(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text, in order, as bytes of 32-bit integers."""
        for part in slices(texts):
            ids, sizes = self.encode_flat(part)
            ends = np.cumsum(sizes)
            yield from (ids[a:b].tobytes() for a, b in zip((ends - sizes).tolist(), ends.tolist()))


def _runs(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all runs, one run after the other."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(begins - before, sizes) + np.arange(int(sizes.sum()))


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    """One tokenizer for a worker and file; every node has the file at this path."""
    return WordTokenizer(path)


def write_tokens(df: DataFrame, tokenizer_path: str, path: str, id_column: str = "doc_id", text_column: str = "text", end_id: int = END_ID) -> None:
    """Encodes every whole text and writes ORC files to ``path``.

    Columns: doc_id; part, the file's number in id order; first, the count of
    ids before the document in its file; n_tokens; ids (with ``end_id`` at the
    end). Null and empty texts hold the end id alone. A null id sorts first;
    rows with one id stand together, ordered by a hash of their text, so that
    an id that holds a large share of all rows spreads over files.
    """
    kind = df.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(tokenizer_path)
        part, first = TaskContext.get().partitionId(), 0
        for batch in batches:
            for done, texts in text_parts(batch, "t", PART):
                values, sizes = own.encode_flat(texts, end_id)
                ends = np.cumsum(sizes)
                ids = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(values))
                columns = [batch.column(0).slice(done, len(texts)), pa.array(np.full(len(texts), part, np.int32)), pa.array(first + ends - sizes), pa.array(sizes), ids]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "part", "first", "n_tokens", "ids"])
                first += int(ends[-1])

    held = df.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("t"))
    held = held.withColumn("spread", F.xxhash64("t")).repartitionByRange("doc_id", "spread").sortWithinPartitions("doc_id", "spread")
    encoded = held.select("doc_id", "t").mapInArrow(run, f"doc_id {kind}, part int, first long, n_tokens long, ids array<int>")
    options = {"compression": "zstd", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.row.index.stride": str(INDEX_ROWS), "orc.stripe.size": str(STRIPE_BYTES)}
    encoded.write.options(**options).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The documents of token files: doc_id, start (ids of all documents before it), n_tokens, ids.

    Only the count columns are read to place the files one after the other;
    that table has a row for each file.
    """
    files = spark.read.orc(path)
    totals = sorted((r.part, r.n) for r in files.groupBy("part").agg(F.max(F.col("first") + F.col("n_tokens")).alias("n")).collect())
    places, before = [], 0
    for part, n in totals:
        places.append((part, before))
        before += n
    offsets = spark.createDataFrame(places, "part int, before long")
    placed = files.join(F.broadcast(offsets), "part")
    return placed.select("doc_id", (F.col("first") + F.col("before")).alias("start"), "n_tokens", "ids")


def with_crc(tokens: DataFrame) -> DataFrame:
    """Replaces ``ids`` by ids_crc32: the unsigned crc32 of the ids as little-endian unsigned 32-bit integers, and counts them anew."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(2)
            at = ids.offsets.to_numpy()
            values = ids.values.to_numpy(zero_copy_only=False).astype("<u4")
            crcs = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(at).astype(np.int64)), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    kind = tokens.schema["doc_id"].dataType.simpleString()
    return tokens.select("doc_id", "start", "ids").mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def token_index(df: DataFrame, tokenizer_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Writes token files to the shared folder and gives, from the files read back, doc_id, start, n_tokens and ids_crc32.

    An empty table gives an empty result; other columns are ignored.
    """
    path = fresh_path(df.sparkSession, "tokens")
    write_tokens(df, tokenizer_path, path, id_column, text_column)
    return with_crc(read_tokens(df.sparkSession, path))
