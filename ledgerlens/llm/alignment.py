"""Tokens of two tokenizers over the same text, linked where their byte ranges share a group.

A transducer reads the two sequences and holds which side leads and by which
bytes. A leading side's unmatched bytes are the end of its last token, so there
are at most as many states as the tokens of both vocabularies have endings.
From a state, the next token of the side that is behind leads to the next state;
steps are remembered by state and token. When nothing is unmatched, both sides
end at one byte, and a group is closed.

Both tokenizers cut texts at the places that ``segments`` cuts at, so every
distinct segment is aligned once and remembered.

How many documents hold an id pair is counted over all documents. Every document
then needs the counts of its pairs: those of the most frequent pairs, a table of
bounded size, go to all tasks, and the rest, which are rare by definition, meet
their counts in a join.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import forget, written
from ledgerlens.llm.segments import ByteEncoder, Ragged, SegmentMemo, cut, text_bytes

MARK = "▁"
#: Distinct segments of a worker's memo, and pairs that it holds.
WORDS, HELD = 250_000, 4_000_000
#: Bytes of texts that are aligned at once.
PART = 1 << 20
#: Steps that a transducer remembers.
STEPS = 2_000_000
#: Pairs whose counts go to all tasks, at most.
FREQUENT = 1 << 20
#: A group of more links than this is linked by its distinct ids and how often they come.
WIDE = 256


class Transducer:
    """Groups of two token sequences whose bytes are the same."""

    def __init__(self, left: Sequence[bytes], right: Sequence[bytes]):
        self.tokens = left, right
        self.steps: dict[int, int] = {}
        #: By state: 0 if the left side leads or nothing is unmatched, then which side's token comes next, and the unmatched bytes.
        self.states: dict[tuple[int, bytes], int] = {(0, b""): 0}
        self.next_side, self.rest = [0], [b""]

    def _step(self, state: int, token: int) -> int:
        side, rest = self.next_side[state], self.rest[state]
        own = self.tokens[side][token]
        if len(own) < len(rest):
            if not own or not rest.startswith(own):
                return -1
            new = side, rest[len(own) :]
        elif not own or not own.startswith(rest):
            return -1
        else:
            new = (1 - side, own[len(rest) :]) if len(own) > len(rest) else (0, b"")
        found = self.states.get(new)
        if found is None:
            found = self.states[new] = len(self.rest)
            self.next_side.append(new[0])
            self.rest.append(new[1])
        return found

    def groups(self, left: Sequence[int], right: Sequence[int]) -> tuple[list[int], list[int]] | None:
        """Where each group ends in both sequences; None if their bytes differ."""
        if len(self.steps) > STEPS:
            self.steps.clear()
        steps, next_side = self.steps, self.next_side
        i = j = state = 0
        many_left, many_right = len(left), len(right)
        ends_left, ends_right = [], []
        while True:
            if next_side[state]:
                if j == many_right:
                    return None
                token = right[j]
                j += 1
            elif i < many_left:
                token = left[i]
                i += 1
            else:
                return (ends_left, ends_right) if not state and j == many_right else None
            key = state << 24 | token
            new = steps.get(key)
            if new is None:
                new = steps[key] = self._step(state, token)
            if not new:
                ends_left.append(i)
                ends_right.append(j)
            elif new < 0:
                return None
            state = new


class PieceEncoder:
    """Ids of segments by the sentencepiece model at ``path``, and its pieces' bytes.

    The model puts a word mark before a text. A segment that begins with a space
    goes in without it; another one that stands inside a text loses the id of
    the mark again. Refuses a model that changes texts, joins across words or
    lines, or lacks byte pieces.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = model = sentencepiece.SentencePieceProcessor(model_file=path)
        size, odd = model.vocab_size(), "  a  \t\u00a0 ﬁ\r \n "
        shown = [model.id_to_piece(k) for k in range(size)]
        plain = [not (model.is_control(k) or model.is_unknown(k) or model.is_unused(k) or model.is_byte(k)) for k in range(size)]
        if any(p and (MARK in t.lstrip(MARK) or "\n" in t) for t, p in zip(shown, plain)) or sum(map(model.is_byte, range(size))) != 256 or model.decode(model.encode(odd)) != odd:
            raise ValueError(f"{path}: texts do not fall apart into words")
        self.tokens = [bytes([int(t[3:5], 16)]) if model.is_byte(k) else t.replace(MARK, " ").encode() if plain[k] else b"" for k, t in enumerate(shown)]
        self.mark = model.piece_to_id(MARK)

    def __call__(self, segments: list[str]) -> list[list[int]]:
        """The ids of segments that stand behind a space, as every text does, or begin with one."""
        found = self.model.encode([s[1:] if s[0] == " " else s for s in segments], num_threads=1)
        for k, s in enumerate(segments):
            if s == " ":
                found[k] = [self.mark]
            elif s[0] != " ":
                if found[k][0] != self.mark:
                    raise RuntimeError("the mark before a text was joined to a line")
                del found[k][0]
        return found


class _Links:
    """What segments give: ids of both sides, groups and links."""

    def __init__(self, byte_path: str, piece_path: str):
        self.left, self.right = ByteEncoder(byte_path, plain=True), PieceEncoder(piece_path)
        self.transducer = Transducer(self.left.tokens, self.right.tokens)
        self.base = len(self.right.tokens)
        digits = [str(k) for k in range(max(len(self.left.tokens), self.base))]
        #: The decimals of ids with what stands behind them.
        self.shown = [d + stop for stop in ",|;" for d in digits]
        self.widths, self.ids = np.array([len(s) for s in self.shown]), len(digits)
        self.counts, self.pairs, self.times = Ragged(np.int64), Ragged(np.int64), Ragged(np.int64)
        self.clear()

    def clear(self) -> None:
        for own in (self.counts, self.pairs, self.times):
            own.clear()
        self.texts: list[str] = []

    def full(self) -> bool:
        return self.pairs.used > HELD

    def add(self, segments: list[str]) -> None:
        if not segments:
            return
        ids, many_left = self.left(segments)
        found = self.right(segments)
        many_right = np.fromiter(map(len, found), np.int64, len(found))
        left, right = ids.astype(np.int64), np.fromiter(chain.from_iterable(found), np.int64, int(many_right.sum()))
        ends = self.transducer.groups(left.tolist(), right.tolist())
        bad = np.zeros(len(segments), bool)
        if ends is None:
            # some segments' bytes differ: they are found one by one and left out of the rest
            own = np.split(left, np.cumsum(many_left)[:-1])
            bad[:] = [self.transducer.groups(a.tolist(), b) is None for a, b in zip(own, found)]
            left, right = left[~np.repeat(bad, many_left)], right[~np.repeat(bad, many_right)]
            many_left[bad] = many_right[bad] = 0
            ends = self.transducer.groups(left.tolist(), right.tolist())
        stop_left, stop_right = (np.array(e, np.int64) for e in ends)
        n_left, n_right = np.diff(stop_left, prepend=0), np.diff(stop_right, prepend=0)
        segment = np.searchsorted(np.cumsum(many_left), stop_left)
        links = np.r_[0, np.cumsum(n_left * n_right)]
        edges = np.searchsorted(segment, np.arange(len(segments) + 1))
        self.counts.add(np.stack([many_left, many_right, np.diff(edges), np.diff(links[edges]), bad], 1).ravel(), np.full(len(segments), 5))
        keys, times = self._pairs(left, right, stop_left - n_left, stop_right - n_right, n_left, n_right, segment)
        many = np.bincount(keys >> 36, minlength=len(segments))
        self.pairs.add(keys & ((1 << 36) - 1), many)
        self.times.add(times, many)
        self._show(left, right, stop_left, stop_right, n_left, n_right, many_left + many_right)

    def _pairs(self, left, right, from_left, from_right, n_left, n_right, segment) -> tuple[np.ndarray, np.ndarray]:
        """Distinct segment numbers (times 2**36) plus id pairs of all groups' links, and how often each comes."""
        narrow = n_left * n_right <= WIDE
        size, per = (n_left * n_right)[narrow], n_right[narrow]
        place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        per = np.repeat(per, size)
        a, b = left[np.repeat(from_left[narrow], size) + place // per], right[np.repeat(from_right[narrow], size) + place % per]
        keys, times = [np.repeat(segment[narrow], size) << 36 | a * self.base + b], [np.ones(len(a), np.int64)]
        for g in np.flatnonzero(~narrow).tolist():
            (a, n), (b, m) = (np.unique(x[f : f + k], return_counts=True) for x, f, k in ((left, from_left[g], n_left[g]), (right, from_right[g], n_right[g])))
            keys.append(int(segment[g]) << 36 | (a[:, None] * self.base + b[None, :]).ravel())
            times.append((n[:, None] * m[None, :]).ravel())
        return _summed(np.concatenate(keys), np.concatenate(times))

    def _show(self, left, right, stop_left, stop_right, n_left, n_right, many) -> None:
        """Enters each segment's groups as text: decimals in the order of groups, left ids before right ids."""
        order = np.empty(len(left) + len(right), np.int64)
        order[np.arange(len(left)) + np.repeat(stop_right - n_right, n_left)] = left
        order[np.arange(len(right)) + np.repeat(stop_left, n_right)] = right
        order[stop_left + stop_right - n_right - 1] += self.ids
        order[stop_left + stop_right - 1] += 2 * self.ids
        text = "".join(map(self.shown.__getitem__, order.tolist()))
        ends = np.r_[0, np.cumsum(self.widths[order])][np.cumsum(many)].tolist()
        self.texts += [text[a : b - 1] if b > a else "" for a, b in zip([0, *ends[:-1]], ends)]


@lru_cache(maxsize=1)
def memo(byte_path: str, piece_path: str, words: int = WORDS) -> SegmentMemo:
    """One memo for a worker and pair of files; every node has the files at these paths."""
    return SegmentMemo(_Links(byte_path, piece_path), words)


def _summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, and the weights summed for each."""
    if not len(keys):
        return keys, weights
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(weights[order], first)


def _of_texts(own: SegmentMemo, raw: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: counts (ids of both sides, groups, links) and the digest of its groups; and of all texts the text number, id pair and how often they are linked."""
    begins, lengths, counts = cut(raw, sizes)
    entry = own.numbers(raw, begins, lengths)
    store = own.store
    edges = np.r_[0, np.cumsum(counts)]
    sums = np.r_[np.zeros((1, 5), np.int64), np.cumsum(store.counts.take(entry)[0].reshape(-1, 5), 0)]
    figures = sums[edges[1:]] - sums[edges[:-1]]
    whole = figures[:, 4] == 0
    figures[~whole] = 0
    texts, numbers = store.texts, entry.tolist()
    digests = [hashlib.sha256(";".join([texts[e] for e in numbers[a:b]]).encode()).hexdigest() if ok and b > a else "" for a, b, ok in zip(edges[:-1].tolist(), edges[1:].tolist(), whole.tolist())]
    doc = np.repeat(np.arange(len(sizes)), counts)
    used = whole[doc]
    keys, often = np.unique(doc[used] << 32 | entry[used], return_counts=True)
    rows = keys & 0xFFFFFFFF
    pairs, many = store.pairs.take(rows)
    times = store.times.take(rows)[0] * np.repeat(often, many)
    keys, times = _summed(np.repeat(keys >> 32, many) << 36 | pairs, times)
    return figures[:, :4], digests, keys >> 36, keys & ((1 << 36) - 1), times


def linked(df: DataFrame, byte_path: str, piece_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Each document's links: row (unique), the id, n_a, n_b, n_groups, n_links, groups_sha256, its distinct id pairs (left id times the size of the right vocabulary, plus right id) and how often each is linked.

    The left side encodes a space and the text; so does the right side, which adds the space itself.
    """
    kind = df.schema[id_column].dataType.simpleString()
    names = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, done = memo(byte_path, piece_path), TaskContext.get().partitionId() << 33
        for batch in batches:
            for first, raw, sizes in text_bytes(batch, "t", PART):
                figures, digests, doc, pairs, times = _of_texts(own, raw, sizes)
                offsets = pa.array(np.searchsorted(doc, np.arange(len(sizes) + 1)).astype(np.int32))
                columns = [
                    pa.array(done + np.arange(len(sizes))), batch.column(0).slice(first, len(sizes)), *(pa.array(np.ascontiguousarray(c)) for c in figures.T), pa.array(digests, pa.string()),
                    pa.ListArray.from_arrays(offsets, pa.array(pairs)), pa.ListArray.from_arrays(offsets, pa.array(times)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)
                done += len(sizes)

    text = F.when(F.col(text_column).cast("string") != "", F.concat(F.lit(" "), F.col(text_column).cast("string")))
    return df.select(F.col(id_column).alias("doc_id"), text.alias("t")).mapInArrow(run, f"row long, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>")


def frequent_pairs(counts: DataFrame, most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of the highest powers of two of counts that are at most ``most`` pairs together, sorted, with their counts."""
    level = F.floor(F.log2("n")).cast("int")
    held, least = 0, None
    for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("pairs")).orderBy(F.desc("level")).collect():  # a row for each power of two
        held += r.pairs
        if held > most:
            break
        least = r.level
    if least is None:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    found = counts.where(level >= least).select("pair", "n").toArrow()
    pair, n = (found.column(c).to_numpy().astype(np.int64) for c in ("pair", "n"))
    order = np.argsort(pair)
    return pair[order], n[order]


def aligned(df: DataFrame, byte_path: str, piece_path: str, id_column: str = "doc_id", text_column: str = "text", most: int = FREQUENT) -> DataFrame:
    """The figures of every document's alignment, and of its links by how many documents hold them.

    Columns: id, n_a, n_b, n_groups, n_links, n_best (links whose id pair no pair
    of the same left id exceeds in documents), count_sum (documents of the pair,
    summed over links), groups_sha256. Texts that are null or empty, or whose
    tokens do not give the text's bytes back (those that hold a word mark), have
    no tokens: zeros and the empty text. Repeated rows and null ids are documents
    like any other; other columns are ignored; an empty table gives an empty
    result.
    """
    spark = df.sparkSession
    docs = written(linked(df, byte_path, piece_path, id_column, text_column), "links")
    base = _vocabulary(piece_path)
    counts = written(docs.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")), "pair-counts")
    best = counts.groupBy(F.expr(f"pair div {base}").alias("a")).agg(F.max("n").alias("most"))  # a row for each left id at most
    pair, n = frequent_pairs(counts, most)
    top = {r.a: r.most for r in best.collect()}
    highest = np.zeros(max(top, default=0) + 1, np.int64)
    for a, m in top.items():
        highest[a] = m
    sent = spark.sparkContext.broadcast((pair, n, n == highest[pair // base]))  # bounded by ``most``
    kept = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, is_best = sent.value
        for batch in batches:
            pairs, times = batch.column(len(kept)), batch.column(len(kept) + 1)
            offsets = pairs.offsets.to_numpy()
            own, often = (c.flatten().to_numpy() for c in (pairs, times))
            at = np.searchsorted(pair, own)
            known = np.flatnonzero(pair[np.minimum(at, len(pair) - 1)] == own) if len(pair) else np.empty(0, np.int64)
            sums = np.zeros((2, len(own) + 1), np.int64)
            sums[0, known + 1] = often[known] * is_best[at[known]]
            sums[1, known + 1] = often[known] * n[at[known]]
            sums = sums.cumsum(1)
            edges = offsets - offsets[0]
            rest = np.ones(len(own), bool)
            rest[known] = False
            left = pa.array(np.r_[0, np.cumsum(rest)][edges].astype(np.int32))
            lists = [pa.ListArray.from_arrays(left, pa.array(v[rest])) for v in (own, often)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *(pa.array(s[edges[1:]] - s[edges[:-1]]) for s in sums), *lists], names=[*kept, "n_best", "count_sum", "pairs", "times"])

    fields = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in kept)
    scored = written(docs.select(*kept, "pairs", "times").mapInArrow(score, f"{fields}, n_best long, count_sum long, pairs array<long>, times array<long>"), "scored")
    forget(docs)
    rare = scored.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("z")).select("row", F.col("z.pairs").alias("pair"), F.col("z.times").alias("times"))
    rare = rare.join(counts, "pair").withColumn("a", F.expr(f"pair div {base}")).join(F.broadcast(best), "a")
    more = rare.groupBy("row").agg(F.sum(F.when(F.col("n") == F.col("most"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
    out = scored.drop("pairs", "times").join(more, "row", "left")
    total = [(F.col(c) + F.coalesce(m, F.lit(0))).alias(c) for c, m in (("n_best", "more_best"), ("count_sum", "more_sum"))]
    return out.select(F.col("doc_id").alias(id_column), "n_a", "n_b", "n_groups", "n_links", *total, "groups_sha256")


def _vocabulary(piece_path: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=piece_path).vocab_size()
