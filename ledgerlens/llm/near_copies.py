"""Near copies: groups of texts whose five-word shingle sets have a Jaccard similarity of 0.8 or more.

Copies of one wording are merged first. Every distinct wording gets a SimHash
fingerprint of its shingle set, and those that differ in four bits or fewer are
found by multi-index hashing, as in ``op9_simhash``. That misses most pairs near
a similarity of 0.8, so every wording has MinHash values in bands too; two
wordings of similarity 0.8 share all values of one band at least with
probability 0.9999, and more similar ones with a higher one. Wordings that are
linked by fingerprints or share a band, directly or over others, are one
candidate component, and inside it every pair is decided by the exact similarity
of its shingle sets (64-bit hashes of shingles stand for the shingles). Nothing
but the fingerprints and bands is left to chance.

A candidate component of any size is cut into blocks of bounded size that are
compared block against block; pairs that are joined already are not compared
again, and each block pair reports a spanning part of its links. A wording goes
out once for each block of its component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm import simhash
from ledgerlens.llm.common import forget, marks_of, split_join, text_parts, with_mark, written
from ledgerlens.llm.contamination import SHINGLE, shingle_hashes
from ledgerlens.llm.simhash import components, majority, spanning

#: Similarity of near copies, as a fraction in whole numbers.
OVER, UNDER = 4, 5
#: MinHash bands, and values of each.
BANDS, ROWS = 40, 7
#: Wordings of one block, and shingles of one block, about.
BLOCK, BLOCK_SHINGLES = 256, 1 << 21
SEED = 23

_DRAW = np.random.default_rng(SEED)
_TURN = _DRAW.integers(1 << 31, size=(BANDS * ROWS, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_FOLD = _DRAW.integers(1 << 62, size=(BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def words_of(text: str) -> list[bytes]:
    """Words as ``op9_simhash`` has them: A-Z lower-cased, ended by ASCII white space."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def wording(words: list[bytes]) -> int:
    """Digest of a text's words, as a signed long; 0 without words."""
    number = xxhash.xxh64_intdigest(b" ".join(words), SEED) if words else 0
    return number - (1 << 64) if number >> 63 else number


def shingles(words: list[bytes]) -> np.ndarray:
    """Sorted hashes of the distinct shingles; fewer words than a shingle are one shingle."""
    digest = xxhash.xxh64_intdigest
    marks = np.fromiter((digest(w, SEED) for w in words), np.uint64, len(words))
    return np.unique(shingle_hashes(marks, min(SHINGLE, len(words)))) if words else marks


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One key for each band of a set of shingles, none for the empty set."""
    if not len(hashes):
        return np.empty(0, np.int64)
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint32).max, np.uint32)
    for k in range(0, len(short), 1024):
        np.minimum(least, (_TURN * short[None, k : k + 1024]).min(1), out=least)
    keys = (least.reshape(BANDS, ROWS).astype(np.uint64) * _FOLD).sum(1, dtype=np.uint64)
    keys = (keys ^ (keys >> np.uint64(31))) * _FOLD[:, 0]
    return (keys ^ (keys >> np.uint64(29))).view(np.int64)


def joined(left: list[np.ndarray], right: list[np.ndarray] | None = None) -> list[tuple[int, int]]:
    """Links of similarity 0.8 or more that join the same sets as all such links do.

    Sets are numbered from 0, those on the right after those on the left; pairs
    are compared within ``left``, or between both sides if there are two.
    """
    sets = left + (right or [])
    first, others = (len(left), len(sets)) if right is not None else (0, len(left))
    label = np.arange(len(sets))
    sizes = np.array([len(s) for s in sets], np.int64)
    values = np.concatenate(sets[first:others]) if others > first else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(others - first), sizes[first:others])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    links = []
    for a in range(len(left)):
        if (label[first:others] == label[a]).all():
            continue
        low, high = np.searchsorted(values, sets[a], "left"), np.searchsorted(values, sets[a], "right")
        runs = high - low
        at = np.repeat(low - (np.cumsum(runs) - runs), runs) + np.arange(runs.sum())
        shared = np.bincount(owner[at], minlength=others - first)
        near = UNDER * shared >= OVER * (sizes[a] + sizes[first:others] - shared)
        for b in (np.flatnonzero(near & (label[first:others] != label[a])) + first).tolist():
            if label[a] != label[b]:
                links.append((a, b))
                label[label == label[b]] = label[a]
    return links


def _signatures(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Of every row: id, hash of the row (id and text), hash of the text, wording, number of shingles, fingerprint, and band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, sizes, marks, keys = [], [], [], []
            for _, part in text_parts(batch, "t"):
                for text in part:
                    words = words_of(text)
                    own = shingles(words)
                    prints.append(wording(words))
                    sizes.append(len(own))
                    marks.append(majority(own))
                    keys.append(band_keys(own))
            columns = [*(batch.column(k) for k in range(3)), pa.array(prints, pa.int64()), pa.array(sizes, pa.int64()), pa.array(np.array(marks, np.uint64).view(np.int64)), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["i", "r", "h", "print", "size", "mark", "keys"])

    kind = df.schema[id_column].dataType.simpleString()
    held = df.select(F.col(id_column).alias("i"), F.xxhash64(id_column, text_column).alias("r"), F.xxhash64(text_column).alias("h"), F.col(text_column).alias("t"))
    return held.mapInArrow(run, f"i {kind}, r long, h long, print long, size long, mark long, keys array<long>")


_FILED = "key long, print long, low long"


def _filed(keys: np.ndarray, prints: np.ndarray, low: np.ndarray | None = None) -> pa.RecordBatch:
    low = pa.nulls(len(keys), pa.int64()) if low is None else pa.array(low)
    return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(prints), low], names=["key", "print", "low"])


def _file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a batch's wordings with one key, one is filed (low is null) and the others are chained to it (print, low)."""
    for batch in batches:
        lists = batch.column(1)
        keys = lists.flatten().to_numpy(zero_copy_only=False)
        prints = np.repeat(batch.column(0).to_numpy(), np.diff(lists.offsets.to_numpy()))
        order = np.argsort(keys, kind="stable")
        keys, prints = keys[order], prints[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
        low = np.repeat(prints[first], np.diff(np.r_[first, len(keys)]))
        yield _filed(keys[first], prints[first])
        far = prints != low
        if far.any():
            u, v = spanning(prints[far], low[far])
            yield _filed(u, u, v)


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between the wordings filed under one key, each to the first; rows come sorted by key. Chained rows pass."""
    held = np.empty(0, np.int64), np.empty(0, np.int64)
    for batch in batches:
        chained = batch.column(2).is_valid().to_numpy(zero_copy_only=False)
        keys, prints = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        u, v = [prints[chained]], [batch.column(2).drop_null().to_numpy()]
        keys, prints = np.r_[held[0], keys[~chained]], np.r_[held[1], prints[~chained]]
        if len(keys):
            first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            low = np.repeat(prints[first], np.diff(np.r_[first, len(keys)]))
            held = keys[-1:], low[-1:]
            u.append(prints[prints != low])
            v.append(low[prints != low])
        a, b = spanning(np.concatenate(u), np.concatenate(v))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["u", "v"])


def _first_of_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition's equal texts, the first."""
    seen = set()
    for batch in batches:
        yield batch.filter(pa.array([not (h in seen or seen.add(h)) for h in batch.column(0).to_pylist()], pa.bool_()))


def _compare(rows: pd.DataFrame) -> pd.DataFrame:
    """Links of one pair of blocks of a component."""
    rows = rows.drop_duplicates("print").sort_values("print")
    sides = [rows[rows["block"] == n] for n in sorted({int(rows["i"].iloc[0]), int(rows["j"].iloc[0])})]
    prints = [p for side in sides for p in side["print"].tolist()]
    links = joined(*([shingles(words_of(t)) for t in side["t"]] for side in sides))
    return pd.DataFrame({"u": np.array([prints[a] for a, _ in links], np.int64), "v": np.array([prints[b] for _, b in links], np.int64)})


def _wordings(signed: DataFrame) -> DataFrame:
    """Every wording: its rows, shingles, one of its texts, and its first row (the smallest id, null after all others)."""
    first = F.min(F.struct(F.isnull("i").alias("none"), "i", "r"))
    return signed.groupBy("print").agg(F.count("*").alias("n"), F.max("size").alias("size"), F.min("h").alias("h"), first.alias("first"))


def alike(signed: DataFrame) -> DataFrame:
    """Links (u, v) that join the wordings whose fingerprints (``mark``) differ in few bits, found by multi-index hashing; wordings of one fingerprint hang on the smallest."""
    own = written(signed.where("size > 0").groupBy("print").agg(F.min("mark").alias("mark")), "marked")
    first = written(own.groupBy("mark").agg(F.min("print").alias("low"), F.count("*").alias("n")), "marks")
    equal = split_join(own, first.where("n > 1"), "mark", own.count(), ["low"]).where("print <> low").select(F.col("print").alias("u"), F.col("low").alias("v"))
    near = written(simhash.links(first.select(F.col("mark").alias("print"))), "near-marks")
    ends = near.groupBy("v").agg(F.count("*").alias("n")).join(first.select(F.col("mark").alias("v"), "low"), "v")
    near = split_join(near, ends, "v", near.count(), ["low"]).select("u", F.col("low").alias("b")).join(first.select(F.col("mark").alias("u"), F.col("low").alias("a")), "u")
    return equal.unionByName(near.select(F.col("a").alias("u"), F.col("b").alias("v")))


def links(df: DataFrame, signed: DataFrame, wordings: DataFrame, text_column: str = "text", block: int = BLOCK) -> DataFrame:
    """Links (u, v) between wordings that join the same wordings as all pairs of similarity 0.8 or more that share a band or have fingerprints alike.

    A batch's wordings with one key are chained before the exchange, so a key
    of any number of wordings sends one row for each batch. Only the texts of
    candidates cross an exchange: a bounded bit set keeps the others back.
    """
    filed = signed.select("print", "keys").mapInArrow(_file, _FILED)
    chained = filed.repartition("key").sortWithinPartitions("key").mapInArrow(_chain, "u long, v long")
    chained = written(components(chained.unionByName(alike(signed))), "candidates")
    members = chained.select(F.col("node").alias("print"), "root").unionByName(chained.select(F.col("root").alias("print"), "root").distinct())
    members = written(members.join(wordings.select("print", "size", "h"), "print"), "members")
    forget(chained)
    parts = members.groupBy("root").agg(F.count("*").alias("n"), F.greatest(F.ceil(F.count("*") / F.lit(block)), F.ceil(F.sum("size") / F.lit(BLOCK_SHINGLES))).cast("int").alias("blocks"))
    placed = split_join(members, parts, "root", members.count(), ["blocks"])
    placed = placed.select("h", "print", "root", "blocks", F.pmod(F.xxhash64("print"), F.col("blocks")).cast("int").alias("block"))
    texts = with_mark(df.select(F.xxhash64(text_column).alias("h"), F.col(text_column).alias("t")), marks_of(members, "h"), "h", "near").where("near").select("h", "t")
    texts = texts.mapInArrow(_first_of_texts, "h long, t string")
    sent = texts.join(placed, "h").withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sent = sent.select("root", "block", "print", "t", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"))
    return sent.groupBy("root", "i", "j").applyInPandas(_compare, "u long, v long").distinct()


def _members(signed: DataFrame, df: DataFrame, text_column: str, block: int) -> tuple[DataFrame, int]:
    """Every wording with its group's first row (``keep``: the smallest id, then the smallest wording), and its own number of rows; and the rows of all."""
    wordings = written(_wordings(signed), "wordings")
    found = components(links(df, signed, wordings, text_column, block))
    member = wordings.join(found, wordings["print"] == found["node"], "left").select("print", "first", "n", F.coalesce("root", "print").alias("root"))
    member = written(member, "grouped")
    forget(wordings)
    total = member.agg(F.count("*").alias("prints"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    least = F.min(F.struct(F.col("first.none"), F.col("first.i"), "print", F.col("first.r").alias("r")))
    lowest = member.groupBy("root").agg(F.count("*").alias("n"), F.sum("n").alias("all"), least.alias("keep"))
    out = split_join(member.withColumnRenamed("n", "rows"), lowest, "root", total["prints"], ["keep", "all"])
    return written(out.select("print", "keep", "all", F.col("rows").alias("n")), "components"), total["rows"]


def groups(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per input row: id, print (its wording) and component_id, the smallest id of its group of near copies.

    Null texts, empty ones and those without words are copies of each other; a
    null id is never the smallest (a group of null ids alone has a null
    component_id). Other columns are ignored; an empty table gives an empty result.
    """
    signed = written(_signatures(df, id_column, text_column), "signatures")
    members, rows = _members(signed, df, text_column, block)
    out = split_join(signed.select("i", "print"), members, "print", rows, ["keep"])
    return out.select(F.col("i").alias(id_column), "print", F.col("keep.i").alias("component_id"))


def kept(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", block: int = BLOCK) -> DataFrame:
    """One row of each group of near copies, with all its columns: the smallest id, then the smallest wording; ids may repeat.

    Rows that may go, or of which only one may stay, are found by a bounded bit
    set of their hashes; they alone cross an exchange and are decided exactly.
    """
    signed = written(_signatures(df, id_column, text_column), "signatures")
    members, rows = _members(signed, df, text_column, block)
    gone = split_join(signed.select("print", "r"), members.where("all > 1"), "print", rows, ["keep"]).where(F.col("r") != F.col("keep.r"))
    gone = written(gone.select("r").distinct(), "gone")
    repeated = signed.groupBy("r").agg(F.count("*").alias("n")).where("n > 1").select("r")
    marks = written(marks_of(gone.unionByName(repeated), "r"), "marks")
    key = "__row"
    while key in df.columns:
        key += "_"
    judged = with_mark(df.withColumn(key, F.xxhash64(id_column, text_column)), marks, key, f"{key}?")
    sure = judged.where(~F.col(f"{key}?"))
    asked = judged.where(F.col(f"{key}?")).dropDuplicates([key])
    asked = asked.join(gone.withColumnRenamed("r", key), key, "left_anti").select(*sure.columns)
    return sure.unionByName(asked).select(*df.columns)
