"""SimHash near-duplicate groups by multi-index hashing.

A text's fingerprint is the bitwise majority of the XXH64 (seed 42) of its word
shingles. Two fingerprints link when they differ in at most four bits. A
64-bit fingerprint is cut into two 32-bit segments: of two fingerprints that
differ in four bits or fewer, one segment differs in two bits or fewer, so the
balls of radius one around the two segment values share a member. Every
distinct fingerprint is filed under the members of the balls of its segments
(66 table entries); entries that meet are compared over all 64 bits.

Nothing is lost to skew: equal fingerprints are merged before the search. The
entries of a long list share a segment's value but for a bit, so they are filed
again under the other segment, where that leaves fewer pairs to compare: it
differs in four bits or fewer, so of its two 16-bit parts one differs in two or
fewer, and the balls of radius one around the two part values share a member. A
list that is long even then is cut into blocks of bounded size that are compared
block against block. Only a spanning forest of links is reported, never all
pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import forget, split_join, text_parts, written

#: Entries of one table list that are compared at once.
BLOCK = 2048
#: Links that a task holds before it keeps a spanning part of them.
HELD = 1 << 20
MAX_DISTANCE = 4
SEED = 42


def fingerprint(text: str, words_per_shingle: int = 4) -> int:
    """Majority fingerprint of a text; a text without words has fingerprint zero.

    A-Z are lower-cased, words end at ASCII white space, shingles are counted
    with repeats, and a text of fewer words than a shingle is one shingle.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= words_per_shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - words_per_shingle + 1].tolist()
    ends = ends[words_per_shingle - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends)), np.uint64, len(starts))
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of some unsigned 64-bit hashes."""
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 16384):
        bits = np.unpackbits(hashes[k : k + 16384].view(np.uint8), bitorder="little").reshape(-1, 64)
        counts += bits.sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def with_fingerprints(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", words_per_shingle: int = 4) -> DataFrame:
    """Ids with their fingerprints as signed longs. Null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t, words_per_shingle) for _, part in text_parts(batch, "t") for t in part], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=["i", "print"])

    kind = df.schema[id_column].dataType.simpleString()
    return df.select(F.col(id_column).alias("i"), F.col(text_column).alias("t")).mapInArrow(run, f"i {kind}, print long")


def spanning(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star forest with the components of the given links: (member, smallest member)."""
    nodes, index = np.unique(np.concatenate([left, right]), return_inverse=True)
    a, b = index[: len(left)], index[len(left) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    rest = label != np.arange(len(nodes))
    return nodes[rest], nodes[label[rest]]


def _links(key: np.ndarray, bit: np.ndarray, prints: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs among entries sorted by (key, bit); entries flipped at one and the same bit meet unflipped elsewhere."""
    found_a, found_b = [], []
    at = np.arange(len(key))
    step, size = 1, 0
    while len(at):
        at = at[at + step < len(key)]
        at = at[key[at] == key[at + step]]
        other = at + step
        fit = (bit[at] != bit[other]) | (bit[at] == 0)
        i, j = at[fit], other[fit]
        near = np.bitwise_count((prints[i] ^ prints[j]).view(np.uint64)) <= distance
        near &= prints[i] != prints[j]
        if near.any():
            found_a.append(prints[i[near]])
            found_b.append(prints[j[near]])
            size += len(found_a[-1])
            if size > HELD:
                # of many links a spanning part goes on
                a, b = spanning(np.concatenate(found_a), np.concatenate(found_b))
                found_a, found_b, size = [a], [b], 0
        step += 1
    if not found_a:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return spanning(np.concatenate(found_a), np.concatenate(found_b))


_ENTRY = "key long, block int, bit int, print long"


def _record(key, block, bit, prints) -> pa.RecordBatch:
    n = len(prints)
    full = lambda x, kind: pa.array(np.full(n, x, kind) if np.isscalar(x) else np.asarray(x, kind))
    return pa.RecordBatch.from_arrays([full(key, np.int64), full(block, np.int32), full(bit, np.int32), pa.array(np.asarray(prints, np.int64))], names=["key", "block", "bit", "print"])


def _meet(distance: int, block: int):
    """Compares sorted entries list by list. Lists over ``block`` entries pass through, numbered by blocks.

    Links come out with block -1, as (key: member, print: smallest member).
    """

    def whole(key, bit, prints):
        a, b = _links(key, bit, prints, distance)
        if len(a):
            yield _record(a, -1, 0, b)

    def passed(key, bit, prints, number):
        """A piece of a long list, cut into blocks that are numbered from ``number``."""
        for k in range(0, len(key), block):
            yield _record(key[k : k + block], number, bit[k : k + block], prints[k : k + block])
            number += 1

    def split(key, bit, prints):
        """Whole lists: compares the short ones together, passes the long ones through."""
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[starts, len(key)])
        for s, n in zip(starts[sizes > block].tolist(), sizes[sizes > block].tolist()):
            yield from passed(key[s : s + n], bit[s : s + n], prints[s : s + n], 0)
        # a list of one entry, or one whose entries were all flipped at the same bit, has nothing to compare
        flat = (sizes < 2) | (sizes > block) | ((bit[starts] == bit[starts + sizes - 1]) & (bit[starts] > 0))
        use = ~np.repeat(flat, sizes)
        if use.any():
            yield from whole(key[use], bit[use], prints[use])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int64)]
        long_key, number = None, 0
        for record in batches:
            new = [record.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 2)]
            if long_key is not None:
                n = int(np.searchsorted(new[0], long_key, "right"))
                yield from passed(*(x[:n] for x in new), number)
                number += -(-n // block)
                new = [x[n:] for x in new]
            if not len(new[0]):
                continue
            long_key = None
            held = [np.concatenate(x) for x in zip(held, new)]
            last = int(np.searchsorted(held[0], held[0][-1], "left"))
            if last:
                yield from split(*(x[:last] for x in held))
                held = [x[last:] for x in held]
            if len(held[0]) > block:
                long_key, number = held[0][0], -(-len(held[0]) // block)
                yield from passed(*held, 0)
                held = [x[:0] for x in held]
        if len(held[0]):
            yield from split(*held)

    return run


def _block_pair(distance: int):
    def run(batches):
        """One pair of blocks of a long list, as a pandas frame of at most two blocks."""
        left, right = batches[batches["block"] == batches["i"]], batches[batches["block"] == batches["j"]]
        out_a, out_b = [], []
        p, q = left["print"].to_numpy(), right["print"].to_numpy()
        pb, qb = left["bit"].to_numpy(), right["bit"].to_numpy()
        for k in range(0, len(p), 256):
            near = np.bitwise_count((p[k : k + 256, None] ^ q[None, :]).view(np.uint64)) <= distance
            near &= (pb[k : k + 256, None] != qb[None, :]) | (qb[None, :] == 0)
            a, b = np.nonzero(near)
            a, b = p[a + k], q[b]
            rest = a != b
            if rest.any():
                a, b = spanning(a[rest], b[rest])
                out_a.append(a)
                out_b.append(b)
        if not out_a:
            return pd.DataFrame({"u": np.empty(0, np.int64), "v": np.empty(0, np.int64)})
        a, b = spanning(np.concatenate(out_a), np.concatenate(out_b))
        return pd.DataFrame({"u": a, "v": b})

    return run


def links(prints: DataFrame, distance: int = MAX_DISTANCE, block: int = BLOCK) -> DataFrame:
    """Links (u, v), v < u, with the components of "differs in at most ``distance`` bits".

    ``prints`` has one long column ``print`` without repeats. Links are a
    spanning part of all links: every chain of links joins the same members.
    """
    if distance > 5:
        raise ValueError("balls of radius one around two segments find at most five differing bits")
    masks = F.array(*[F.lit(0)] + [F.lit(1 << k) for k in range(32)])
    masks = F.transform(masks, lambda m: m.cast("long"))
    low = F.col("print").bitwiseAND(F.lit((1 << 32) - 1))
    high = F.shiftrightunsigned(F.col("print"), 32)
    top = 1 << 32

    def entries(segment, offset):
        return F.transform(masks, lambda m, k: F.struct((segment.bitwiseXOR(m) + F.lit(offset)).alias("key"), k.cast("int").alias("bit")))

    filed = prints.select("print", F.explode(F.concat(entries(low, 0), entries(high, top))).alias("e"))
    filed = filed.select(F.col("e.key").alias("key"), F.col("e.bit").alias("bit"), "print")
    met = filed.repartition("key").sortWithinPartitions("key", "bit").mapInArrow(_meet(distance, block), _ENTRY)
    met = written(met, "simhash-met")
    short = met.where("block = -1").select(F.col("key").alias("u"), F.col("print").alias("v"))
    long = met.where("block >= 0")
    again = _filed_again(long, low, high, top)
    # a list goes on by the way that compares fewer pairs: copies that are near in both segments stay together in either
    kept = long.groupBy("key").agg(F.count("*").alias("n"))
    cost = again.groupBy("list", "key").agg(F.count("*").alias("m")).groupBy("list").agg(F.sum(F.col("m") * F.col("m")).alias("cost"))
    ways = written(kept.join(cost, kept["key"] == cost["list"]).select("list", (F.col("cost") < F.col("n") * F.col("n")).alias("deep")), "simhash-ways")
    deep = again.join(ways.where("deep"), "list", "left_semi").select("key", "bit", "print").repartition("key").sortWithinPartitions("key", "bit")
    deep = written(deep.mapInArrow(_meet(distance, block), _ENTRY), "simhash-deep")
    short = short.unionByName(deep.where("block = -1").select(F.col("key").alias("u"), F.col("print").alias("v")))
    flat = long.join(ways.where("NOT deep").select(F.col("list").alias("key")), "key", "left_semi")
    long = flat.unionByName(deep.where("block >= 0"))
    last = long.groupBy("key").agg(F.max("block").alias("last"))
    pairs = long.join(last, "key").select("key", "block", "bit", "print", F.explode(F.sequence(F.lit(0), "last")).alias("o"))
    pairs = pairs.select("key", "block", "bit", "print", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"))
    more = pairs.groupBy("key", "i", "j").applyInPandas(_block_pair(distance), "u long, v long")
    return short.unionByName(more).distinct()


def _filed_again(long: DataFrame, low, high, top: int) -> DataFrame:
    """Entries of long lists (``list``) under keys of the list and the members of the balls around the parts of the other segment."""
    other = F.when(F.col("key") >= F.lit(top), low).otherwise(high)
    masks = F.transform(F.array(*[F.lit(0)] + [F.lit(1 << k) for k in range(16)]), lambda m: m.cast("long"))
    parts = [other.bitwiseAND(F.lit(0xFFFF)), F.shiftrightunsigned(other, 16).bitwiseAND(F.lit(0xFFFF))]

    def around(number: int):
        return F.transform(masks, lambda m: F.xxhash64(F.col("key"), F.lit(number), parts[number].bitwiseXOR(m)))

    keys = F.concat(around(0), around(1))
    # entries of the list that were flipped at one bit meet elsewhere too, but all are compared here
    return long.select(F.col("key").alias("list"), F.explode(keys).alias("key"), F.lit(0).alias("bit"), "print")


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, root): the smallest node of every linked node's component, by alternating large and small stars.

    ``edges`` has long columns u and v. Each round is written to the shared
    folder, so a lost executor costs one round. Nodes that hold a large share of
    all links are joined apart from the others.
    """
    now = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "stars")
    mark = None
    for _ in range(rounds):
        count = now.count()
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        large = split_join(both.where("v > u"), least, "u", 2 * count, ["m"]).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = split_join(large, smallest, "u", 2 * count, ["m"]).select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(smallest.select("u", F.col("m").alias("v")))
        before, now = now, written(small.where("u <> v").distinct(), "stars")
        forget(before)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = seen
    raise RuntimeError("components did not settle")


def near_duplicate_groups(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", words_per_shingle: int = 4, distance: int = MAX_DISTANCE, block: int = BLOCK) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits) and component_id, the smallest id reachable over links.

    Null and empty texts have fingerprint zero and link like any other text;
    repeated rows stay repeated; a null id belongs to its component and is
    never its smallest (a component of null ids alone has a null
    component_id). Other columns are ignored. An empty table gives an empty result.
    """
    prints = written(with_fingerprints(df, id_column, text_column, words_per_shingle), "fingerprints")
    first = prints.groupBy("print").agg(F.min("i").alias("low"), F.count("*").alias("n"))
    first = written(first, "distinct-prints")
    joined = components(links(first.select("print"), distance, block))
    member = first.join(joined, first["print"] == joined["node"], "left").select("print", "low", "n", F.coalesce("root", "print").alias("root"))
    member = written(member, "members")
    forget(first)
    total = member.agg(F.count("*").alias("prints"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    lowest = member.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("n"))
    found = split_join(member.withColumnRenamed("n", "rows"), lowest, "root", total["prints"], ["component_id"])
    found = written(found.select("print", "component_id", F.col("rows").alias("n")), "components")
    out = split_join(prints, found, "print", total["rows"], ["component_id"])
    return out.select(F.col("i").alias(id_column), F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")
