import random

import numpy as np
import pytest
import xxhash

from ledgerlens.llm import simhash

ALPHABET = "abcdefgh"


def slow_print(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints, distance=4):
    parent = {p: p for p in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in prints:
        for b in prints:
            if a != b and (a ^ b).bit_count() <= distance:
                parent[find(a)] = find(b)
    return {p: find(p) for p in prints}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("text", ["", " \t\n", "One", "a b c", "A b\x0bc D", "É é x b c d e", "a b c d " * 3000])
def test_fingerprint_matches_slow_form(text):
    assert simhash.fingerprint(text) == slow_print(text)


@pytest.mark.parametrize("block", [3, 2048])
def test_links_join_the_same_components(spark, block):
    rng = random.Random(3)
    prints = set()
    for _ in range(12):
        seed = rng.getrandbits(64)
        prints.add(seed)
        for _ in range(rng.choice([1, 3, 25])):
            prints.add(seed ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 7))))
    frame = spark.createDataFrame([(signed(p),) for p in prints], "print long").repartition(3)
    edges = [(r.u, r.v) for r in simhash.links(frame, block=block).collect()]
    got = {}
    for r in simhash.components(spark.createDataFrame(edges, "u long, v long")).collect():
        got[r.node] = r.root
    want = slow_components(prints)
    groups = {}
    for p, root in want.items():
        groups.setdefault(root, []).append(signed(p))
    for members in groups.values():
        roots = {got.get(m, m) for m in members}
        assert roots == {min(members)}


def test_groups_with_nulls_repeats_and_other_columns(spark):
    text = " ".join(f"w{k}" for k in range(200))
    rows = [(5, text, 1, 0), (3, text, 2, 0), (3, text, 2, 0), (9, None, 1, 0), (8, "", 1, 0), (None, text, 1, 0), (7, "alone here", 1, 0)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, print int, component_id int")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.fingerprint, r.component_id) for r in simhash.near_duplicate_groups(frame).collect())
    mark = format(slow_print(text), "016x")
    alone = format(slow_print("alone here"), "016x")
    zero = "0" * 16
    assert got == sorted([(False, 5, mark, 3), (False, 3, mark, 3), (False, 3, mark, 3), (True, 0, mark, 3), (False, 9, zero, 8), (False, 8, zero, 8), (False, 7, alone, 7)])


def test_empty_table(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicate_groups(frame).collect() == []


def test_spanning_is_a_forest():
    a, b = simhash.spanning(np.array([1, 2, 9]), np.array([2, 3, 8]))
    assert sorted(zip(a.tolist(), b.tolist())) == [(2, 1), (3, 1), (9, 8)]


@pytest.mark.parametrize("low", [True, False])
def test_a_segment_that_many_share(spark, low):
    """Lists far over the block are filed again and few of their entries are left to compare block against block; no link is lost."""
    rng = np.random.default_rng(7)
    shared, halves = 0x5A5A1234, rng.integers(0, 1 << 32, 1500, dtype=np.uint64)
    # chains of near ones, in the other half and in the shared one
    near = halves[:300] ^ (np.uint64(1) << rng.integers(0, 32, 300).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 32, 300).astype(np.uint64))
    other = np.concatenate([halves, near])
    mine = np.full(len(other), shared, np.uint64)
    mine[-150:] ^= np.uint64(1) << rng.integers(0, 32, 150).astype(np.uint64)
    prints = np.unique(other << np.uint64(32) | mine if low else mine << np.uint64(32) | other)
    frame = spark.createDataFrame([(int(p),) for p in prints.view(np.int64)], "print long").repartition(3)
    edges = [(r.u, r.v) for r in simhash.links(frame, block=64).collect()]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    same = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 4
    label = np.arange(len(prints))
    for _ in range(20):
        label = np.array([label[row].min() for row in same])
    own = prints.view(np.int64)
    lowest = {}
    for p, k in zip(own.tolist(), label.tolist()):
        lowest[k] = min(p, lowest.get(k, p))
    assert all(got.get(p, p) == lowest[k] for p, k in zip(own.tolist(), label.tolist())) and len(got) >= 300
