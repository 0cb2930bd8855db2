import zlib
from collections import Counter

import numpy as np
import pytest

from ledgerlens.llm import sharding


def test_matrix_has_exact_sums():
    sizes = np.array([5, 0, 17, 3, 40, 1, 1])
    before = np.r_[0, np.cumsum(sizes)]
    room = sharding.shard_sizes(int(sizes.sum()), 9)
    matrix = np.array([sharding.matrix_row(before, room, p, 3) for p in range(len(sizes))])
    assert (matrix.sum(1) == sizes).all() and (matrix.sum(0) == room).all() and (matrix >= 0).all()


def test_matrix_law():
    before, room = np.array([0, 2, 4]), np.array([2, 2])
    seen = Counter(int(sharding.matrix_row(before, room, 0, s)[0]) for s in range(6000))
    assert abs(seen[0] / 6000 - 1 / 6) < 0.03 and abs(seen[1] / 6000 - 4 / 6) < 0.03


def test_large_draws_follow_the_law():
    rng = np.random.default_rng(1)
    good, bad, sample = 3 * 10**9, 7 * 10**9, 10**4
    draws = np.array([sharding.hypergeometric(rng, good, bad, sample) for _ in range(4000)])
    assert abs(draws.mean() - 3000) < 4 and abs(draws.std() / np.sqrt(2100) - 1) < 0.06
    assert sharding.split_room(rng, np.array([10**9, 2 * 10**9]), 3 * 10**9).tolist() == [10**9, 2 * 10**9]


@pytest.mark.parametrize("rows, per_task", [(1000, 100_000), (1003, 7), (13, 100_000), (0, 10)])
def test_shards_are_exact(spark, rows, per_task):
    data = [(k // 2 if k % 5 else None, f"text é {k // 3}" if k % 7 else None, k, "x") for k in range(rows)]
    frame = spark.createDataFrame(data, "doc_id long, text string, shard int, Slot string").repartition(6)
    out = sharding.shuffled_shards(frame, 8, rows_per_task=per_task).collect()
    assert sorted(r.shard_in for r in out) == list(range(rows))
    by = {}
    for r in out:
        by.setdefault(r.shard, []).append(r.slot)
        assert r.Slot_in == "x"
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    counts = [len(by.get(s, [])) for s in range(8)]
    assert max(counts) - min(counts) <= 1


def test_every_place_is_equally_likely(spark):
    frame = spark.range(12).selectExpr("id as doc_id", "'t' as text").repartition(3)
    path = sharding.written(frame, "places")
    hits = Counter()
    for seed in range(40):
        for r in sharding.shuffled_shards(path, 2, seed, is_scan=True).collect():
            hits[r.shard] += r.doc_id < 6
    assert abs(hits[0] - 120) < 40


def test_digest(spark):
    frame = spark.createDataFrame([(1, "é"), (2, None), (2, None)], "doc_id long, text string")
    got = sorted((r.doc_id, r.size, r.text_crc32, r.law, r.grown_shard) for r in sharding.shard_digest(frame).collect())
    assert got == [(1, 18, zlib.crc32("é".encode()), "rows", None), (2, 16, 0, "rows", None), (2, 16, 0, "rows", None)]


def test_one_exchange(spark):
    frame = spark.range(1000).selectExpr("id as doc_id", "'t' as text")
    path = sharding.written(frame, "plan")
    plan = sharding.shuffled_shards(path, 40, is_scan=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1, plan
