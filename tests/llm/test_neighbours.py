import math

import numpy as np
import pytest

from ledgerlens.llm import neighbours


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1.0, 2) for i, v in rows], "vec_id long, embedding array<float>, score double, list int").repartition(3)


def brute(rows, step, k=10):
    rows = [(i, np.array(v, np.float32).astype(float)) for i, v in rows]
    out = {}
    for i, q in rows:
        if i % step == 0:
            found = sorted((float(np.sqrt(((v - q) ** 2).sum())), j) for j, v in rows if j != i)[:k]
            out[i] = found
    return out


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((3000, 48)).astype(np.float32)
    rows = [(k, x[k].tolist()) for k in range(3000)]
    want = brute(rows, 50)
    got = {}
    for r in neighbours.nearest(frame(spark, rows), 50, chunk=40, block=16).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(want)
    hits = 0
    for q, own in got.items():
        own.sort()
        assert [r for r, _, _ in own] == list(range(1, 11))
        assert [(s, v) for _, v, s in own] == sorted((s, v) for _, v, s in own)
        for _, v, s in own:
            assert s == pytest.approx(float(np.sqrt(((x[v].astype(float) - x[q].astype(float)) ** 2).sum())), abs=1e-12)
        hits += len({v for _, v, _ in own} & {v for _, v in want[q]})
    assert hits / (10 * len(want)) >= 0.9


def test_ties_and_copies(spark):
    rng = np.random.default_rng(1)
    one = rng.standard_normal(8).tolist()
    rows = [(k, one) for k in range(400)] + [(1000 + k, rng.standard_normal(8).tolist()) for k in range(100)]
    got = {}
    for r in neighbours.nearest(frame(spark, rows), 100, chunk=30).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    for q in (0, 100, 200, 300):
        assert [(v, s) for _, v, s in sorted(got[q])] == [(v, 0.0) for v in range(11) if v != q][:10]


def test_rows_that_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, None), (3, [0.0, 0.0]), (4, [math.nan, 1.0]), (5, [math.inf, 1.0]), (6, []), (7, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (100, [3.0, 0.0]), (200, None), (8, [None, 1.0])]
    got = sorted((r.query_id, r.rank, r.vec_id, round(r.score, 6)) for r in neighbours.nearest(frame(spark, rows)).collect())
    assert got == [(0, 1, 1, 1.414214), (0, 2, 100, 2.0), (100, 1, 0, 2.0), (100, 2, 1, 3.162278)]


def test_repeated_rows_count_once(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((60, 4)).astype(np.float32)
    plain = [(k, x[k].tolist()) for k in range(60)]
    # whole rows repeat, queries and candidates; a query's id repeats over another vector, and so does a candidate's: such rows are candidates of each other
    rows = plain * 3 + [(0, x[7].tolist()), (4, x[9].tolist()), (4, x[9].tolist())]
    candidates = {i: [x[i].astype(float)] for i in range(60)}
    candidates[4].append(x[9].astype(float))
    candidates[0].append(x[7].astype(float))
    want = []
    for q, vector in [(0, x[0]), (0, x[7]), (20, x[20]), (40, x[40])]:
        found = {(float(np.sqrt(((c - vector.astype(float)) ** 2).sum())), i) for i, own in candidates.items() for c in own if i != q or (c != vector).any()}
        want += [(q, rank, i, round(d, 9)) for rank, (d, i) in enumerate(sorted(found)[:10], 1)]
    got = [(r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in neighbours.nearest(frame(spark, rows), 20, missed=0.0).collect()]
    assert sorted(got) == sorted(want)


def test_clusters_are_searched_in_few_lists():
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((64, 32)) * 4
    x = np.concatenate([c + rng.standard_normal((60, 32)) * 0.3 for c in centres])
    lists = neighbours.fit_lists(x, np.arange(len(x)), 62)
    own, far = neighbours.nearest_of(x, lists.centroids)
    counts = np.bincount(own, minlength=62)
    means = np.bincount(own, far, 62) / np.maximum(counts, 1)
    variances = np.maximum(np.bincount(own, far**2, 62) / np.maximum(counts, 1) - means**2, 0)
    queries = x[::50]
    use = neighbours.probes(neighbours.squares(queries, lists.centroids), counts, means, variances, 32, 10, neighbours.MISSED)
    d = neighbours.squares(queries, x)
    d[np.arange(len(queries)), np.arange(0, len(x), 50)] = np.inf
    true = np.argpartition(d, 10, 1)[:, :10]
    assert use[np.arange(len(queries))[:, None], own[true]].mean() > 0.95
    assert (use * counts).sum() < 0.15 * len(queries) * len(x)


def test_empty_and_alone(spark):
    assert neighbours.nearest(frame(spark, []).limit(0)).collect() == []
    assert neighbours.nearest(frame(spark, [(0, [1.0, 2.0])])).collect() == []


@pytest.mark.parametrize("count", [500, 2000])
def test_recall_has_a_margin_at_every_size(spark, count):
    x = np.random.default_rng(count).standard_normal((count, 64)).astype(np.float32)
    rows = [(k, x[k].tolist()) for k in range(count)]
    want = brute(rows, 10)
    got = {(r.query_id, r.vec_id) for r in neighbours.nearest(frame(spark, rows), 10).collect()}
    hits = sum((q, v) in got for q, own in want.items() for _, v in own)
    assert hits / (10 * len(want)) >= 0.95
