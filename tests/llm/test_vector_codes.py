import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import Row

from ledgerlens.llm import vector_codes


def plain(rows, parts=8, entries=16, rounds=6):
    """The operator's rule written out with Python's whole numbers over (vec_id, vector, label)."""
    rows = [r for r in rows if r[1] and all(c is not None and math.isfinite(c) for c in r[1])]
    whole = [[math.floor(4096 * c) for c in r[1]] for r in rows]
    size = len(whole[0]) // parts
    first = {}
    for (i, x, _), w in zip(rows, whole):
        key = (i is None, i or 0)
        if key not in first or x < first[key][0]:
            first[key] = (list(x), w)
    start = [first[k][1] for k in sorted(first)[:entries]]
    books = [[s[p * size : (p + 1) * size] for s in start] for p in range(parts)]

    def assign():
        out = []
        for w in whole:
            own = []
            for p in range(parts):
                cell = w[p * size : (p + 1) * size]
                own.append(min((sum((a - b) ** 2 for a, b in zip(cell, e)), k) for k, e in enumerate(books[p])))
            out.append(own)
        return out

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for e in range(len(start)):
                cells = [w[p * size : (p + 1) * size] for w, own in zip(whole, found) if own[p][1] == e]
                if cells:
                    books[p][e] = [sum(c) // len(cells) for c in zip(*cells)]
    found = assign()
    errors = [sum(d for d, _ in own) for own in found]
    by_label = {}
    for (_, _, label), e in zip(rows, errors):
        by_label[label] = by_label.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    top = vector_codes.MOST
    return sorted((repr(i), "".join(f"{k:02x}" for _, k in own), min(top, e), min(top, by_label[label]), digest) for (i, _, label), own, e in zip(rows, found, errors))


def run(spark, rows, **more):
    frame = spark.createDataFrame([Row(vec_id=i, embedding=x, label=label, code="clash", v=1) for i, x, label in rows], "vec_id long, embedding array<double>, label int, code string, v int").repartition(3)
    return sorted((repr(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in vector_codes.compressed(frame, **more).collect())


@pytest.mark.parametrize("seed", range(4))
def test_equals_the_rule_written_out(spark, seed):
    rng = random.Random(seed)
    near = [0.0, 1 / 4096, -1 / 4096, 2 / 4096]
    draw = (lambda: rng.gauss(0, 0.2)) if seed % 2 else (lambda: rng.choice(near))  # the second kind is full of ties
    rows = [(k if rng.random() > 0.1 else 5, [draw() for _ in range(16)], rng.choice([None, 1, 2])) for k in range(150)]
    rows += [(200, [0.0] * 16, 1), (201, None, 1), (202, [float("nan")] * 16, 1), (203, [None] + [0.0] * 15, 1), (204, [float("inf")] * 16, 2), (205, [], 1), (None, [0.25] * 16, None)] + rows[:20]
    assert run(spark, rows) == plain(rows)


def test_large_components_and_few_rows(spark):
    rows = [(k, [(-1.0) ** k * 10.0 ** (k + c) for c in range(8)], None) for k in range(6)] + [(9, [3e9] * 8, 4), (10, [1e20] * 8, 4)]
    assert run(spark, rows) == plain(rows)


def test_odd_tables(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None, 1), (2, [], None)]) == []
    rows = [(k, [float(k)] * 8, 1) for k in range(5)]
    assert run(spark, rows + [(9, [1.0] * 7, 1)]) == plain(rows)
    with pytest.raises(ValueError):
        run(spark, [(1, [1.0] * 7, 1)])


@pytest.mark.parametrize("seed", range(10))
def test_trees_are_exact_and_prune(seed):
    rng = np.random.default_rng(seed)
    spread = rng.integers(-2, 3, (16, 4)) if seed % 2 else rng.integers(-4000, 4000, (16, 2))
    points = rng.integers(spread.min(), spread.max() + 1, (2000, spread.shape[1]))
    tree = vector_codes.VantageTree(spread.astype(np.int64))
    own, far = tree.nearest(points.astype(np.int64))
    squares = ((points[:, None] - spread[None]) ** 2).sum(2)
    assert (own == squares.argmin(1)).all() and (far == squares.min(1)).all()
    if not seed % 2:
        assert tree.visits < 0.7 * 16 * len(points)


def test_roots_are_rounded_both_ways():
    values = np.array([0, 1, 2, 3, 4, 24, 25, 26, (1 << 31) ** 2 - 1, (1 << 31) ** 2, (1 << 31) ** 2 + 1, (1 << 62) - 1], np.int64)
    for kind in (np.int64, object):
        low, high = vector_codes.roots(values.astype(kind))
        assert [int(x) for x in low] == [math.isqrt(int(v)) for v in values]
        assert [int(x) for x in high] == [math.isqrt(int(v) - 1) + 1 if v else 0 for v in values]


def test_codes_stand_for_near_vectors(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 1, (4, 16))
    x = centres[rng.integers(0, 4, 400)] + rng.normal(0, 0.01, (400, 16))
    frame = spark.createDataFrame([(k, row.tolist()) for k, row in enumerate(x)], "v long, x array<double>")
    books = vector_codes.fit(frame, 16)
    back = books.vectors(books.assign(vector_codes.whole_numbers(x))[0])
    assert np.abs(back - x).max() < 0.2
