import random

import numpy as np

from ledgerlens.llm import quality


def good(rng):
    words = ["".join(rng.choices("abcdeiou", k=rng.randrange(2, 9))) for _ in range(rng.randrange(30, 120))]
    return " ".join(w.capitalize() if k % 9 == 0 else w + "." if k % 9 == 8 else w for k, w in enumerate(words))


def bad(rng):
    text = good(rng)
    return [text.upper().replace(" ", "!! "), text.replace(" ", " | "), " ".join(w for w in text.split()[:9] for _ in range(12))][rng.randrange(3)]


def rows(count, seed):
    rng = random.Random(seed)
    return [(k, bad(rng) if k % 7 == 0 else good(rng), int(k % 7 != 0)) for k in range(count)]


def test_held_out_accuracy(spark):
    data = rows(900, 1)
    extra = [(10_000, None), (10_001, ""), (None, "some text."), (10_002, "word " * 40_000), (10_002, "word " * 40_000)]
    docs = spark.createDataFrame([(i, t, 9.0, "q") for i, t, _ in data] + [(i, t, 1.0, "q") for i, t in extra], "doc_id long, text string, score double, quality string").repartition(3)
    labels = [(i, q) for i, _, q in data] + [(None, 1), (5, None), (10_001, 0), (20_000, 1), (1, 1), (1, 1)]
    labels = spark.createDataFrame(labels, "doc_id long, quality int")
    got = quality.classified(docs, labels).collect()
    assert len(got) == len(data) + len(extra)
    by = {r.doc_id: r for r in got}
    held = [(by[i].predicted, q) for i, _, q in data if by[i].held_out]
    assert len(held) > 200 and np.mean([p == q for p, q in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)


def test_labels_of_the_held_out_fold_do_not_matter(spark):
    import zlib

    data = rows(200, 2)
    docs = spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id long, text string")
    outside = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    scores = []
    for flip in (False, True):
        labels = spark.createDataFrame([(i, 1 - q if flip and outside(i) else q) for i, _, q in data], "doc_id long, quality int")
        scores.append(sorted((r.doc_id, round(r.score, 6)) for r in quality.classified(docs, labels).collect()))
    assert scores[0] == scores[1]


def test_without_labels_or_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.classified(empty, labels).collect() == []
    bare = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    assert [(r.score, r.predicted) for r in quality.classified(bare, labels).collect()] == [(0.5, 1)]


def test_prior_from_scores_alone():
    rng = np.random.default_rng(0)
    p = rng.normal(3, 1, 4000)
    u = np.r_[rng.normal(3, 1, 2400), rng.normal(-3, 1, 1600)]
    assert abs(quality.covered_share(p, u) - 0.6) < 0.08


def test_worst_stretch_equals_slow_form():
    rng = np.random.default_rng(1)
    for size in (1, 5, 64, 100, 999):
        values = rng.random(size) < 0.3
        number = max(1, size // 32 - 1)
        means = [values[k * 32 : size if k == number - 1 else k * 32 + 64].mean() for k in range(number)]
        got = quality._worst(np.r_[values, values], np.array([0, size]), np.array([size, size]), 64)
        assert np.allclose(got, max(means))


def kind(c):
    if ord(c) < 0x3000 and c.islower():
        return 0
    if ord(c) < 0x3000 and c.isupper():
        return 1
    if c.isalpha():
        return 2
    if ord(c) < 0x3000 and c.isdigit():
        return 3
    for number, signs in enumerate([" \t", "\n\r\x0b\x0c", ".", ",;:", "!?", "'\"-()", "|/\\", "@#$%^&*~_+=", "<>[]{}`"], 4):
        if c in signs:
            return number
    return 13


def worst(values, width):
    number = max(1, len(values) // (width // 2) - 1)
    parts = [values[k * width // 2 : len(values) if k == number - 1 else k * width // 2 + width] for k in range(number)]
    return max(sum(p) / len(p) for p in parts)


def slow_features(text):
    """The features one character and one word at a time."""
    codes = [kind(c) for c in text + "\n"]
    pairs = [0.0] * 196
    for a, b in zip(codes, codes[1:]):
        pairs[a * 14 + b] += 1
    pairs = [(n / max(1, len(codes) - 1)) ** 0.5 for n in pairs]
    tests = [lambda k: k == 1, lambda k: k == 3, lambda k: k == 8, lambda k: k > 9, lambda k: k > 5 or k == 3]
    chars = [worst([t(k) for k in codes], 256) ** 0.5 for t in tests]
    words, lines = text.split(), text.split("\n")
    again = [k > 0 and words[k] == words[k - 1] for k in range(len(words))]
    two = [k > 1 and words[k] == words[k - 2] for k in range(len(words))]
    out = [0.0] * 3 + [0.0] * 5
    if words:
        out = [worst(again, 32), worst(two, 32), worst([len(w) > 18 for w in words], 32)]
        n = len(words)
        out += [sum(again) / n, len(set(words)) / n**0.5, len(set(words)) / n, sum(map(len, words)) / n / 10, max(map(len, words)) ** 0.5 / 10]
    out += [1 - len(set(lines)) / len(lines), np.log1p(len(words)) / 5, np.log1p(len(text) / len(lines)) / 5]
    return pairs + chars + out


def test_features_and_scores_equal_a_slow_form(spark):
    rng = random.Random(6)
    texts = ["", " ", "a", "a a a b b", "É1ß 字 <tag> {x}|y\n\nz\n", "w" * 600, *(t for _, t, _ in rows(12, 3)), "".join(rng.choices("aB1 .,!|@<\n字", k=900))]
    slow = np.array([slow_features(t) for t in texts])
    assert np.allclose(quality.features(texts), slow, atol=1e-5)
    data = rows(200, 4)
    model = quality.fit([t for _, t, q in data if q], [t for _, t, _ in data])
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.score for r in quality.scored(frame, model).collect()}
    for k, own in enumerate(slow):
        z = float(np.clip((own - model.centre) / model.scale, -8, 8) @ model.weights.astype(float) + model.bias)
        assert abs(got[k] - 1 / (1 + np.exp(-np.clip(z, -40, 40)))) < 1e-3


def test_ids_of_any_type_and_rows_that_share_an_id(spark):
    data = rows(600, 5)
    docs = spark.createDataFrame([("same" if k % 2 else "" if k % 3 else None if k % 5 else str(k), t) for k, t, _ in data], "doc_id string, text string")
    labels = spark.createDataFrame([("same", 1), ("", 1), ("6", 0)], "doc_id string, quality int")
    model = quality.learn(docs, labels, sample=100)
    assert model is not None and 0 < model.prior < 1
    assert quality.classified(docs, labels).count() == 600


def test_labels_of_bad_texts_are_not_read(spark):
    data = rows(300, 7)
    docs = spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id long, text string")
    both = spark.createDataFrame([(i, q) for i, _, q in data], "doc_id long, quality int")
    one, two = (quality.learn(docs, own) for own in (both, both.where("quality = 1")))
    assert one.prior == two.prior and np.array_equal(one.weights, two.weights)
