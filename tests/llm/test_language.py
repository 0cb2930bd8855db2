import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from ledgerlens.llm import language

EN = "the quick brown fox jumps over the lazy dog and then the dog sleeps while the fox runs through the old forest with a friend".split()
FR = "le renard brun saute par dessus le chien paresseux et ensuite le chien dort pendant que le renard court dans la vieille forêt été".split()


def sentences(words, count, seed):
    rng = random.Random(seed)
    return [" ".join(rng.choices(words, k=rng.randrange(5, 30))) + ".\n" for _ in range(count)]


def plain(text):
    out = "   "
    for c in text.lower() + " ":
        if c.isalpha():
            out += c
        elif not out.endswith(" "):
            out += " "
    return out


def slow_model(texts, size):
    grams = [Counter() for _ in range(5)]
    for t in texts:
        t = plain(t)
        for k in range(3, len(t)):
            grams[4][t[k - 3 : k + 1]] += 1
    for n in (3, 2, 1):
        for g in grams[n + 1]:
            grams[n][g[1:]] += 1
    discounts, totals, kinds = {}, defaultdict(int), defaultdict(int)
    for n in range(1, 5):
        ones, twos = (sum(c == k for c in grams[n].values()) for k in (1, 2))
        discounts[n] = ones / (ones + 2 * twos) if ones and twos else 0.5
        for g, c in grams[n].items():
            totals[n, g[:-1]] += c
            kinds[n, g[:-1]] += 1

    def p(gram):
        n = len(gram)
        if n == 0:
            return 1 / size
        total = totals[n, gram[:-1]]
        if not total:
            return p(gram[1:])
        return max(grams[n][gram] - discounts[n], 0) / total + discounts[n] * kinds[n, gram[:-1]] / total * p(gram[1:])

    return p


def test_entropies_equal_the_slow_model():
    texts = {"en": sentences(EN, 40, 1), "fr": sentences(FR, 40, 2)}
    models = language.LanguageModels(texts)
    size = len({c for own in texts.values() for t in own for c in plain(t)}) + 1
    for col, lang in enumerate(models.languages):
        p = slow_model(texts[lang], size)
        alphabet = sorted({c for own in texts.values() for t in own for c in plain(t)}) + ["Ж"]
        for context in ("the", "   ", "qzx"):
            assert sum(p(context + c) for c in alphabet) == pytest.approx(1)
        for text in ["the fox, été 12!", "zzz Ж", "a", "dog " * 500]:
            t = plain(text)
            want = -sum(math.log(p(t[k - 3 : k + 1])) for k in range(3, len(t))) / (len(t) - 3)
            entropy, count, _ = models.entropies(["before", text, "after"])
            assert count[1] == len(t) - 3
            assert entropy[1, col] == pytest.approx(want, rel=1e-4)


def test_hash_array_finds_all():
    rng = np.random.default_rng(0)
    values = np.unique(rng.integers(1 << 63, size=5000, dtype=np.uint64))
    found = language.HashArray(values).find(np.r_[values, values + np.uint64(1)])
    assert (found[: len(values)] == np.arange(len(values))).all() and (found[len(values) :] == -1).sum() >= len(values) - 1


def test_learn_and_predict(spark):
    rows = [(k, t, "en", "x") for k, t in enumerate(sentences(EN, 300, 3))] + [(1000 + k, t, "fr", "x") for k, t in enumerate(sentences(FR, 300, 4))]
    rows += [(5000, None, "en", "x"), (5001, "", "en", "x"), (5002, "12 34 !!", "fr", "x"), (None, "the fox", None, "x"), (5003, "the fox", None, "x"), (5003, "the fox", None, "x"), (5004, "привет мир как дела сегодня у вас всех", None, "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string").repartition(4)
    got = language.identified(frame).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all(by[k].lang_pred == ("en" if k < 1000 else "fr") for k, *_ in rows if k is not None and k < 5000)
    assert [by[k].lang_pred for k in (5000, 5001, 5002)] == ["und"] * 3 and by[5000].score == 0
    assert not by[5004].accepted and all(by[k].accepted for k in range(300)) and not by[5002].accepted
    assert all(0 <= r.score <= 1 for r in got)


def test_without_rows_or_labels(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert language.identified(empty).collect() == []
    bare = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.accepted) for r in language.identified(bare).collect()] == [("und", False)]


def test_a_rare_language_rejects_foreign_texts(spark):
    rare = "el zorro y perro corren sobre la colina con unos amigos que quieren jugar fuera mientras otro duerme en casa".split()
    rows = [(k, t, "en") for k, t in enumerate(sentences(EN, 300, 3))] + [(1000 + k, t, "fr") for k, t in enumerate(sentences(FR, 300, 4))]
    rows += [(2000 + k, t, "es") for k, t in enumerate(sentences(rare, 5, 5))]
    models = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3))
    assert models.languages == ["en", "es", "fr"] and np.isfinite(models.centre).all()
    foreign = ["привет мир как дела сегодня у вас всех", "το γρήγορο καφέ αλεπού πηδά πάνω από", "这是一个关于狐狸和狗的故事"]
    assert not models.predict(foreign)[3].any()
    names, _, _, accepted = models.predict(sentences(rare, 50, 6))
    assert names == ["es"] * 50 and accepted.all()
    assert models.predict(sentences(EN, 50, 7))[3].all()


def test_every_language_has_a_model(spark):
    rare = "el zorro y perro corren sobre la colina con unos amigos que quieren jugar".split()
    own = sentences(rare, 40, 8)
    for one in range(40):  # each alone: about every fifth falls to the calibration
        frame = spark.createDataFrame([(one, own[one], "es"), (90, "12 34", "en"), (91, "the fox runs", "en")], "doc_id long, text string, lang string").coalesce(1)
        draw = frame.where("lang = 'es'").selectExpr("pmod(xxhash64('sample', doc_id, text), 1 << 30) as d").first().d
        if draw % 5 == 0:
            break
    assert draw % 5 == 0 and "es" in language.learn(frame).languages


def test_languages_of_long_texts_and_rows_that_share_an_id(spark):
    rare = "el zorro y perro corren sobre la colina con unos amigos que quieren jugar".split()
    long = [" ".join(sentences(rare, 2000, k)) for k in range(2)]
    assert min(map(len, long)) > 1 << 16
    rows = [(7, t, "en") for t in sentences(EN, 400, 3)] + [(None, t, "fr") for t in sentences(FR, 400, 4)] + [(k, t, "es") for k, t in enumerate(long)]
    frame = spark.createDataFrame(rows + rows[:50], "doc_id long, text string, lang string").repartition(3)
    models = language.learn(frame, sample=100)
    assert models.languages == ["en", "es", "fr"]
    for lang, words in (("en", EN), ("es", rare), ("fr", FR)):
        assert models.predict(sentences(words, 20, 9))[0] == [lang] * 20


def test_draws_are_bounded(spark):
    from pyspark.sql import functions as F

    from ledgerlens.llm import common

    rows = [(k % 3, "x" * 1000, k // 2) for k in range(3000)]
    frame = spark.createDataFrame(rows, "g int, t string, id int").select("g", "t", common.draw_of("a", "id", "g").alias("draw"))
    got = common.bounded_rows(frame, "g", "draw", "t", 50, 20_000).groupBy("g").agg(F.count("*").alias("n"), F.count_distinct("draw").alias("d")).collect()
    assert {(r.g, r.n, r.d) for r in got} == {(0, 20, 20), (1, 20, 20), (2, 20, 20)}
    assert common.bounded_rows(frame, "g", "draw", "t", 50, 10).count() == 6
