import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerlens.llm import common, near_copies


def sets_of(text):
    words = text.lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def brute(texts):
    """Smallest number of each text's group, by all pairs."""
    sets, label = [sets_of(t) for t in texts], list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9 and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = [low if x == high else x for x in label]
    return label


def edited(rng, text, edits):
    words = text.split(" ")
    for _ in range(edits):
        at = rng.randrange(len(words)) if len(words) > 50 else len(words)
        words[at : at + 1] = [f"new{rng.randrange(10**6)}"]
    return " ".join(words)


def corpus(seed=5):
    """Texts with edited copies around a similarity of 0.8, chains of copies, and texts that share half their words."""
    rng = random.Random(seed)
    texts = []
    for _ in range(45):
        size = rng.choice([12, 40, 120, 400])
        own = " ".join(f"w{rng.randrange(3000)}" for _ in range(size))
        texts.append(own)
        for _ in range(rng.randrange(6)):
            own = edited(rng, own if rng.random() < 0.4 else texts[-1], rng.randrange(1, max(3, size // 25)))
            texts.append(own)
        texts.append(own[: len(own) // 2] + " " + " ".join(f"v{rng.randrange(3000)}" for _ in range(size // 2)))
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("block", [4, 256])
def test_groups_equal_brute_force(spark, block):
    texts = corpus()
    want = brute(texts)
    assert 40 < len(set(want)) < len(texts) - 40
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in near_copies.groups(frame, block=block).collect()}
    assert [got[k] for k in range(len(texts))] == want


def test_stage_keeps_one_of_each_group(spark):
    texts = corpus(6)
    rows = [(k, t, "en", "s", 0) for k, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").repartition(3)
    left = sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, frame, "").collect())
    assert left == sorted(set(brute(texts)))


def test_empty_texts_are_copies(spark):
    frame = spark.createDataFrame([(4, None), (3, ""), (5, " \n"), (None, "one two"), (7, "One  two")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.component_id) for r in near_copies.groups(frame).collect())
    assert got == [(0, 7), (3, 3), (4, 3), (5, 3), (7, 7)]
    assert near_copies.groups(frame.limit(0)).collect() == []


def test_texts_that_share_an_id_stay(spark):
    rng = random.Random(7)
    alone = [" ".join(f"w{rng.randrange(3000)}" for _ in range(150)) for _ in range(12)]
    # id 1 repeats over different texts; it leads a group and is a mere member of the group that id 0 leads
    rows = [(1, t) for t in alone] + [(1, alone[0]), (5, edited(rng, alone[1], 1)), (0, edited(rng, alone[2], 1)), (None, alone[3])]
    frame = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars int").repartition(3)
    left = corpus_pipeline.drop_near_duplicates(spark, frame, "").collect()
    assert sorted((r.doc_id, r.text) for r in left) == sorted([(0, rows[14][1])] + [(1, t) for k, t in enumerate(alone) if k != 2])


def test_fingerprints_find_candidates_by_multi_index_hashing(spark):
    """Wordings whose fingerprints differ in four bits or fewer are joined, and no others; without any band they are still grouped where they are similar."""
    rng = random.Random(9)
    texts = corpus(9)
    texts += [edited(rng, " ".join(f"w{rng.randrange(3000)}" for _ in range(1500)), 1) for _ in range(4)]
    texts += [edited(rng, t, 1) for t in texts[-4:]] + ["a b c d e f g", "a b c d e f g a b c d e f g a b c d e f g"]
    marks = [near_copies.majority(near_copies.shingles(near_copies.words_of(t))) for t in texts]
    label = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if (marks[a] ^ marks[b]).bit_count() <= 4 and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = [low if x == high else x for x in label]
    assert len(set(label)) < len(texts) - 4
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    signed = common.written(near_copies._signatures(frame, "doc_id", "text"), "signed")
    prints = {r.i: r.print for r in signed.collect()}
    root = {r.node: r.root for r in near_copies.components(near_copies.alike(signed)).collect()}
    got = [root.get(prints[k], prints[k]) for k in range(len(texts))]
    assert len(set(zip(got, label))) == len(set(got)) == len({label[k] for k in range(len(texts))} )
    bare = signed.withColumn("keys", F.array().cast("array<long>"))
    found = near_copies.links(frame, bare, near_copies._wordings(bare))
    assert {frozenset((r.u, r.v)) for r in found.collect()} >= {frozenset((prints[len(texts) - 10 + k], prints[len(texts) - 6 + k])) for k in range(4)}
