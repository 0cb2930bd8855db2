import bisect
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ledgerlens.llm import packing, segments

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = list("aab  \n\n\t'sdt.1!") + ["é", " ", "　", "字", " ", "<|endoftext|>", "\x00", "\x85", "𝄞", "'ll", " ", "\x1c", "\r", "ß", "²", "͹"]


def odd_texts(count, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choices(ODD, k=rng.randrange(0, 40))) for _ in range(count)] + ["", " ", "\n", "a" * 3000, "word " * 700]


@pytest.mark.parametrize("plain", [False, True])
def test_segments_give_the_library_s_ids(plain):
    import pyarrow as pa

    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = plain
    texts = odd_texts(5000)
    want = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    for words in (50, 10_000):
        store = packing._Ids(PATH)
        store.encode = segments.ByteEncoder(PATH, plain)
        memo, got = segments.SegmentMemo(store, words), []
        for _, raw, sizes in segments.text_bytes(pa.record_batch({"t": pa.array(texts)}), "t", part=900):
            begins, lengths, counts = segments.cut(raw, sizes)
            ids, n = store.ids.take(memo.numbers(raw, begins, lengths))
            got += [x.tolist() for x in np.split(ids, np.r_[0, np.cumsum(n)][np.cumsum(counts)][:-1])]
        assert got == want


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        segments.ByteEncoder(public_tokenizers.path("word_bpe_49k.json"), True)


def best_fit_decreasing(items, capacity):
    gaps, n = [], 0
    for size in sorted(items, reverse=True):
        at = bisect.bisect_left(gaps, size)
        n += at == len(gaps)
        bisect.insort(gaps, (gaps.pop(at) if at < len(gaps) else capacity) - size)
    return n


def matched(items, capacity):
    """Most pairs of large items, by trying all partners of the largest."""
    if not items:
        return 0
    head, rest = items[0], items[1:]
    return max([matched(rest, capacity)] + [1 + matched(rest[:k] + rest[k + 1 :], capacity) for k, b in enumerate(rest) if head + b <= capacity])


@pytest.mark.parametrize("seed", range(40))
def test_plans_are_whole_and_tight(seed):
    rng = random.Random(seed)
    capacity = rng.choice([5, 10, 30, 100, 1024])
    top = rng.choice([capacity, capacity // 2 + 1, max(1, capacity // 3), max(1, capacity // 10)])
    items = [rng.randint(1, top) for _ in range(rng.randrange(0, 2000 if seed % 10 == 0 else 60))]
    counts = {s: items.count(s) for s in set(items)}
    held, seen = {}, {}
    for length, rank, n, first, per, offset in packing.plan(counts, capacity).tolist():
        assert seen.get(length, 0) == rank
        seen[length] = rank + n
        for k in range(n):
            held.setdefault(first + k // per, []).append((offset + k % per * length, length))
    assert seen == counts
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    assert sorted(held) == list(range(len(held)))
    best = best_fit_decreasing(items, capacity)
    assert len(held) <= best + max(1, best // 50)


@pytest.mark.parametrize("seed", range(20))
def test_large_items_pair_as_often_as_possible(seed):
    rng = random.Random(seed)
    items = sorted((rng.randint(11, 30) for _ in range(9)), reverse=True)
    plan = packing.plan({s: items.count(s) for s in set(items)}, 30)
    assert len(items) - int((plan[:, 3] + -(-plan[:, 2] // plan[:, 4])).max()) == matched(items, 30)


def test_a_plan_does_not_grow_with_the_rows():
    few = packing.plan({k: 7 for k in range(1, 1025)})
    assert len(packing.plan({k: 7 * 10**9 for k in range(1, 1025)})) < len(few) + 2048


def test_packed(spark):
    tokenizer = Tokenizer.from_file(PATH)
    texts = odd_texts(200) + ["same text"] * 100 + ["a b " * 3000, None, None]
    rows = [(k if k % 50 else 7, t, "x", 1) for k, t in enumerate(texts)] + [(None, "no id", "x", 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, length string, offset int").repartition(5)
    got = packing.packed(frame, PATH, with_ids=True).collect()
    want = sorted((i if i is not None else -1, tuple([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2])) for i, t, _, _ in rows)
    by_doc, spread = {}, {}
    for r in got:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
        spread.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(-1 if r.doc_id is None else r.doc_id, []).append(r)
    whole = {}
    for i, ids in want:
        whole.setdefault(i, []).append(ids)
    for i, found in by_doc.items():
        assert sum(r.length for r in found) == sum(map(len, whole[i]))
        if len(whole[i]) == 1:
            found = sorted(found, key=lambda r: r.piece)
            assert tuple(k for r in found for k in r.ids) == whole[i][0]
            assert [r.start for r in found] == [sum(q.length for q in found[:k]) for k in range(len(found))]
            assert all(r.length == 1024 for r in found[1:]) and [r.piece for r in found] == list(range(len(found)))
    assert by_doc.keys() == whole.keys()
    for places in spread.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.packed(frame.limit(0), PATH).collect() == []
