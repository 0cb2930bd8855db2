import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from ledgerlens.llm import alignment

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
LETTERS = list("aab  \n\n\t'sdt.1!==") + ["é", " ", "　", "字", " ", "<|endoftext|>", "\x00", "\x85", "𝄞", "'ll", " ", "\x1c", "\r", "ß", "the ", " of", "tion", "<s>", "<0x0A>"]


def texts_of(count, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choices(LETTERS, k=rng.randrange(0, 40))) for _ in range(count)] + ["", " ", "\n", "\t", "a▁b", "▁", " x▁ y", "a" * 3000, "xab" + "ab" * 900, "=" * 5001, "word " * 700]


def plain(texts):
    """Groups, links and counts from the libraries' whole encodings, by byte offsets."""
    tokenizer = Tokenizer.from_file(BYTES)
    tokenizer.encode_special_tokens = True
    letter = {}
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    letter = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    docs = []
    for text in texts:
        if not text:
            docs.append(None)
            continue
        left = tokenizer.encode(" " + text, add_special_tokens=False).ids
        right = model.encode(text)
        a = [bytes(letter[c] for c in tokenizer.id_to_token(k)) for k in left]
        b = [bytes([int(model.id_to_piece(k)[3:5], 16)]) if model.is_byte(k) else model.id_to_piece(k).replace("▁", " ").encode() for k in right]
        whole = (" " + text).encode()
        if b"".join(a) != whole or b"".join(b) != whole:
            docs.append(None)
            continue
        groups, i, j, at_a, at_b, own_a, own_b = [], 0, 0, 0, 0, [], []
        while i < len(a) or j < len(b):
            if at_a <= at_b and i < len(a):
                own_a.append(left[i])
                at_a += len(a[i])
                i += 1
            else:
                own_b.append(right[j])
                at_b += len(b[j])
                j += 1
            if at_a == at_b:
                groups.append((own_a, own_b))
                own_a, own_b = [], []
        docs.append((left, right, groups))
    counts = {}
    for d in docs:
        if d:
            for pair in {(x, y) for a, b in d[2] for x in a for y in b}:
                counts[pair] = counts.get(pair, 0) + 1
    best = {}
    for (x, _), n in counts.items():
        best[x] = max(best.get(x, 0), n)
    out = []
    for d in docs:
        if d is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        links = [(x, y) for a, b in d[2] for x in a for y in b]
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in d[2])
        out.append((len(d[0]), len(d[1]), len(d[2]), len(links), sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links), hashlib.sha256(text.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("most", [1 << 20, 60, 0])
def test_equals_brute_force(spark, most):
    texts = texts_of(700) + ["same text"] * 60 + [None]
    frame = spark.createDataFrame([(k, t, "x", 3) for k, t in enumerate(texts)], "doc_id long, text string, pairs string, n int").repartition(4)
    got = {r.doc_id: tuple(r)[1:] for r in alignment.aligned(frame, BYTES, PIECES, most=most).collect()}
    assert [got[k] for k in range(len(texts))] == plain(texts)


def test_repeated_rows_null_ids_and_empty_tables(spark):
    rows = [(1, "a word"), (1, "a word"), (None, "a word"), (2, None), (1, "other")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(repr, (tuple(r) for r in alignment.aligned(frame, BYTES, PIECES).collect())))
    assert got == sorted(repr((i, *p)) for (i, _), p in zip(rows, plain([t for _, t in rows])))
    assert alignment.aligned(frame.limit(0), BYTES, PIECES).collect() == []


def test_a_small_memo_gives_the_same(spark):
    import numpy as np

    texts = texts_of(400, seed=8)
    raw = [(" " + t).encode() if t else b"" for t in texts]
    found = []
    for words in (30, 100_000):
        own = alignment.SegmentMemo(alignment._Links(BYTES, PIECES), words)
        digests = []
        for k in range(0, len(raw), 25):
            part = raw[k : k + 25]
            digests += alignment._of_texts(own, np.frombuffer(b"".join(part), np.uint8), np.array([len(t) for t in part]))[1]
        found.append(digests)
    assert found[0] == found[1] == [p[-1] for p in plain(texts)]


def test_transducer_closes_groups_on_empty_rest():
    left, right = [b"a", b"bc", b"abc", b"d"], [b"ab", b"c", b"cd", b"x"]
    own = alignment.Transducer(left, right)
    assert own.groups([0, 1, 3], [0, 1, 2]) is None
    assert own.groups([0, 1, 3], [0, 2]) == ([3], [2])
    assert own.groups([2, 0, 1], [0, 1, 0, 1]) == ([1, 3], [2, 4])
    assert own.groups([], []) == ([], [])
    assert own.groups([0], []) is None and own.groups([], [1]) is None and own.groups([0], [3]) is None


def test_frequent_pairs_stay_below_the_bound(spark):
    counts = spark.createDataFrame([(k, 1 + k // 3) for k in range(60)], "pair long, n long")
    for most in (0, 1, 12, 13, 1000):
        pair, n = alignment.frequent_pairs(counts, most)
        assert len(pair) <= most and all(n == 1 + pair // 3)
        assert most < 60 or len(pair) == 60
