import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerlens.llm import pieces, token_files

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
ODD = ["Thered, Thered. THERED., a.b, x_y. été, ÉTÉ!? I'll 's ok.'s ñ... 1.2.", "<|ENDOFTEXT|> é É", " ", "\n", "  a  b \n\n c", "a▁b", "日本 語\x00x", "<s></s><0x0A>", "\x1c a\x1fb", "x y z\x85w", "é ́e", "ΣΑΣ Σ", "İI", "<|endoftext|> a<|startoftext|>b", "it's WE'LL 12 34!!", "a" * 5000, "𝄞𝄞 ﬁ"]


def random_texts(count):
    rng = random.Random(5)
    common = "aabeht n" + " éß\n"
    return ["".join(rng.choices(common, k=rng.randrange(0, 60))) for _ in range(count)] + ["".join(rng.choices("=-_a  \t!?'s" + "字", k=rng.randrange(0, 60))) for _ in range(count)]


def test_pieces_equal_the_library():
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    codec = pieces.codec(PIECES)
    texts = ODD + random_texts(2000)
    want = model.encode(texts, num_threads=1)
    assert list(codec.encode_many(texts)) == want
    assert [codec.decode(w) for w in want] == [model.decode(w) for w in want]
    assert codec.decode([131, 200, 259, 0, 1, 300, 230, 131]) == model.decode([131, 200, 259, 0, 1, 300, 230, 131])


def test_words_equal_the_library():
    whole = Tokenizer.from_file(WORDS)
    own = token_files.tokenizer(WORDS)
    texts = ODD + random_texts(2000)
    want = [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(b, np.int32).tolist() for b in own.encode_many(texts)] == want
    small = token_files.WordTokenizer(WORDS, words=20)
    assert [np.frombuffer(next(small.encode_many([t])), np.int32).tolist() for t in texts] == want


def test_memo_forgets_and_stays_right():
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    codec = pieces.PrefixTableCodec(PIECES)
    codec.memo.words = 20
    texts = [f"word{k} word{k // 2} same" for k in range(300)]
    for t in texts:
        assert next(codec.encode_many([t])) == model.encode(t)


def test_round_trip_query(spark):
    rows = [(k, t, "x") for k, t in enumerate(ODD)] + [(None, None, "y"), (3, ODD[3], "z"), (3, ODD[3], "z")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = []
    for i, t, _ in rows:
        ids = model.encode(t or "")
        want.append((-1 if i is None else i, len(ids), sha(",".join(map(str, ids))), sha(model.decode(ids) if ids else "")))
    got = [(-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pieces.round_trip(frame, PIECES).collect()]
    assert sorted(got) == sorted(want)
    back = pieces.decode(pieces.encode(frame, PIECES), PIECES).collect()
    assert sorted(r.text for r in back) == sorted(model.decode(model.encode(t or "")) if t else "" for _, t, _ in rows)


def test_token_files(spark, tmp_path):
    texts = ODD + random_texts(150)
    rows = [((k * 7) % len(texts), t, 1) for k, t in enumerate(texts)] + [(4, "again", 2), (4, "again", 2), (None, None, 3)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, part int").repartition(5)
    whole = Tokenizer.from_file(WORDS)
    got = sorted(((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_files.token_index(frame, WORDS).collect()))
    ids = [r[1] if r[1] is not None else -1 for r in got]
    assert ids == sorted(ids) and len(got) == len(rows)
    at = 0
    for start, _, n, _ in got:
        assert start == at
        at += n
    crc = lambda t: (lambda a: (len(a), zlib.crc32(a.tobytes())))(np.array(whole.encode(t or "", add_special_tokens=False).ids + [1], "<u4"))
    assert sorted((i, n, c) for _, i, n, c in [(g[0], -1 if g[1] is None else g[1], g[2], g[3]) for g in got]) == sorted((-1 if i is None else i, *crc(t)) for i, t, _ in rows)


def test_files_have_bloom_filters_and_prune(spark, tmp_path):
    frame = spark.range(3000).selectExpr("id as doc_id", "concat('text ', id) as text")
    path = str(tmp_path / "tokens")
    token_files.write_tokens(frame, WORDS, path)
    found = token_files.read_tokens(spark, path).where("doc_id = 1234")
    assert found.count() == 1
    assert "doc_id" in found._jdf.queryExecution().executedPlan().toString().split("PushedFilters")[1]


@pytest.mark.parametrize("make", [lambda f: pieces.round_trip(f, PIECES), lambda f: token_files.token_index(f, WORDS)])
def test_empty_tables(spark, make):
    assert make(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_other_tokenizer_files_are_refused(tmp_path):
    import json

    with pytest.raises(ValueError):
        token_files.WordTokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    made = json.load(open(WORDS))
    made["normalizer"]["normalizers"].pop()
    (tmp_path / "cased.json").write_text(json.dumps(made))
    with pytest.raises(ValueError):
        token_files.WordTokenizer(str(tmp_path / "cased.json"))


def test_files_hold_stripes_row_indexes_and_bloom_filters(spark, tmp_path):
    """What the files hold, by the footer and the indexes of the ORC reader itself."""
    frame = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words "), F.col("id").cast("string")).alias("text"))
    token_files.write_tokens(frame, WORDS, str(tmp_path / "t"))
    jvm = spark._jvm
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    files = [f for f in (tmp_path / "t").iterdir() if f.name.endswith(".orc")]
    seen, rows = 0, 0
    for f in files:
        reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(str(f)), jvm.org.apache.orc.OrcFile.readerOptions(conf))
        assert reader.getRowIndexStride() == token_files.INDEX_ROWS
        rows += reader.getNumberOfRows()
        names = list(reader.getSchema().getFieldNames())
        column, ids = reader.getSchema().findSubtype("doc_id").getId(), reader.getSchema().findSubtype("ids").getId() + 1
        found = reader.rows()
        stripes = list(reader.getStripes())
        for k, stripe in enumerate(stripes):
            kinds = {}
            footer = found.readStripeFooter(stripe)
            for s in footer.getStreamsList():
                kinds.setdefault(s.getColumn(), set()).add(s.getKind().toString())
            assert "BLOOM_FILTER_UTF8" in kinds[column] and "ROW_INDEX" in kinds[column] and "BLOOM_FILTER_UTF8" not in kinds[ids]
            # run-length encoding of the second kind, for the ids and their lengths
            assert footer.getColumns(ids).getKind().toString() == "DIRECT_V2" and footer.getColumns(column).getKind().toString() == "DIRECT_V2"
            seen += 1
        found.close()
        assert names[0] == "doc_id"
    assert seen >= 1 and rows == 6000
