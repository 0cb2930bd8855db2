import random

from pyspark.sql import Row

import corpus_pipeline
from ledgerlens.llm import common


def make(spark, tmp_path, count=260):
    rng = random.Random(8)
    words = {"en": "the fox and dog run over that hill with some friends who like to play outside".split(), "fr": "le renard et chien courent sur cette colline avec des amis qui aiment jouer dehors".split()}
    docs = []
    for k in range(count):
        lang = "en" if k % 3 else "fr"
        docs.append((k, " ".join(rng.choices(words[lang], k=rng.randrange(30, 90))).capitalize() + ".", lang, "s", 0))
    docs[20] = (20, docs[10][1], "en", "s", 0)
    docs[30] = (30, docs[31][1] + " ", "en", "s", 0)
    docs += [(900, None, "en", "s", 0), (901, "12 34", "en", "s", 0), (902, "привет мир как дела у вас " * 9, None, "s", 0), (None, docs[5][1], "en", "s", 0), (None, "the hill and the fox play with friends over that dog who like some outside run to", "en", "s", 0)]
    docs += [docs[7], docs[7]]
    item = " ".join(rng.choices(words["en"], k=25))
    docs.append((903, docs[40][1] + " " + item + " " + docs[41][1], "en", "s", 0))
    folder = str(tmp_path)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars int").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(0, count, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, docs


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    folder, docs = make(spark, tmp_path)
    frame = common.table(spark, folder, "documents")
    columns, ids = frame.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = common.written(stage(spark, frame, folder), name)
        assert frame.columns == columns
        ids[name] = [r.doc_id for r in frame.collect()]
    assert not {900, 901, 902} & set(ids["language"]) and len(ids["language"]) == len(docs) - 3
    assert len(ids["quality"]) >= 0.9 * len(ids["language"])
    left = ids["near_duplicates"]
    assert 20 not in left and 31 not in left and left.count(7) <= 1 and len([i for i in left if i is None]) <= 1
    assert len(left) == len(set(left))
    assert 903 not in ids["decontamination"] and set(left) - set(ids["decontamination"]) == {903} & set(left)
    out = corpus_pipeline.run(spark, folder).collect()
    assert all(len(r.ids) == r.n_tokens > 0 for r in out)
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in out) == sorted(-1 if i is None else i for i in ids["decontamination"])


def test_empty_documents(spark, tmp_path):
    folder, _ = make(spark, tmp_path)
    empty = common.table(spark, folder, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).collect() == []


def test_clashing_columns(spark, tmp_path):
    folder, _ = make(spark, tmp_path)
    frame = common.table(spark, folder, "documents").selectExpr("*", "1 as score", "2 as accepted", "'x' as component_id")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, frame, folder)
        assert out.columns == frame.columns and isinstance(out.first(), Row)
