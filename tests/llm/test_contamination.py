import random

import pytest

from ledgerlens.llm import contamination as c

WORDS = [a + b for a in "bcdfglmnprst" for b in ("a", "e", "io", "é")]


def make(seed=1):
    rng = random.Random(seed)
    items = [(k, " ".join(rng.choices(WORDS, k=rng.choice([1, 2, 4, 5, 6, 9, 20, 60])))) for k in range(40)] + [(40, ""), (41, None), (42, "?!"), (43, None)]
    items.append((44, items[10][1]))
    docs = []
    for k in range(150):
        words = rng.choices(WORDS, k=rng.randrange(0, 400))
        item = (items[rng.randrange(40)][1]).split()
        for _ in range(rng.choice([0, 0, 1, 3])):
            if item:
                item[rng.randrange(len(item))] = "zz"
        at = rng.randrange(len(words) + 1)
        docs.append((k, " ".join(words[:at] + [x.upper() + "," for x in item] + words[at:])))
    docs += [(200, None), (201, ""), (202, "..."), (None, items[12][1]), (203, items[12][1]), (203, items[12][1])]
    return docs, items


def slow(docs, items):
    out = []
    for d, text in docs:
        words = c.words_of(text or "")
        for i, item in items:
            own = c.shingles_of(c.words_of(item or ""))
            if not own:
                continue
            wide = len(next(iter(own)))
            held = len(own & {tuple(words[k : k + wide]) for k in range(len(words) - wide + 1)})
            if held >= 0.8 * len(own) - 1e-9:
                out.append((-1 if d is None else d, i, held, len(own)))
    return sorted(out)


@pytest.mark.parametrize("chars", [50, 1 << 23])
def test_equals_brute_force(spark, chars):
    docs, items = make()
    left = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, item_id int").repartition(3)
    right = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, doc_id int")
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.item_id, r.held, r.shingles) for r in c.contained_items(left, right, block_chars=chars).collect())
    assert got == slow(docs, items) and len(got) > 50


def test_kept_rows(spark):
    docs, items = make(2)
    bad = {d for d, *_ in slow(docs, items)}
    left = spark.createDataFrame(docs, "doc_id long, text string")
    right = spark.createDataFrame(items, "item_id long, text string")
    kept = sorted(-1 if r.doc_id is None else r.doc_id for r in c.without_items(left, right).collect())
    assert kept == sorted(x for x in (-1 if d is None else d for d, _ in docs) if x not in bad)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert c.contained_items(docs, none).collect() == []
    assert c.contained_items(docs.limit(0), spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")).collect() == []


def test_long_document_with_a_short_item():
    index = c.ItemIndex([(1, "one two three four five six seven")])
    assert index.search("filler " * 200_000 + "one two three four five six seven" + " filler" * 1000) == [(1, 3, 3)]


def test_sql_equals_the_operator(spark, tmp_path):
    import duckdb

    docs, items = make(3)
    left, right = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    db = duckdb.connect()
    for name, frame in (("documents", left), ("benchmark", right)):
        frame.write.parquet(f"{tmp_path}/{name}")
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}/*.parquet')")
    want = sorted((-1 if d is None else d, i, h, n, round(x, 9)) for d, i, h, n, x in db.execute(c.SQL).fetchall())
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.item_id, r.held, r.shingles, round(r.containment, 9)) for r in c.contained_items(left, right).collect())
    assert got == want and len(got) > 50
