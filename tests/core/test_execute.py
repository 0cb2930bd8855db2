import datetime as dt
import hashlib
import random
import time

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import dataflow
from ledgerlens.plans import execute, fuse

LINES = [("a", 5.0, 1.0, "bill", dt.date(1998, 2, 3), None), ("b", 1.0, 1.0, "invoice", dt.date(1997, 2, 3), None), ("b", 0.1, 0.2, "invoice", dt.date(1997, 3, 3), None)]
SCHEMA = "Account string, Credit double, Debit double, Transaction_TYPE string, Transaction_DATE date, Empty string"
PAIRS = [
    ("SELECT SUM(Credit) FROM l", "SELECT SUM(Credit) AS total FROM l", "A_correct_executable", []),
    ("SELECT SUM(Credit) FROM l", "SELECT SUM(Debit) FROM l", "B_wrong_executable", []),
    ("SELECT Account, COUNT(*) FROM l GROUP BY Account ORDER BY Account", "SELECT Account, COUNT(*) FROM l GROUP BY 1 ORDER BY Account DESC", "B_wrong_executable", []),
    ("SELECT Account, COUNT(*) FROM l GROUP BY Account", "SELECT Account, COUNT(*) FROM l GROUP BY 1 ORDER BY Account DESC", "A_correct_executable", []),
    ("SELECT COUNT(*) FROM l", "SELECT nothing FROM l", "C_non_executable", ["generated_sql_error"]),
    ("SELECT broken FROM", "SELECT 1", "D_ambiguous", ["gold_sql_error"]),
    ("SELECT broken FROM", "", "D_ambiguous", ["gold_sql_error", "generated_sql_error"]),
    ("SELECT 1", None, "C_non_executable", ["generated_sql_error"]),
    ("SELECT Account FROM l", "SELECT Credit FROM l", "B_wrong_executable", []),
    ("SELECT 1.5", "SELECT '1.5'", "B_wrong_executable", []),
    ("SELECT 1", "SELECT 1.0", "A_correct_executable", []),
    ("SELECT 0.1 + 0.2", "SELECT 0.3", "A_correct_executable", []),
    ("SELECT Transaction_DATE FROM l", "SELECT CAST(Transaction_DATE AS TEXT) FROM l", "A_correct_executable", []),
    ("SELECT Transaction_DATE FROM l", "SELECT Credit FROM l", "B_wrong_executable", []),
    ("SELECT strftime('%Y', date('now'))", "SELECT '1998'", "A_correct_executable", []),
    ("SELECT COUNT(*) FROM l WHERE instr(lower(Account), 'a')", "SELECT 1", "A_correct_executable", []),
    ("SELECT 3/2", "SELECT 1", "A_correct_executable", []),
    ("SELECT Account FROM l WHERE 0", "SELECT 1", "B_wrong_executable", ["gold_result_empty"]),
    ("SELECT Account FROM l WHERE 0", "SELECT Credit FROM l WHERE 0", "A_correct_executable", ["both_results_empty"]),
    ("SELECT 1", "SELECT Account FROM l WHERE 0", "B_wrong_executable", ["generated_result_empty"]),
    ("SELECT Empty FROM l", "SELECT NULL FROM l", "A_correct_executable", ["gold_result_all_null", "generated_result_all_null"]),
    ("SELECT Account FROM l", "SELECT Account, Credit FROM l", "B_wrong_executable", []),
]


@pytest.fixture(scope="module")
def lines(spark):
    return spark.createDataFrame(LINES, SCHEMA)


def pairs(spark):
    rows = [(n, g, m, "failed" if n == 4 else "success", "late" if n == 4 else None) for n, (g, m, _, _) in enumerate(PAIRS)]
    return spark.createDataFrame(rows, "idx int, gold_sql string, generated_sql string, baseline_status string, baseline_error string")


@pytest.mark.parametrize("kept", [10_000, 0])
def test_groups_and_flags(spark, lines, kept):
    """With nothing kept every result is looked at in the cluster; nothing else changes."""
    engine = execute.Engine(spark, {"l": lines}, "1998-06-24", kept=kept)
    got = execute.evaluate_pairs(pairs(spark), engine).orderBy("idx").collect()
    engine.close()
    assert [r.evaluation_group for r in got] == [g for _, _, g, _ in PAIRS]
    assert [r.excluded_from_primary_metrics for r in got] == [g[0] == "D" for _, _, g, _ in PAIRS]
    assert [r.ambiguity_flags for r in got] == [f for _, _, _, f in PAIRS]
    assert got[4].error_message.startswith("baseline status: failed; baseline error: late; generated SQL error: ")
    assert got[6].error_message.startswith("generated SQL error: empty SQL; gold SQL error: ") and got[0].error_message is None
    assert got[0].generated_result == '{"row_count": 1, "truncated": false, "rows": [[6.1]]}'


def test_one_rule_at_every_size(spark):
    """All-null and empty results are told apart whatever their size, and rows are counted."""
    wide = spark.range(300).select(F.lit(None).cast("int").alias("x"), F.col("id").alias("k"), (F.col("id") % 7).alias("m"))
    texts = [("select x from t", "select x from t"), ("select k from t", "select k from t order by k desc"), ("select k from t order by k", "select k from t order by k desc"), ("select m from t order by m, k", "select k % 7 from t order by k % 7"), ("select k from t", "select k from t where k < 299"), ("select x, m from t", "select m, x from t"), ("select k from t", "select k, k from t")]
    frame = spark.createDataFrame([(n, g, m) for n, (g, m) in enumerate(texts)], "idx int, gold_sql string, generated_sql string")
    found = []
    for kept in (10_000, 100, 0):
        engine = execute.Engine(spark, {"t": wide}, "1998-06-24", kept=kept)
        found.append([(r.evaluation_group[0], r.ambiguity_flags, r.gold_result, r.generated_result) for r in execute.evaluate_pairs(frame, engine, strict=True).orderBy("idx").collect()])
        engine.close()
    assert found[0] == found[1] == found[2]
    assert [g for g, *_ in found[0]] == ["D", "A", "B", "A", "B", "B", "B"]
    assert found[0][0][1] == ["gold_result_all_null", "generated_result_all_null"]


SHARED = [
    "SELECT SUM(Credit) FROM l WHERE Account = 'b'", "SELECT SUM(Credit) - SUM(Debit) AS net, COUNT(*) FROM l", "SELECT COUNT(*) / 2, SUM(Credit) / COUNT(*) FROM l WHERE Credit > 0.5", "SELECT MAX(Transaction_DATE) FROM l WHERE Account LIKE 'A'",
    "SELECT AVG(Credit) FROM l WHERE 0", "SELECT total(Credit), COUNT(Empty), SUM(Empty) FROM l WHERE 0", "SELECT CASE WHEN COUNT(*) > 1 THEN 'many{}' ELSE 'few' END FROM l", "SELECT COUNT(DISTINCT Account) FROM l", "SELECT SUM(CASE WHEN Account = 'b' THEN Credit END) > 1 FROM l",
    "SELECT Account, SUM(Credit) AS s FROM l GROUP BY Account ORDER BY s DESC LIMIT 1", "SELECT Account, SUM(Debit) FROM l WHERE Credit < 3 GROUP BY Account", "SELECT COUNT(*), Account FROM l WHERE Credit < 0 GROUP BY Account", "SELECT Account FROM l GROUP BY Account HAVING SUM(Credit) > 2 ORDER BY Account",
    "SELECT Account, Transaction_TYPE, MIN(Credit) FROM l GROUP BY Account, Transaction_TYPE ORDER BY 3", "SELECT SUM(Nothing) FROM l", "SELECT SUM(Credit) FROM l WHERE nofunction(Account)", "SELECT SUM(Credit), Account FROM l", "SELECT l.Account, COUNT(*) AS \"a b\" FROM l GROUP BY l.Account ORDER BY \"a b\"", "SELECT SUM(a.Credit) FROM l a JOIN l b ON a.Account = b.Account WHERE b.Credit < 3",
    "SELECT SUM(Credit) FROM l WHERE Account = 'a'", "SELECT SUM(Credit) FROM l WHERE 'zz' = Account", "SELECT COUNT(*), MAX(Empty), COUNT(*) > 0 FROM l WHERE Account = 'zz' AND Credit > 0", "SELECT COUNT(*), MAX(Empty), COUNT(*) > 0 FROM l WHERE Account = 'b' AND Credit > 0", "SELECT total(Debit) FROM l WHERE Account = 'zz'",
    "SELECT SUM(Credit) FROM l WHERE Account = 'b' AND Transaction_TYPE = 'invoice' AND Account = 'a'", "SELECT SUM(Credit) FROM l WHERE Account = 'b' AND Transaction_TYPE = 'invoice'", "SELECT Transaction_TYPE, SUM(Credit) AS s FROM l WHERE Account = 'b' GROUP BY Transaction_TYPE ORDER BY s LIMIT 1", "SELECT Transaction_TYPE, SUM(Credit) AS s FROM l WHERE Account = 'c' GROUP BY Transaction_TYPE ORDER BY s LIMIT 1",
    "SELECT SUM(Credit) FROM l WHERE Account = 'it''s {x}'", "SELECT Account || '-' || COUNT(*) FROM l GROUP BY Account ORDER BY COUNT(*) DESC, Account",
]


def test_shared_scans_give_what_each_query_gives(spark, lines):
    engine = execute.Engine(spark, {"l": lines}, "1998-06-24")
    parts = [fuse.shared(t, engine.as_of, engine.types, engine.strings) for t in SHARED]
    assert [t for t, p in zip(SHARED, parts) if p is None] == [SHARED[k] for k in (6, 7, 13, 14, 16, 17)]
    for width in (80, 3):
        shared = fuse.scans([p for p in parts if p], width)
        assert width == 3 or len(shared) == 6
        got = dict(o for scan in shared for o in engine.run_scan(scan))
        assert {t: o[:-1] for t, o in got.items()} == {t: engine.run(t)[:-1] for t, p in zip(SHARED, parts) if p}
    small = execute.Engine(spark, {"l": lines}, "1998-06-24", kept=0)
    got = dict(o for scan in fuse.scans([p for p in parts if p and p.keys]) for o in small.run_scan(scan))
    assert {t: o[:4] for t, o in got.items()} == {t: engine.run(t)[:4] for t in got}
    engine.close()
    small.close()


def test_unequal_rows_by_digests(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(50), rng.choice(["a", "b", None])) for _ in range(3000)]
    a, b = (spark.createDataFrame(r, "x int, y string") for r in (rows, rows[:-3] + [(99, None), (99, None)]))
    want = sorted(map(tuple, dataflow.bag_difference(a, b).collect()), key=repr)
    assert want
    for buckets in (1, 2, 1024):
        assert sorted(map(tuple, dataflow.unequal_rows(a, b, buckets).collect()), key=repr) == want
    assert dataflow.unequal_rows(a, a.orderBy("y")).collect() == [] and dataflow.unequal_rows(a.limit(0), a.limit(0)).collect() == []
    swapped = spark.createDataFrame([(None, "a")], "x string, y string"), spark.createDataFrame([("a", None)], "x string, y string")
    assert not dataflow.bags_equal(*swapped) and dataflow.bags_equal(swapped[0], swapped[0]) and dataflow.bags_equal(a.limit(0), b.limit(0))


def test_strict_mode(spark, lines):
    engine = execute.Engine(spark, {"l": lines}, "1998-06-24")
    got = execute.evaluate_pairs(pairs(spark), engine, strict=True).orderBy("idx").collect()
    engine.close()
    assert [r.evaluation_group[0] for r in got] == ["D" if any("result" in x for x in f) else g[0] for _, _, g, f in PAIRS]


def test_no_pairs_and_late_queries(spark, lines):
    engine = execute.Engine(spark, {"l": lines}, "1998-06-24")
    assert execute.evaluate_pairs(pairs(spark).limit(0), engine).collect() == []
    engine.close()
    engine = execute.Engine(spark, {"n": spark.range(20_000).coalesce(1)}, "1998-06-24", timeout=0.5)
    began = time.monotonic()
    assert engine.run("SELECT SUM(a.id * b.id % 7) FROM n a, n b WHERE a.id <> b.id * c.id")[0] and engine.run("SELECT SUM(a.id * b.id % 7 + c.id) FROM n a, n b, n c WHERE a.id <> b.id * c.id")[0].startswith("query_timeout")
    assert time.monotonic() - began < 60
    engine.close()


def test_rounding_is_exact(spark):
    rng = random.Random(1)
    xs = [0.0000005, 0.0000015, 0.0000025, -2.5e-6, 1 / 3, 1e9 + 0.1234565, 5e-324, 1e300, float(1 << 33) + 0.1, 0.0, -7.0]
    xs += [rng.randrange(10**9) * 1e-6 + 5e-7 for _ in range(2000)] + [rng.uniform(-1e6, 1e6) for _ in range(2000)] + [rng.randrange(10**12) / 2 ** rng.randrange(10, 40) for _ in range(2000)]
    frame = spark.createDataFrame(list(enumerate(xs)), "k int, x double").select("k", dataflow.round6(F.col("x")).alias("r"))
    assert [(r.k, r.r) for r in frame.orderBy("k").collect()] == [(k, round(x, 6)) for k, x in enumerate(xs)]


def test_bags_and_orders(spark):
    a = spark.createDataFrame([(1, 0.1), (1, 0.1), (2, None)], "x int, y double")
    b = spark.createDataFrame([(2.0, None), (1.0, 0.1000000001), (1.0, 0.1)], "p double, q double")
    assert dataflow.bags_equal(a, b) and not dataflow.bags_equal(a, b.limit(2)) and not dataflow.bags_equal(a, b.select("p"))
    assert not dataflow.bags_equal(a.select("x"), a.select(F.col("x").cast("string")))
    one = spark.range(500).orderBy(F.desc("id"))
    assert dataflow.ordered_difference(one, one.select(F.col("id").cast("double"))).isEmpty()
    assert [r.at for r in dataflow.ordered_difference(one, one.where("id <> 100")).orderBy("at").collect()] == list(range(399, 500))
    assert dataflow.raw_equal(one, one) and not dataflow.raw_equal(one, one.orderBy("id")) and not dataflow.raw_equal(b.select("q"), b.select(F.round("q", 6)))


def test_rows_are_numbered_in_their_order(spark):
    frame = spark.range(1000).repartition(7).orderBy(F.desc("id"))
    assert [(r.at, r.id) for r in dataflow.numbered(frame).orderBy("at").collect()] == [(k, 999 - k) for k in range(1000)]
    assert dataflow.numbered(spark.range(0)).collect() == []


def test_statements_over_an_absent_table_fail_together(spark, monkeypatch):
    engine = execute.Engine(spark, {"l": spark.createDataFrame([("a", 1.0)], "v string, x double")}, "2024-01-01")
    asked = []
    monkeypatch.setattr(engine, "run", lambda sql, own=engine.run: asked.append(sql) or own(sql))
    texts = [f"SELECT SUM(x) FROM {t} WHERE v = 'v{k}'" for k in range(40) for t in ("l", "gone")]
    outcomes, path = execute.outcomes_of(engine, iter(texts), 2)
    errors = [r.error for r in outcomes.collect()]
    engine.close()
    assert path is None and errors.count("no such table: gone") == 40 and errors.count(None) == 40 and not asked


def test_shapes_are_answered_in_the_cluster(spark, lines, monkeypatch):
    """Texts of a shape, and those that cannot run, never reach the driver, and have the outcomes that each has by itself."""
    held = [
        "SELECT SUM(Credit) FROM l WHERE Account = '{a}'", "SELECT COUNT(*), MAX(Empty), COUNT(*) > 0, AVG(Debit) FROM l WHERE Account = '{a}' AND Credit > 0.5", "SELECT total(Debit), MAX(Transaction_DATE), MIN(Account) FROM l WHERE Account = '{a}' AND Transaction_TYPE = 'invoice'",
        "SELECT SUM(Credit) AS s, SUM(Debit) AS s, NULL = SUM(Credit) AS t FROM l x WHERE '{a}' = x.Account", "SELECT SUM(nothing) FROM l WHERE Account = '{a}'", "SELECT SUM(Credit) FROM gone WHERE Account = '{a}'", "SELECT SUM(Credit) FORM l WHERE Account = '{a}'",
    ]
    alone = ["SELECT Account, COUNT(*) FROM l WHERE Account = 'b' GROUP BY Account", "SELECT 1", "SELECT MAX(CAST(Credit AS TEXT)) FROM l WHERE nofunction(Account)", ""]
    texts = [t.replace("{a}", a) for t in held for a in ("a", "b", "it''s", "")] + alone
    engine, asked = execute.Engine(spark, {"l": lines}, "1998-06-24"), []
    frame = spark.createDataFrame([(t,) for t in texts], "sql string").select(F.sha2("sql", 256).alias("h"), "sql")
    want = {hashlib.sha256(t.encode()).hexdigest(): engine.run(t)[:-1] for t in texts}
    monkeypatch.setattr(execute, "outcomes_of", lambda e, rest, workers, own=execute.outcomes_of: own(e, iter([asked.append(t) or t for t in rest]), workers))
    for many, left in ((1, 3), (5, 19)):
        asked.clear()
        found, paths = execute.outcomes(engine, frame, 2, many)
        got = {r.h: tuple(r)[1:-1] for r in found.collect()}
        assert got == want and len(asked) == left and not any("nothing" in t or "gone" in t or "FORM" in t for t in asked)
        for path in paths:
            execute.remove(spark, path)
    engine.close()
