"""A shape of texts is read once, and gives every text what reading it by itself gives."""

import pytest

from ledgerlens.plans import facts, fuse, layers, profile, verify
from ledgerlens.plans.facts import by_shape, facts_by_shape, facts_of
from ledgerlens.plans.notes import Notes, ledger_notes

NOTES = ledger_notes()
TEXTS = (
    "SELECT SUM(l.Credit) AS s FROM ledger l WHERE l.Amount > 5 AND l.Account = '{s}' GROUP BY l.Customers ORDER BY s DESC LIMIT {n}",
    "SELECT a, {n} + -{n}.5, x'0{n}', \"a'{n}\", [b{n}] FROM t{n} WHERE b IN ('{s}', {n}, '{n}') -- {n} '{s}'",
    "SELECT 'it''s {s}' AS \"{s}\", :p{n} FROM t JOIN u ON t.a = u.a AND u.b = '{s}' /* '{n}' */ LIMIT {n} OFFSET {n}",
    "SELECT a '{s}' FROM t '{s}'", "SELECT t.a FROM t AS 't' WHERE a BETWEEN {n} AND {n}", "SELEC {n}", "SELECT '{s}", "SELECT {n}e3, 0x1F, {n}. FROM t WHERE NOT a = -{n} OR b LIKE '%{s}%'",
    "SELECT a FROM t WHERE b IN (SELECT c FROM u WHERE d = '{s}') LIMIT 0{n}", "WITH c AS (SELECT {n} AS a) SELECT a FROM c ORDER BY a + {n}",
)
VALUES = (("x", 7), ("O''Brien", 1), ("t", 10), ("", 0), ("é \n--", 365), ("90706050403", 90706050403), ("0", 12))


@pytest.mark.parametrize("text", TEXTS)
def test_facts_by_shape(text):
    for s, n in VALUES * 2:
        sql = text.replace("{s}", s).replace("{n}", str(n))
        assert facts_by_shape(sql) == facts_of(sql), sql


def test_a_shape_is_read_once(monkeypatch):
    read = []
    monkeypatch.setattr(facts, "_shapes", {})
    monkeypatch.setattr(facts, "parse", lambda sql, own=facts.parse: read.append(sql) or own(sql))
    for k in range(100):
        facts_by_shape(f"SELECT SUM(a) FROM t WHERE b = 'c{k}' LIMIT {k}")
    assert len(read) == 2


NUMBERED = (
    "SELECT Customers, SUM(Credit) FROM master_txn_table WHERE Amount > {n} GROUP BY Customers, strftime('%Y', Transaction_DATE)", "SELECT SUM(Credit) FROM master_txn_table WHERE strftime('%Y', Transaction_DATE) = strftime('%Y', 'now') - {n}",
    "SELECT SUM(CASE WHEN Transaction_TYPE = 'bill' THEN Credit ELSE {n} END) FROM master_txn_table", "SELECT a FROM (SELECT {n} AS a) t", "SELEC {n}", "SELECT a{n} FROM t ! {n} §", "SELECT Amount FROM master_txn_table WHERE Transaction_TYPE IN ('4', {n}, 5) LIMIT {n}",
    "SELECT Amount FROM master_txn_table WHERE Account IN ({n}, '{n}', 9)", "SELECT Credit - ({n}) FROM master_txn_table ORDER BY {n}",
)


@pytest.mark.parametrize("text", NUMBERED)
@pytest.mark.parametrize("row", [lambda sql: (layers.profile_text(layers.layers(sql, NOTES)), layers.described(sql, NOTES)), lambda sql: (profile.profile_text(profile.compact_profile(sql, NOTES)), profile.profile_text(profile.full_profile(sql, NOTES)))])
def test_rows_by_shape(text, row):
    told = by_shape(row, NOTES.numbers())
    for n in (1, 5, 0, 12, 1, 345, 99999, 4, 10, "007"):
        sql = text.replace("{n}", str(n))
        assert told(sql) == row(sql), sql


def test_rows_of_one_shape_are_worked_out_once():
    seen = []
    told = by_shape(lambda sql: seen.append(sql) or (sql,))
    assert [told(f"SELECT a FROM t WHERE b > {k}") for k in range(1, 200)] == [(f"SELECT a FROM t WHERE b > {k}",) for k in range(1, 200)]
    assert len(seen) == 3


def test_notes_are_made_once_for_all_rows(monkeypatch):
    own, made = Notes({"t": {"a": {"semantic_role": "financial_measure"}}}), []
    monkeypatch.setattr(verify, "compact_profile", lambda sql, notes: made.append(sql) or {"status": "OK"})
    assert len({verify.execution_profile("SELECT a FROM t", own) for _ in range(50)}) == 1 and len(made) == 1


def test_mutants_are_planned_in_many_tasks_with_one_set_of_notes(spark, monkeypatch):
    from ledgerlens.plans import fixtures, queries, states

    pairs = queries.customer_pairs(spark, "/root/testdata/sf0.001")
    assert pairs.rdd.getNumPartitions() >= 3 * spark.sparkContext.defaultParallelism
    monkeypatch.setattr(fixtures, "ledger_notes", lambda: pytest.fail("notes are made for each text"))
    assert fixtures.evidence_of("SELECT SUM(Credit) FROM master_txn_table WHERE Customers = 'a'", NOTES).parties == {"customer"}
    assert states.planned(pairs).select("pair").count() == pairs.count()


SHARED = (
    "SELECT ROUND(SUM(Amount), 2) FROM l WHERE Vendor = '{s}' AND Kind = '{t}' AND Day <= date('1997-01-01', '+1 year')", "SELECT Kind, COUNT(*) FROM l WHERE Vendor = '{s}' GROUP BY Kind ORDER BY Kind DESC LIMIT 3",
    "SELECT SUM(CASE WHEN Kind = '{s}' THEN Amount END) FROM l WHERE Vendor = '{t}'", "SELECT SUM(Amount) FROM l WHERE '{s}' = Vendor AND Vendor = '{t}'", "SELECT SUM(Amount) FROM l WHERE Vendor = '{s}' OR Kind = '{t}'", "SELECT SUM(Amount) AS '{s}' FROM l WHERE Kind <= '{s}' AND Vendor =\n'{t}'",
    "SELECT SUM(Amount) FROM l WHERE Day = '{s}'", "SELECT SUM(Amount) FROM l WHERE Amount = '{s}' AND Vendor = '{t}'", "SELECT Vendor FROM l WHERE Vendor = '{s}'", "SELECT SUM(Amount) FORM l WHERE Vendor = '{s}'",
)


@pytest.mark.parametrize("text", SHARED)
def test_shared_parts_by_shape(text):
    types = {"vendor": "text", "kind": "text", "day": "text", "amount": "real"}
    told = fuse.sharing("1998-01-01", types, {"vendor", "kind"})
    for s, t in (("a", "b"), ("O''Brien", "{x}"), ("b", "b"), ("", "1997-01-01"), ("é", "= 'no")):
        if t.count("'") % 2 == 0:
            sql = text.replace("{s}", s).replace("{t}", t)
            assert told(sql) == fuse.shared(sql, "1998-01-01", types, {"vendor", "kind"}), sql


def test_statements_of_one_shape_are_parsed_once(monkeypatch):
    read = []
    monkeypatch.setattr(fuse, "parse", lambda sql, own=fuse.parse: read.append(sql) or own(sql))
    told = fuse.sharing("1998-01-01", {"vendor": "text", "amount": "real"}, {"vendor"})
    assert [told(f"SELECT SUM(Amount) FROM l WHERE Vendor = 'v{k}'").literals for k in range(50)] == [(f"v{k}",) for k in range(50)]
    assert len(read) == 1
