"""Pairs that differ by names that are only compared are judged once, with the verdicts that they have by themselves."""

import pytest

from ledgerlens.plans import alike, states
from ledgerlens.plans.notes import Notes, ledger_notes

M = "master_txn_table"
GOLD = f"SELECT SUM(Credit) FROM {M} WHERE Transaction_TYPE = 'invoice' AND Customers = '%s'"
#: Names: plain ones, with quotes and patterns, and ones that fixtures or mutants have of themselves.
PEOPLE = ["Customer#000000001", "Zed", "Mrs. O''Hara", "50%_", "{0}", " ", "", "North Bakery", "south cinema", "Invoice", "bill", "Checking", "Seed x", "name 0 of the pair", "é\n"]
SHAPES = [
    (GOLD, GOLD), (GOLD, GOLD.replace("Credit", "Debit")), (GOLD, GOLD.replace("invoice", "bill")), (GOLD, f"SELECT SUM(m.Credit) FROM {M} m WHERE '%s' = m.Customers AND lower(m.Transaction_TYPE) LIKE 'INVOICE'"),
    (GOLD, f"SELECT SUM(Credit) FROM {M} WHERE Customers IN ('%s', 'Nobody') AND Transaction_TYPE = 'invoice'"), (f"SELECT SUM(Quantity) FROM {M} WHERE Customers = '%s' AND Vendor != 'Aunt'", f"SELECT SUM(Quantity) FROM {M} WHERE Vendor = '%s'"),
    (GOLD, f"SELECT SUM(Credit) FROM {M} WHERE Transaction_TYPE = 'invoice' AND Customers LIKE '%s'"), (f"SELECT Customers, COUNT(*) FROM {M} WHERE Customers = '%s' GROUP BY Customers ORDER BY Customers", GOLD),
]


def test_verdicts_are_those_of_pairs_by_themselves(spark):
    rows = [(f"{k} {n}", g.replace("%s", name), m.replace("%s", name)) for k, (g, m) in enumerate(SHAPES) for n, name in enumerate(PEOPLE) if n < 2 or (n + k) % 3 == 0]
    frame = spark.createDataFrame(rows, "pair string, gold_sql string, generated_sql string").repartition(3)
    together, apart = ({r.pair: r.asDict(True) for r in found(spark, frame).collect()} for found in (states.verdicts, states.judged))
    assert len(together) == len(rows) and together == apart
    assert together["4 1"]["unseeded"] == ["customers: Nobody"]


def test_pairs_of_other_names_are_judged_once(spark, monkeypatch):
    counts = []
    monkeypatch.setattr(states, "planned", lambda pairs, *more, own=states.planned: counts.append(pairs.count()) or own(pairs, *more))
    rows = [(str(k), GOLD % f"Customer {k}", m % f"Customer {k}") for k in range(120) for m in (SHAPES[k % 3][1],)]
    found = {int(r.pair): r.eq_acct for r in states.verdicts(spark, spark.createDataFrame([*rows, *rows[:5]], "pair string, gold_sql string, generated_sql string")).collect()}
    assert counts == [3] and len(found) == 120
    assert {k % 3: v for k, v in found.items()} == {0: 1, 1: 1, 2: 0} and all(v == (0 if k % 3 == 2 else 1) for k, v in found.items())


def test_names_whose_spelling_may_show_stay():
    told = alike.renaming(ledger_notes())
    where = f"SELECT COUNT(*) FROM {M} WHERE Customers = 'Zed'"
    assert told(where, where) == (where.replace("Zed", "name 0 of the pair"),) * 2 + (["Zed"],)
    assert told(f"{where} OR Customers = 'Abe'", where)[2] == ["Abe", "Zed"] and "'name 1 of the pair'" in told(f"{where} OR Customers = 'Abe'", where)[1]
    other = told(where, where.replace("Zed", "zoe"))
    assert other[2] == ["Zed", "zoe"] and other[0] != other[1]
    shown = [
        "SELECT Customers FROM {M} WHERE Customers = 'Zed'", "SELECT MAX(Customers) FROM {M} WHERE Vendor = 'Zed'", "SELECT COUNT(*) FROM {M} WHERE Customers < 'Zed'", "SELECT COUNT(*) FROM {M} WHERE lower(Customers) = 'Zed'", "SELECT 'Zed' FROM {M} WHERE Customers = 'Zed'",
        "SELECT * FROM {M} WHERE Customers = 'Zed'", "SELECT COUNT(*) FROM {M} WHERE Customers = 'Zed' COLLATE NOCASE", "SELECT COUNT(*) FROM {M} WHERE Customers = 'Zed' AND Account = 'zed '", "SELECT COUNT(*) FROM {M} WHERE Customers = 'Zed' OR Customers = 'ZED'",
        "SELECT COUNT(*) FROM {M} WHERE Customers = 'Zed' OR Customers = 'North Bakery'", "SELECT COUNT(*) FROM customers WHERE customer_name = 'Zed'", "SELECT COUNT(*) FROM (SELECT Account FROM {M} WHERE Customers = 'Zed') s", "SELECT SUM(Credit) OVER (ORDER BY Customers) FROM {M} WHERE Vendor = 'Zed'",
        "SELECT COUNT(*) FROM {M} WHERE \"Customers\" = 'Zed'", "SELECT Account AS Vendor FROM {M} WHERE Customers = 'Zed'", "SELECT COUNT(*) FROM {M} a JOIN {M} b USING (Customers) WHERE a.Vendor = 'Zed'", "SELECT COUNT(*) AS 'Zed' FROM {M} WHERE Customers = 'Zed'", "SELECT COUNT( FROM {M} WHERE Customers = 'Zed'", "SELECT CASE Customers WHEN 'Zed' THEN 1 END FROM {M}",
    ]
    for text in (t.replace("{M}", M) for t in shown):
        assert told(where, text) == (where, text, []) and told(text, where) == (text, where, []), text
    dated = Notes({M: {"Customers": {"semantic_role": "transaction_date"}}})
    assert alike.renaming(dated)(where, where) == (where, where, [])


@pytest.mark.parametrize("sql", ["SELECT 1", "", f"SELECT SUM(Credit) FROM {M} WHERE Transaction_TYPE = 'invoice' -- 'Zed'"])
def test_texts_without_names(sql):
    assert alike.renaming(ledger_notes())(sql, sql) == (sql, sql, [])
