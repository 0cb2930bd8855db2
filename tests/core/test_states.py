import pytest

from ledgerlens.plans import fixtures, states
from ledgerlens.plans.sql import SqlError

M = "master_txn_table"
PAIRS = [
    (f"SELECT SUM(Credit) FROM {M} WHERE Transaction_TYPE = 'invoice'", f"SELECT SUM(Credit) AS x FROM {M} WHERE lower(Transaction_TYPE) = 'invoice'"),
    (f"SELECT SUM(Credit) FROM {M} WHERE Transaction_TYPE = 'invoice'", f"SELECT SUM(Credit) FROM {M} WHERE Transaction_TYPE = 'bill'"),
    ("SELECT (", "SELECT 1"),
    (f"SELECT Customers, SUM(Open_balance) AS b FROM {M} WHERE Account = 'Accounts Receivable' GROUP BY Customers ORDER BY b DESC", f"SELECT Customers, SUM(Open_balance) FROM {M} WHERE Account = 'Accounts Receivable' GROUP BY 1 ORDER BY 2"),
    (f"SELECT COUNT(*) FROM {M} WHERE AR_paid = 'paid' AND Transaction_DATE > '2030-01-01'", f"SELECT COUNT(*) FROM {M} WHERE AR_paid = 'paid'"),
    (f"SELECT SUM(Quantity) FROM {M} WHERE Customers = 'Mrs. O''Hara'", f"SELECT COUNT(*) FROM {M} WHERE Customers = 'Somebody'"),
    (f"SELECT SUM(m.Debit) FROM {M} m JOIN chart_of_accounts c ON m.Account = c.Account_name WHERE c.Account_type = 'Expense'", f"SELECT SUM(Debit) FROM {M} WHERE Account IN (SELECT Account_name FROM chart_of_accounts WHERE Account_type = 'Expense')"),
    (f"SELECT SUM(Credit) FROM {M} WHERE Transaction_TYPE = 'unknown kind'", f"SELECT SUM(nothing) FROM {M}"),
    (f"SELECT SUM(Credit) FROM {M} WHERE Transaction_TYPE = 'invoice'", None),
]


def test_verdicts_equal_those_of_one_pair_at_a_time(spark):
    frame = spark.createDataFrame([(f"p{k}", g, m) for k, (g, m) in enumerate(PAIRS)], "pair string, gold_sql string, generated_sql string").repartition(3)
    got = {r.pair: r for r in states.verdicts(spark, frame).collect()}
    for k, (gold, made) in enumerate(PAIRS):
        want, own = fixtures.accounting_verdict(spark, gold, made or ""), got[f"p{k}"]
        assert (own.eq_acct, own.applicable, own.tested, own.failed) == (want["eq_acct"], want["applicable"], want["tested"], want["failed"]), (gold, own, want)
        assert own.reasons == want["reasons"], (gold, own, want)
        assert [s.asDict() for s in own.states or []] == want["states"]
        key = lambda m: (m["template"], m["family"])
        assert sorted((m.asDict() for m in own.mutants or []), key=key) == sorted(want["mutants"], key=key)
        assert [f.asDict() for f in own.failures or []] == want["failures"]
        assert sorted(own.unseeded) == sorted(f"{c}: {v}" for c, v in want["unseeded"])
    assert states.verdicts(spark, frame.limit(0)).collect() == []


def test_queries_over_one_state():
    assert states.in_state(f"SELECT COUNT(*) FROM {M}", "x") == f"SELECT COUNT(*) FROM {M} WHERE {M}._state = 'x'"
    joined = states.in_state("SELECT v.* FROM vendors v LEFT JOIN products p ON v.id = p.id WHERE v.id = 1 OR v.id = 2", "x")
    assert "ON (v.id = p.id) AND p._state = 'x'" in joined and joined.endswith("WHERE (v.id = 1 OR v.id = 2) AND v._state = 'x'") and "v.Vendor_name" in joined and "*" not in joined
    nested = states.in_state("WITH a AS (SELECT id FROM customers) SELECT id FROM a WHERE id IN (SELECT id FROM vendors)", "x")
    assert nested.count("_state") == 2 and "a._state" not in nested
    with pytest.raises(SqlError):
        states.in_state("SELECT 1 FROM vendors RIGHT JOIN products ON 1", "x")


def test_texts_of_one_shape_are_placed_once(monkeypatch):
    texts = [f"SELECT SUM(Credit) FROM {M} WHERE Customers = '{{s}}' AND Amount > 5", "SELECT v.* FROM vendors v LEFT JOIN products p ON v.id = p.id WHERE v.Vendor_name = '{s}' OR v.id = 2", f"SELECT a.Credit FROM {M} AS a WHERE '{{s}}' <> a.Vendor -- '{{s}}'", f"SELECT \"x'y\", '{{s}}' FROM {M}"]
    placed = states.placing()
    for text in texts:
        for s in ("a", "O''Hara", "", "é {0}"):
            for state in ("f:plain", "g:doubled"):
                sql = text.replace("{s}", s)
                assert placed(sql, state) == states.in_state(sql, state), sql
    monkeypatch.setattr(states, "parse", lambda sql: pytest.fail("read again"))
    assert placed(texts[0].replace("{s}", "b"), "h:plain").endswith("._state = 'h:plain'")
