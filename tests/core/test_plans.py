import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import scalars as S
from ledgerlens.plans import fixtures, gates, notes, profile, repair
from ledgerlens.plans.notes import Notes, ledger_notes

T = "master_txn_table"
REPAIRS = [
    ("financial_measure_error", "SELECT SUM(Credit) FROM l", "SELECT SUM(Debit) FROM l"), ("financial_measure_error", "SELECT SUM(Credit) FROM l", "select sum(credit)  from l;"), ("financial_measure_error", "SELECT a FROM l", "SELECT a FROM"),
    ("financial_object_error", "SELECT a FROM l WHERE t = 'x'", "SELECT a FROM l WHERE t = 'y' LIMIT 3"), ("computation_logic_error", "SELECT a FROM l WHERE due_date > '2024-01-01'", "SELECT a FROM l WHERE due_date > '2023-01-01'"),
    ("computation_logic_error", "SELECT SUM(a) AS s, c FROM l GROUP BY c ORDER BY s", "SELECT SUM(a), c FROM l GROUP BY c ORDER BY s"), ("computation_logic_error", "SELECT SUM(a) FROM l", "SELECT SUM(a), c FROM l GROUP BY c"),
    ("other", "SELECT a FROM l", "SELECT b FROM l"), ("financial_object_error", "SELECT a FROM l JOIN m ON l.x = m.x", "SELECT a FROM l LEFT JOIN m ON l.x = m.x"), ("computation_logic_error", "SELECT a FROM l WHERE k = 1 AND due_date > '2024-01-01'", "SELECT a FROM l WHERE k = 1"),
]
INTENTS = [None, "{}", json.dumps({"slots": {"operation": {"group_by": ["c"]}}}), json.dumps({"slots": {"operation": {"limit": 3}, "time": {"requires_group_by_period": True}}}), json.dumps({"operation": {"comparison": {"required": True}}})]
QUESTIONS = ["what is the total", "total by customer", "which vendor was paid", None, "Top five per month"]


def test_gates_as_columns_say_what_they_say_row_by_row(spark):
    rows = [(n, mode, a, b, q, i) for n, (mode, a, b) in enumerate(REPAIRS) for q in QUESTIONS for i in INTENTS]
    frame = spark.createDataFrame(rows, "n int, repair_mode string, before_sql string, after_sql string, question string, intent string").repartition(2)
    for r in gates.with_gates(frame, question="question", intent="intent").collect():
        scope = repair.scope_of(r.before_sql, r.after_sql, r.repair_mode)
        assert (r.scope.changed, r.scope.status, r.scope.violated) == (scope["changed"], scope["status"], scope["violated"]), r
        found = repair.grouping_of(r.before_sql, r.after_sql, r.repair_mode, r.question, json.loads(r.intent) if r.intent else None)
        assert r.grouping is None and r.repair_mode != "computation_logic_error" or r.grouping.status == found["status"], r
    assert gates.with_gates(frame.limit(0)).collect() == []


def test_period_hints_as_column_and_in_python(spark):
    low = ("date('now','start of year')", "date('now', 'start of month')", "date('now','weekday 0','-6 days')", "date('now','-12 months')", "date('now','-1 year')", "2024-01-01", "x", None, "DATE('now',\n'start of year')")
    high = ("date('now')", "current_date", "date('now','start of month','-1 day')", "2024-02-01", None)
    rows = [(o, a, b, e) for o in ("BETWEEN", ">=", ">", "<", "<=", "=", "LIKE", "IN") for a in low for b in high for e in ("", "strftime('%Y', d)", None)]
    frame = spark.createDataFrame(rows, "o string, a string, b string, e string")
    for r in frame.withColumn("h", S.period_hint(*map(F.col, "oabe"))).collect():
        assert r.h == S.period_of(r.o, r.a, r.b, r.e), r


def test_lookups_and_values(spark):
    own = Notes({"t": {"x": {"semantic_role": "a", "value_concepts": {"Paid": "paid"}, "missing_value_policy": {"missing_markers": ["--"], "meaning": "open"}}}, "u": {"x": {"semantic_role": "b"}, "y": {"semantic_role": "c"}}})
    refs = spark.createDataFrame([(1, "X", None, []), (2, "x", "U", []), (3, "y", None, []), (4, "z", None, []), (5, None, None, []), (6, "x", None, ["t"])], "id int, column string, table string, candidates array<string>")
    got = {}
    for r in notes.look_up_columns(refs, own).collect():
        got.setdefault(r.id, []).append((r.semantic_role, r.resolution))
    assert {k: sorted(v, key=str) for k, v in got.items()} == {
        1: [("a", "ambiguous_unqualified"), ("b", "ambiguous_unqualified")], 2: [("b", "qualified")], 3: [("c", "unique_unqualified")], 4: [(None, "unresolved")], 5: [(None, "unresolved")], 6: [("a", "unique_unqualified")]}
    values = spark.createDataFrame([("t", "x", "Paid"), ("t", "x", " 'paid' "), ("t", "x", "--"), ("t", "x", "odd"), ("t", "x", None), ("u", "y", "q")], "table string, column string, value string")
    found = {(r["table"], r["value"]): (r.status, r.concept) for r in notes.resolve_values(values, own).collect()}
    for (table, value), (status, concept) in found.items():
        literal = own.find("x" if table == "t" else "y", table)[0].resolve(value)
        assert (status, concept) == (literal.status, literal.concept)


def test_profiles():
    full = profile.full_profile(f"SELECT Customers, SUM(Credit) FROM {T} WHERE Transaction_TYPE = 'invoice' AND Transaction_DATE >= '2024-01-01' GROUP BY Customers")
    assert full["object_scope"]["transaction_type_concepts"] == ["invoice"] and full["logic"]["temporal_roles"] == ["transaction_date"] and full["parse_error"] is None
    assert full["measure_usage"]["posting_sides"] == ["credit"] and len(full["logic"]["date_conditions"]) == 1
    small = profile.compact_profile(f"SELECT AVG(Amount) FROM {T} GROUP BY Vendor ORDER BY 1 LIMIT 3")
    assert small["topology"]["analytical_grain"] == "vendor_level" and small["topology"]["limit"] == 3 and small["absence_signals"]["transaction_type_filter"] == "missing" and small["absence_signals"]["ordering"] == "present"
    assert profile.compact_profile("SELECT (")["status"] == "parse_error" and profile.full_profile(None)["parse_error"]
    assert profile.compact_profile("SELECT a FROM (SELECT 1 AS a) t")["unsupported_lineage"] is True
    assert profile.pruned({"a": None, "b": [None, {"c": ""}, 0, False], "d": {}})["b"][-2:] == [0, False]


def test_profiles_of_rows(spark):
    frame = spark.createDataFrame([(1, f"SELECT COUNT(*) FROM {T}"), (2, None), (3, "SELECT (")], "id int, sql string").coalesce(1)
    got = profile.with_profiles(frame, "sql").collect()
    assert [r.profile_status for r in got] == ["OK", "PARSE_ERROR", "PARSE_ERROR"] and got[0].grain == "global_summary" and got[0].functions == ["COUNT"]
    assert profile.with_profiles(frame.limit(0), "sql", full=True).collect() == []


def test_evidence_and_mutants():
    found = fixtures.evidence_of(f"SELECT COUNT(*) FROM {T} WHERE AR_paid = 'paid' AND 'bill' = Transaction_TYPE AND Transaction_DATE > '1998-01-01'")
    assert found.counts and found.of("transaction_type") == {"bill"} and found.dates and not found.error
    assert fixtures.applicable(fixtures.evidence_of("SELECT (")) == [] and fixtures.applicable(fixtures.evidence_of("SELECT a FROM (SELECT 1 AS a) t")) == []
    for name in fixtures.TEMPLATES:
        sql = f"SELECT SUM(Credit), SUM(Debit), COUNT(*), COUNT(DISTINCT Transaction_ID) FROM {T} WHERE AR_paid = 'paid' AND Transaction_TYPE = 'invoice' AND Transaction_DATE > '1998-01-01'"
        made = fixtures.mutants(sql, name)
        texts = [t for _, t, _ in made if t]
        assert len(texts) == len(set(texts)) and all((t is None) == bool(why) for _, t, why in made)
    assert all(why.startswith("parse_error") for _, _, why in fixtures.mutants("SELECT (", next(iter(fixtures.TEMPLATES))))


@pytest.mark.parametrize("day, low, high, want", [("5", "3", "7", "5"), ("1", "3", "7", "3"), ("9", "3", "7", "3"), ("9", None, "7", "7"), ("1", "3", None, "3"), ("5", "7", "3", "3"), ("5", None, None, "5")])
def test_days_inside_bounds(spark, day, low, high, want):
    assert fixtures.clamped(day, low, high) == want
    frame = spark.createDataFrame([(day, low, high)], "d string, l string, h string")
    assert frame.select(fixtures.clamped_day(F.col("d"), F.col("l"), F.col("h"))).first()[0] == want


def test_days_of_expressions():
    assert fixtures.resolved_day("date('now', '-1 month')", "1998-03-31") == "1998-03-03" and fixtures.resolved_day("'1998-01-02'", "1998-03-31") == "1998-01-02" and fixtures.resolved_day("x", "1998-03-31") is None


def test_fixtures_balance_and_tell_readings_apart(spark):
    needs = fixtures.needs_of(fixtures.evidence_of(f"SELECT SUM(Credit) FROM {T} WHERE Transaction_TYPE = 'invoice'"))
    for entries in fixtures.STATES.values():
        assert fixtures.integrity_faults(fixtures.fixture(spark, needs, entries)) == []
    gold = f"SELECT SUM(Credit) FROM {T} WHERE Transaction_TYPE = 'invoice'"
    same = fixtures.accounting_verdict(spark, gold, f"SELECT SUM(Credit) AS x FROM {T} WHERE lower(Transaction_TYPE) = 'invoice'")
    wrong = fixtures.accounting_verdict(spark, gold, f"SELECT SUM(Credit) FROM {T} WHERE Transaction_TYPE = 'bill'")
    none = fixtures.accounting_verdict(spark, "SELECT (", gold)
    assert same["eq_acct"] == 1 and wrong["eq_acct"] == 0 and wrong["failed"] and none["eq_acct"] is None and none["reasons"] == {"unsupported_sql_feature": 1}


def test_unbalanced_entries_are_found(spark):
    lines = spark.createDataFrame([("1", 5.0, None), ("1", None, 5.0), ("2", 5.0, None), ("3", None, None)], "Transaction_ID string, Debit double, Credit double")
    assert [r[0] for r in fixtures.imbalanced(lines).collect()] == ["2"]
    parents = spark.createDataFrame([("a", 1), (None, 2)], "name string, n int")
    children = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "who string")
    assert {tuple(r)[0] for r in fixtures.orphans(children, "who", parents, "name").collect()} == {"b"} and len(ledger_notes().by_column) > 10 and dt.date.fromisoformat(fixtures.AS_OF)
