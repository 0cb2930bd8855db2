import datetime as dt
import sqlite3

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlens.plans import dialect, execute
from ledgerlens.plans.dialect import DialectError
from ledgerlens.plans.facts import facts_frame, facts_of
from ledgerlens.plans.sql import SqlError, parse, render

QUERIES = [
    "SELECT a - b - c, a - (b - c), -x * 3, NOT a = b, a IS NOT NULL, a NOT IN (1, 2), b NOT LIKE 'x%' ESCAPE '!' FROM t",
    "WITH x AS (SELECT 1 AS a UNION ALL SELECT 2) SELECT COUNT(DISTINCT a), COUNT(*) FROM x, y LEFT OUTER JOIN z USING (k) WHERE EXISTS(SELECT 1 FROM q) LIMIT 10 OFFSET 5",
    "SELECT CASE WHEN a = 1 THEN 'x' ELSE 'y' END, CAST(a AS DECIMAL(10,2)), \"quo ted\", x.\"B\" FROM (SELECT * FROM t) AS s WHERE (a OR b) AND c",
    "SELECT CASE a WHEN 1 THEN 2 END FROM t WHERE a IN (SELECT b FROM c) AND a BETWEEN 1 AND 2 AND b NOT BETWEEN 3 AND 4 GROUP BY a, b HAVING SUM(x) > 5 ORDER BY a DESC NULLS LAST",
]


@pytest.mark.parametrize("sql", QUERIES)
def test_written_text_reads_as_it_was(sql):
    assert render(parse(sql)) == sql


@pytest.mark.parametrize("sql", ["SELEC 1", "SELECT", "SELECT a FROM", "SELECT SUM(Amount FROM ledger", "SELECT a,, b FROM t", "", None, "SELECT 1 2 3", "UPDATE t SET a=1", "SELECT CAST(a AS", "(" * 500])
def test_other_texts_are_errors(sql):
    with pytest.raises(SqlError):
        parse(sql)
    assert facts_of(sql)["error"]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="selctfromwhandr ()*,.=<>'\"1ab;-", max_size=60))
def test_any_text_is_read_or_refused(text):
    facts = facts_of("SELECT " + text)
    assert facts["error"] is not None or facts["outputs"]


_EXPRESSION = st.recursive(
    st.sampled_from(["1", "2.5", "n", "x", "'a'", "t", "NULL", "0"]),
    lambda inner: st.one_of(
        st.tuples(inner, st.sampled_from(["+", "-", "*", "/", "%", "=", "<>", "<", ">=", "AND", "OR", "||"]), inner).map(lambda p: f"{p[0]} {p[1]} {p[2]}"),
        inner.map(lambda e: f"({e})"), inner.map(lambda e: f"NOT ({e})"), inner.map(lambda e: f"({e}) IS NULL"), st.tuples(inner, inner).map(lambda p: f"CASE WHEN {p[0]} THEN {p[1]} ELSE 7 END"),
        st.tuples(inner, inner).map(lambda p: f"COALESCE({p[0]}, {p[1]})"),
    ),
    max_leaves=6,
)


@settings(max_examples=200, deadline=None)
@given(_EXPRESSION)
def test_rendering_keeps_the_value(expression):
    """SQLite gives the same for a query and for its text read and written again."""
    db = sqlite3.connect(":memory:")
    db.execute("CREATE TABLE u (n INTEGER, x REAL, t TEXT)")
    db.executemany("INSERT INTO u VALUES (?, ?, ?)", [(1, 2.5, "a"), (0, None, "b"), (None, -1.0, None)])
    sql = f"SELECT {expression} FROM u"
    assert db.execute(sql).fetchall() == db.execute(render(parse(sql))).fetchall()


def test_facts():
    f = facts_of("SELECT SUM(t.Credit) AS s, Account FROM ledger t JOIN chart c ON t.Account = c.name WHERE a <> 1 AND d BETWEEN '1' AND '2' AND b IN ('x', 'y') AND e IS NOT NULL GROUP BY Account HAVING SUM(Credit) > 5 ORDER BY s DESC LIMIT 3")
    assert f["tables"] == ["ledger", "chart"] and f["aliases"] == {"t": "ledger", "c": "chart"}
    assert [a["expression"] for a in f["aggregations"]] == ["SUM(t.Credit)", "SUM(Credit)"]
    assert [(x["operator"], x["column_values"], x["negated"]) for x in f["filters"]] == [("!=", ["1"], False), ("IN", ["x", "y"], False), ("BETWEEN", ["1", "2"], False), ("IS", [None], True)]
    assert f["order_by"] == ["s DESC"] and f["row_limit"] == 3 and f["joins"] == [{"table": "chart", "on_expression": "t.Account = c.name"}]
    assert f["selected"] == [{"column": "Credit", "table": "ledger"}, {"column": "Account", "table": None}] and f["output_names"] == ["s"]
    assert f["clauses"]["HAVING"] == "SUM(Credit) > 5" and f["clauses"]["JOIN"] == "JOIN chart AS c ON t.Account = c.name"


@pytest.mark.parametrize("sql, tables, nested", [
    ("WITH c AS (SELECT a FROM t) SELECT a FROM c", ["c", "t"], True), ("SELECT a FROM t WHERE b IN (SELECT c FROM u)", ["t", "u"], True), ("SELECT a FROM t WHERE EXISTS (SELECT 1 FROM u)", ["t", "u"], False),
    ("SELECT a FROM t UNION SELECT b FROM u", ["t", "u"], True), ("SELECT a FROM (SELECT 1 AS a) s", [], True), ("SELECT a FROM t, u JOIN v ON u.x = v.x", ["t", "u", "v"], False),
])
def test_tables_of_nested_queries(sql, tables, nested):
    f = facts_of(sql)
    assert sorted(f["tables"]) == sorted(tables) and f["unsupported_lineage"] == nested


@pytest.mark.parametrize("sql, terms", [
    ("SELECT SUM(a) - SUM(b) FROM t", [("sum", "a", 1), ("sum", "b", -1)]), ("SELECT -(a - b) + 3 FROM t", [(None, "a", -1), (None, "b", 1)]), ("SELECT SUM(q * r) FROM t", [("sum", "q", 1)]),
    ("SELECT CAST(AVG(a) AS REAL) FROM t", [("average", "a", 1)]), ("SELECT a * b FROM t", None), ("SELECT COUNT(*) FROM t", []),
])
def test_terms(sql, terms):
    output = facts_of(sql)["outputs"][0]
    assert output["supported"] == (terms is not None) and [(t["function"], t["column"], t["sign"]) for t in output["terms"]] == (terms or [])


def test_facts_frame(spark):
    frame = spark.createDataFrame([(1, "SELECT a FROM t"), (2, "SELECT a FROM t"), (3, None), (4, "no")], "id int, sql string")
    got = {r.id: r for r in facts_frame(frame, "sql").collect()}
    assert got[1].tables == got[2].tables == ["t"] and got[3].tables is None and got[4].error
    assert facts_frame(frame.limit(0), "sql").collect() == []


@pytest.mark.parametrize("arguments, day", [(["'now'"], "2026-06-24"), (["'2024-01-31'", "'+1 month'"], "2024-03-02"), (["'now'", "'weekday 0'", "'-6 days'"], "2026-06-22"), (["'now'", "'start of year'", "'-1 year'"], "2025-01-01")])
def test_dates_fold_as_sqlite_does(arguments, day):
    assert dialect.fold_date(arguments, "2026-06-24") == day
    if "now" not in arguments[0]:
        assert sqlite3.connect(":memory:").execute(f"SELECT date({', '.join(arguments)})").fetchone()[0] == day


@pytest.mark.parametrize("sql", ["SELECT EXTRACT(year FROM d) FROM t", "SELECT a FROM t WHERE b ILIKE 'x'", "SELECT DATE_TRUNC('month', d) FROM t", "SELECT d - INTERVAL '1 day' FROM t", "SELECT BOOL_OR(a) FROM t", "SELECT strftime('%Q', '2024-01-01')"])
def test_foreign_constructs(sql):
    with pytest.raises(DialectError):
        dialect.to_spark(sql, "2024-01-31")


ROWS = [(1, "Cash", "bill", 10.5, 3, "2024-01-31", "paid"), (2, "Bank", "invoice", 20.0, 2, "2024-02-29", "--"), (3, "cash", "bill", -5.25, None, "2023-12-31", None), (4, "Rent 50%", "deposit", None, 7, "2024-02-01", "paid"), (5, None, "invoice", 20.0, 2, None, "--")]
# each runs in SQLite and in Spark on the same rows
SAME = [
    "SELECT 3 / 2, 7 % 4, 3 / 2.0, 5 / 0, 5 % 0", "SELECT n / 2, x / 2 FROM l ORDER BY id", "SELECT COUNT(*) / 2, SUM(n) / COUNT(n), AVG(n) FROM l", "SELECT id FROM l WHERE instr(lower(acc), 'a')", "SELECT id FROM l WHERE n - 2",
    "SELECT id FROM l WHERE acc LIKE 'CASH'", "SELECT id FROM l WHERE acc LIKE '%0\\%%' ESCAPE '\\'", "SELECT id FROM l WHERE acc GLOB 'C*'", "SELECT SUM(kind = 'bill'), SUM(paid IS NULL) FROM l", "SELECT kind = 'bill', NOT n FROM l ORDER BY id",
    "SELECT date(d, '+1 month') FROM l ORDER BY id", "SELECT date(d, 'start of month', '-1 day'), date(d, '+1 year') FROM l ORDER BY id", "SELECT date(d, 'weekday 1'), strftime('%w', d), strftime('%j', d) FROM l ORDER BY id",
    "SELECT strftime('%Y-%m', d), COUNT(*) FROM l GROUP BY strftime('%Y-%m', d)", "SELECT strftime('%Y', date('2024-01-31', '-1 month'))", "SELECT id FROM l WHERE d BETWEEN '2024-01-01' AND date('2024-02-15')", "SELECT julianday('2024-03-01') - julianday(d) FROM l ORDER BY id",
    "SELECT kind, MAX(x), id FROM l WHERE x IS NOT NULL GROUP BY kind HAVING COUNT(*) > 0 ORDER BY kind", "SELECT acc, MIN(x) FROM l", "SELECT kind, COUNT(*) AS c FROM l GROUP BY 1 ORDER BY c DESC, 1 LIMIT 1",
    "SELECT COALESCE(x, 0), IFNULL(n, -1), ROUND(x / 3, 2), ABS(x) FROM l ORDER BY id", "SELECT total(x), total(n) FROM l WHERE id > 100", "SELECT CAST('12' AS INTEGER) + 1, CAST(3.7 AS INTEGER), CAST(5 AS TEXT) || 'x'",
    "SELECT MIN(1, 2), MAX(3, NULL), MAX(2, 5)", "SELECT CASE WHEN n THEN 'y' ELSE 'n' END, iif(n > 2, 1, 0) FROM l ORDER BY id", "SELECT id FROM l WHERE n IN (SELECT 2 UNION SELECT 3)", "SELECT EXISTS (SELECT 1 FROM l WHERE n = 7)",
    "SELECT a.id, b.id FROM l a JOIN l b ON a.n = b.n AND a.id < b.id", "SELECT a.id, b.n FROM l a LEFT JOIN l b ON a.id = b.id + 1 ORDER BY a.id", "SELECT DISTINCT kind FROM l", "SELECT kind FROM l UNION SELECT paid FROM l", "SELECT kind FROM l EXCEPT SELECT 'bill'",
    "SELECT id FROM l WHERE paid IS 'paid'", "SELECT id FROM l WHERE paid IS NOT 'paid'", "SELECT id FROM l WHERE n NOT IN (2) OR paid NOT LIKE 'P%'", "SELECT COUNT(*) FROM l WHERE kind == 'bill' AND x <> 3", "SELECT id FROM l ORDER BY x DESC, id LIMIT 2 OFFSET 1",
    "SELECT kind, SUM(CASE WHEN paid = 'paid' THEN x ELSE 0 END) FROM l GROUP BY kind", "SELECT COUNT(DISTINCT kind), COUNT(x) FROM l", "SELECT length(acc), upper(acc), substr(acc, 2, 2), trim('  a ') FROM l ORDER BY id", "WITH w AS (SELECT kind, SUM(x) AS s FROM l GROUP BY kind) SELECT kind FROM w WHERE s > 5 ORDER BY 1",
    "SELECT 1 WHERE 0", "SELECT NULL", "SELECT -id, +x, -(-id) FROM l ORDER BY id", "SELECT (SELECT MAX(x) FROM l) - x FROM l ORDER BY id", "SELECT kind || '-' || id FROM l ORDER BY id", "SELECT AVG(x) FILTER (WHERE kind = 'bill') FROM l", "SELECT x > 10 AND n FROM l ORDER BY id",
    "SELECT strftime('%d/%m', '2024-03-05')", "SELECT date('2024-01-31', '+1 month', 'start of month')", "SELECT id FROM l WHERE acc = \"Cash\"", "SELECT ROW_NUMBER() OVER (ORDER BY id DESC) FROM l ORDER BY id", "SELECT 10 - 4 - 3, 2 * 3 % 4, 1 || 2 + 3",
]


@pytest.fixture(scope="module")
def both(spark):
    db = sqlite3.connect(":memory:")
    db.execute("CREATE TABLE l (id INTEGER, acc TEXT, kind TEXT, x REAL, n INTEGER, d DATE, paid TEXT)")
    db.executemany("INSERT INTO l VALUES (?, ?, ?, ?, ?, ?, ?)", ROWS)
    day = lambda s: s and dt.date.fromisoformat(s)
    frame = spark.createDataFrame([(*r[:5], day(r[5]), r[6]) for r in ROWS], "id long, acc string, kind string, x double, n long, d date, paid string")
    engine = execute.Engine(spark, {"l": frame}, "2024-06-24")
    yield db, engine
    engine.close()


@pytest.mark.parametrize("sql", SAME)
def test_spark_answers_as_sqlite_does(both, sql):
    db, engine = both
    want = [[execute.plain_cell(v) for v in r] for r in db.execute(sql).fetchall()]
    frame, error = engine.query(sql)
    assert error is None, error
    got = [[execute.plain_cell(v) for v in r] for r in frame.collect()]
    key = lambda rows: rows if execute.ordered(sql) else sorted(rows, key=repr)
    assert key(got) == key(want)
