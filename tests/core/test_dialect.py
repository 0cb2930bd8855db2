"""Casts, comparisons and arithmetic of unlike values against SQLite's own answers."""

import random
import sqlite3

import pytest

from ledgerlens.plans import execute

TABLE = [(1, 1.5, "12abc"), (2, -2.0, "7"), (12, 12.0, "12"), (None, 0.0, " 3.5 "), (-4, None, "abc"), (0, 1e3, ""), (5, 5.0, None), (7, 0.5, "-8e1x"), (3, 2.0, "2.0"), (9, 9.25, "1e2")]
VALUES = ["i", "r", "t", "'a'", "'12'", "'12abc'", "' 5 '", "1", "2.5", "'1.5'", "NULL", "CAST(t AS INTEGER)", "CAST(t AS REAL)", "CAST(i AS TEXT)", "lower(t)", "i + 1", "''", "'-3x'"]


@pytest.fixture(scope="module")
def engines(spark):
    own = sqlite3.connect(":memory:")
    own.execute("CREATE TABLE v (k INTEGER, i INTEGER, r REAL, t TEXT)")
    rows = [(k, *r) for k, r in enumerate(TABLE)]
    own.executemany("INSERT INTO v VALUES (?, ?, ?, ?)", rows)
    engine = execute.Engine(spark, {"v": spark.createDataFrame(rows, "k int, i int, r double, t string").coalesce(1)}, "1998-06-24")
    yield own, engine
    engine.close()


def test_values_equal_sqlite(engines):
    own, engine = engines
    rng = random.Random(4)
    tests = [f"{a} {op} {b}" for a in VALUES for b in VALUES for op in rng.sample(("<", "<=", "=", "!=", ">", ">="), 3)]
    tests += [f"{a} {op} {b}" for a in ("i", "t", "'12abc'", "'7'", "2.5", "3", "r") for b in ("t", "'4x'", "2", "i", "'2.5'") for op in ("+", "-", "*", "/", "%")]
    tests += [f"{a} BETWEEN {b} AND {c}" for a in ("i", "t", "'5'", "3") for b, c in (("1", "'9'"), ("'a'", "12"), ("'1'", "'7'"))] + [f"{a} IN (1, '7', 'abc', 2.0)" for a in ("i", "r", "t", "'7'", "1")]
    tests += ["CAST('12abc' AS INTEGER)", "CAST('abc' AS REAL)", "CAST(' -7.9z' AS INTEGER)", "CAST(r AS INTEGER)", "CAST('99999999999999999999' AS INTEGER)", "CAST(t AS NUMERIC)", "CASE WHEN t THEN 1 ELSE 0 END", "CASE WHEN '2x' THEN 1 ELSE 0 END", "NOT t", "abs(t)"]
    wrong = []
    for begin in range(0, len(tests), 120):
        some = tests[begin : begin + 120]
        sql = "SELECT " + ", ".join(f"{t} AS c{k}" for k, t in enumerate(some)) + " FROM v ORDER BY k"
        want = own.execute(sql).fetchall()
        frame, error = engine.query(sql)
        assert error is None, error
        got = frame.collect()
        for k, t in enumerate(some):
            a, b = ([execute.plain_cell(row[k]) for row in rows] for rows in (got, want))
            if a != b:
                wrong.append((t, [(x, y) for x, y in zip(a, b) if x != y]))
    assert not wrong, wrong[:10]


@pytest.mark.parametrize("sql", ["SELECT SUM(t), AVG(t), total(t) FROM v", "SELECT COUNT(*) FROM v WHERE t", "SELECT SUM(i) FROM v WHERE t > 5", "SELECT SUM(i) FROM v WHERE i > '5'", "SELECT COUNT(*) FROM v WHERE i < 'x'", "SELECT MAX(CAST(t AS INTEGER)) FROM v"])
def test_conditions_and_aggregates_equal_sqlite(engines, sql):
    own, engine = engines
    assert [[execute.plain_cell(x) for x in r] for r in engine.query(sql)[0].collect()] == [[execute.plain_cell(x) for x in r] for r in own.execute(sql).fetchall()]
