import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import joins, permute, reports
from ledgerlens.plans import fixtures


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_even_left_join_equals_a_plain_one(spark, seed):
    rng = random.Random(seed)
    key = lambda: (rng.choice([1, 1, 1, 2, None, rng.randrange(3, 40)]), rng.choice(["a", "a", "b"]))
    left = spark.createDataFrame([(*key(), k) for k in range(400)], "x int, y string, l int").repartition(3)
    right = spark.createDataFrame([(*(key() if seed else (rng.randrange(2, 60), "a")), k) for k in range(200)], "x int, y string, r int").repartition(3)
    want = rows_of(left.join(right, ["x", "y"], "left"))
    for heavy in (5, 20, 10_000):
        assert rows_of(joins.even_left_join(left, right, ["x", "y"], heavy).select("x", "y", "l", "r")) == want
    assert rows_of(joins.even_left_join(left, right.limit(0), ["x", "y"], 5)) == rows_of(left.join(right.limit(0), ["x", "y"], "left"))


def test_ranges_and_last_values(spark):
    rng = random.Random(3)
    points = spark.createDataFrame([(rng.randrange(3), rng.randrange(100), k) for k in range(200)], "k int, at int, p int")
    ranges = spark.createDataFrame([(rng.randrange(3), b := rng.randrange(100), b + rng.randrange(-3, 40), k) for k in range(60)], "k int, b int, e int, r int")
    want = rows_of(points.join(ranges, "k").where("at BETWEEN b AND e").select("p", "r"))
    for width in (1, 7, 1000):
        assert rows_of(joins.within(points, ranges, ["k"], "at", "b", "e", width).select("p", "r")) == want
    values = spark.createDataFrame([(rng.choice([0, 1, None]), rng.randrange(100), k) for k in range(40)], "k int, at int, v int")
    last = {}
    for p in points.collect():
        before = [(r.at, r.v) for r in values.collect() if r.k == p.k and r.at <= p["at"]] if p.p < 60 else []
        last[p.p] = max(before)[1] if before else None
    for width in (5, 1000):
        got = {r.p: r.v for r in joins.as_of(points, values, ["k"], "at", ["v"], F.floor(F.col("at") / width)).collect()}
        assert len(got) == 200 and all(got[p] == last[p] for p in range(60))


@pytest.mark.parametrize("count", [1, 2, 3, 7, 64, 1000, 4097])
def test_permutations_are_one_to_one(count):
    places = np.arange(count)
    one, two = (permute.permutation(places, count, s) for s in (1, 2))
    assert sorted(one.tolist()) == places.tolist() == sorted(two.tolist())
    assert (np.concatenate([permute.permutation(places[k : k + 10], count, 1) for k in range(0, count, 10)]) == one).all()
    assert count < 64 or (one != two).mean() > 0.9 and (one != places).mean() > 0.9


def test_seeded_orders_of_rows(spark):
    frame = spark.range(500)
    one = [r.id for r in permute.permuted(frame.repartition(7), "id", 4).collect()]
    assert sorted(one) == list(range(500)) and one == [r.id for r in permute.permuted(frame, "id", 4).collect()] and one[:20] == [r.id for r in permute.permuted(frame, "id", 4, 20).collect()]
    assert permute.permuted(frame.limit(0), "id", 4).collect() == []


def test_levels_and_group_limits(spark):
    frame = spark.createDataFrame([("a", None, 1), ("a", "x", 2), ("b", "x", 2)], "g string, h string, v int")
    got = rows_of(reports.levels(frame, [["g", "h"], ["g"], []], {"n": F.count("*"), "d": F.count_distinct("v")}))
    assert got == sorted([(0, "a", None, 1, 1), (0, "a", "x", 1, 1), (0, "b", "x", 1, 1), (1, "a", None, 2, 2), (1, "b", None, 1, 1), (2, None, None, 3, 2)], key=repr)
    many = spark.range(1000).select(F.array(F.lit("hot")).alias("codes"), F.lit("s").alias("set"), F.col("id").alias("question_id"))
    found = reports.examples_by_code(many, "codes")
    # tasks send at most ten rows of a code: the limit is below the exchange
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and "Partial" in plan
    assert sorted(r.question_id for r in found.collect()) == list(range(10))


def test_support_looks_types_up_and_names_unknown_columns(spark):
    lines = spark.createDataFrame([(1, "Cash box", 5.0), (1, "Rent", 6.0), (2, "Cash box", 7.0), (1, "Lost", 8.0)], "businessID long, Account string, Amount double")
    chart = spark.createDataFrame([(1, "Cash box", "Bank"), (2, "Cash box", "Other"), (1, "Rent", "Expense"), (1, "Rent", "Expense")], "businessID long, Account_name string, Account_type string")
    probe = lambda literals, **more: sorted(r.Amount for r in fixtures.supported_rows(lines, {"literals": literals, **more}, accounts=chart).collect())
    assert probe({"account_type": ["bank"]}) == [5.0] and probe({"account_type": ["bank", "EXPENSE"]}) == [5.0, 6.0] and probe({}, substrings=["CASH"]) == [5.0, 7.0] and probe({"account_name": ["rent"]}) == [6.0]
    with pytest.raises(ValueError):
        probe({"nothing_known": ["x"]})


def test_strategies_without_a_report_are_left_out(spark):
    sets = "array<struct<label: string, strict_accuracy: double>>"
    rows = [("b", 10, 4, 1, 10, 6, 4, [("before", 0.1), ("after", 0.5)]), ("a", 10, 2, 0, 10, 6, 4, []), ("other", 11, 2, 0, 10, 6, 4, [])]
    frame = spark.createDataFrame(rows, f"system string, comparison_original_total long, effect_corrected long, safety_corrupted long, metric_total long, effect_wrong long, comparison_original_correct long, asa_sets {sets}")
    table = reports.strategy_table(frame, {"a": "First", "gone": "Gone", "b": "Second"})
    assert [(r.strategy, r.label, r.correction_count, r.net_gain_count, r.movement_rows, r.asa_strict_accuracy) for r in table.collect()] == [("a", "First", 2, 2, 10, None), ("b", "Second", 4, 3, 10, 0.5)]
    with pytest.raises(Exception, match="one total"):
        reports.strategy_table(frame, {"a": "First", "other": "Other"}).collect()


def test_lines_are_not_counted_for_few_accounts(spark, monkeypatch):
    """Fitting accounts go to the lines that all else leaves; a chart of many fitting accounts gives the same by a join."""
    lines = spark.createDataFrame([(k, f"a{k % 7}" if k % 5 else None, "bill" if k % 2 else "invoice") for k in range(200)], "Amount long, Account string, Transaction_TYPE string")
    chart = spark.createDataFrame([(f"a{k}", t) for k in range(6) for t in (["Bank", "BANK"] if k % 2 else ["Equity", None])] + [("a0", "Bank"), (None, "Bank")], "Account_name string, Account_type string")
    needs = {"literals": {"account_type": ["bank"], "transaction_type": ["bill"]}}
    want = [k for k in range(200) if k % 2 and k % 5 and k % 7 in (0, 1, 3, 5)]
    found = lambda: sorted(r.Amount for r in fixtures.supported_rows(lines, needs, accounts=chart).collect())
    monkeypatch.setattr(fixtures, "ACCOUNTS_SENT", 3)
    assert found() == want
    monkeypatch.setattr(fixtures, "ACCOUNTS_SENT", 4)
    monkeypatch.setattr(fixtures, "even_left_join", lambda *a: pytest.fail("the lines are counted by account"))
    assert found() == want
