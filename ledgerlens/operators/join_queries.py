"""Registered queries of joins beyond equality, levels of grouping, sketches and orders, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.operators.joins import as_of, within
from ledgerlens.operators.permute import permuted
from ledgerlens.operators.queries import ev_sql, query
from ledgerlens.operators.reports import flag_histogram, levels, merged_sketches, sketches
from ledgerlens.sources.ledger import LED_SQL, evaluation_records, ledger_lines, table
from ledgerlens.sources.scratch import written


@query("account_type_probe", f"""WITH {LED_SQL} SELECT Transaction_TYPE, count(*) AS n, round(sum(Amount), 2) AS total FROM led LEFT JOIN (SELECT p_type, CASE WHEN max(p_retailprice) > 1000 THEN 'dear' ELSE 'cheap' END || length(p_type) AS t FROM part WHERE p_type <> 'STANDARD' GROUP BY 1) ON p_type = Account
  WHERE t IN ('dear5', 'cheap5', 'dear7', 'cheap7') AND contains(lower(Account), 'o') AND Transaction_TYPE IN ('bill', 'invoice') GROUP BY 1""")
def account_type_probe(spark, d):
    """Lines whose account is of a type, by the chart of accounts: here a part type, by its dearest part and its name; one type is not in the chart."""
    from ledgerlens.plans.fixtures import supported_rows

    kind = F.concat(F.when(F.max("p_retailprice") > 1000, "Dear").otherwise("Cheap"), F.length("Account_name").cast("string"))
    chart = table(spark, d, "part").where("p_type <> 'STANDARD'").withColumnRenamed("p_type", "Account_name").groupBy("Account_name").agg(kind.alias("Account_type"))
    needs = {"literals": {"account_type": ["Dear5", "Cheap5", "Dear7", "Cheap7"], "transaction_type": ["bill", "invoice"]}, "substrings": ["O"]}
    return supported_rows(ledger_lines(spark, d), needs, accounts=chart).groupBy("Transaction_TYPE").agg(F.count("*").alias("n"), F.round(F.sum("Amount"), 2).alias("total"))


@query("last_signup_before", """SELECT e.event_id, s.event_id AS signup_id, s.value AS signup_value FROM (SELECT * FROM events WHERE event_type = 'purchase') e
  ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'signup') s ON e.user_id = s.user_id AND e.ts >= s.ts""")
def last_signup_before(spark, d):
    events = table(spark, d, "events")
    left = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = events.where("event_type = 'signup'").select("user_id", "ts", F.col("event_id").alias("signup_id"), F.col("value").alias("signup_value"))
    return as_of(left, right, ["user_id"], "ts", ["signup_id", "signup_value"], F.to_date("ts")).select("event_id", "signup_id", "signup_value")


@query("orders_soon_after", """SELECT a.o_orderkey AS first_order, b.o_orderkey AS next_order FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey <> b.o_orderkey
  AND CAST(b.o_orderdate AS DATE) BETWEEN CAST(a.o_orderdate AS DATE) AND CAST(a.o_orderdate AS DATE) + 30""")
def orders_soon_after(spark, d):
    """Orders of a customer within thirty days of another one: days in ranges."""
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    ranges = orders.select("o_custkey", F.col("o_orderkey").alias("first_order"), F.col("day").alias("begin"), F.date_add("day", 30).alias("end"))
    points = orders.withColumnRenamed("o_orderkey", "next_order")
    return within(points, ranges, ["o_custkey"], "day", "begin", "end", 31).where("first_order <> next_order").select("first_order", "next_order")


@query("result_levels", ev_sql("""SELECT CAST(CASE grouping(mode) * 4 + grouping(before_group) * 2 + grouping(inv) WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 3 THEN 2 ELSE 3 END AS INT) AS level, mode, before_group, inv, count(*) AS n, count(DISTINCT probes_used) AS probes, round(sum(seconds), 2) AS seconds
  FROM ev GROUP BY GROUPING SETS ((mode, before_group, inv), (mode, before_group), (mode), ())"""))
def result_levels(spark, d):
    sets = [["mode", "before_group", "inv"], ["mode", "before_group"], ["mode"], []]
    return levels(evaluation_records(spark, d), sets, {"n": F.count("*"), "probes": F.count_distinct("probes_used"), "seconds": F.round(F.sum("seconds"), 2)})


@query("run_sketches", ev_sql("SELECT mode, count(*) AS n, true AS distinct_fits, true AS median_fits FROM ev GROUP BY 1"))
def run_sketches(spark, d):
    """Sketches of eight runs, stored and merged: distinct counts within 3 % and medians within 2 % of rank of the exact figures."""
    rows = evaluation_records(spark, d).withColumn("run", F.col("idx") % 8)
    stored = written(sketches(rows, ["run", "mode"], "question_id", "seconds"), "sketches")
    found = merged_sketches(stored, ["mode"])
    exact = rows.join(F.broadcast(found.select("mode", "p50")), "mode").groupBy("mode").agg(F.count_distinct("question_id").alias("d"), F.avg(F.when(F.col("seconds") <= F.col("p50"), 1.0).otherwise(0.0)).alias("rank"))
    out = found.join(exact, "mode")
    return out.select("mode", "n", (F.abs(F.col("distinct") / F.col("d") - 1) <= 0.03).alias("distinct_fits"), (F.abs(F.col("rank") - 0.5) <= 0.02).alias("median_fits"))


@query("seeded_order", "SELECT count(*) AS n, sum(o_orderkey) AS keys, true AS moved FROM orders")
def seeded_order(spark, d):
    """A seeded order of all orders holds every order once, and few stay where they were."""
    from ledgerlens.operators.dataflow import numbered

    keys = table(spark, d, "orders").select("o_orderkey")
    placed = numbered(permuted(keys, "o_orderkey", 7), "at").join(numbered(keys.orderBy("o_orderkey"), "was"), "o_orderkey")
    return placed.agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"), (F.count_if(F.col("at") == F.col("was")) < 0.01 * F.count("*") + 5).alias("moved"))


@query("profile_flags", ev_sql("""SELECT what, value, count(*) AS n FROM (
  SELECT 'rows' AS what, '' AS value FROM ev UNION ALL SELECT 'status', mode FROM ev UNION ALL SELECT 'layer', CAST(inv AS VARCHAR) FROM ev WHERE inv IS NOT NULL
  UNION ALL SELECT 'flag', 'unobserved_literal' FROM ev WHERE idx % 3 = 0 UNION ALL SELECT 'flag', 'missing_literal' FROM ev WHERE idx % 4 = 1 UNION ALL SELECT 'flag', 'ambiguous_resolution' FROM ev WHERE idx % 4 = 1
  UNION ALL SELECT 'flag', 'requires_account_context' FROM ev WHERE idx % 5 = 2 UNION ALL SELECT 'flag', 'transaction_line_grain' FROM ev WHERE idx % 5 = 2) GROUP BY 1, 2"""))
def profile_flags(spark, d):
    key = F.col("idx")
    flag = lambda test, text: F.when(test, F.concat(F.lit(text), key))
    flags = F.array_compact(F.array(flag(key % 3 == 0, "Unobserved_Literal in row "), flag(key % 4 == 1, "AMBIGUOUS: missing_marker "), flag(key % 5 == 2, "requires account of transaction lines "), flag(key % 7 == 0, "fine ")))
    rows = evaluation_records(spark, d).select("mode", "inv", flags.alias("flags"))
    return flag_histogram(rows, "flags", {"status": "mode", "layer": "inv"})
