"""Registered queries over texts that are put together from table values: what is read out of a text is held against the values that went in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.queries import query
from ledgerlens.plans import facts, gates
from ledgerlens.sources.ledger import dealt, table

_MEASURES, _CALLS, _TYPES, _GROUPS = ("Amount", "Credit", "Debit", "Quantity"), ("SUM", "AVG", "MAX"), ("invoice", "bill", "deposit"), ("", "Customers", "Vendor", "Account")

#: The parts of a text about each order, in DuckDB SQL; ``turn`` says which part a second text changes.
_PARTS = """p AS (SELECT o_orderkey AS idx, c_name AS customer, CAST(o_orderdate AS DATE) AS day, ['Amount', 'Credit', 'Debit', 'Quantity'][CAST(o_orderkey % 4 + 1 AS INT)] AS measure,
    CAST((o_orderkey // 7) % 3 AS INT) AS fn, ['invoice', 'bill', 'deposit'][CAST((o_orderkey // 11) % 3 + 1 AS INT)] AS kind, CAST((o_orderkey // 13) % 4 AS INT) AS grp, o_orderkey % 2 = 0 AS by_customer, (o_orderkey // 3) % 2 = 0 AS by_day, (o_orderkey // 5) % 2 = 0 AS by_kind,
    (o_orderkey // 17) % 2 = 0 AS sorted, CASE WHEN (o_orderkey // 19) % 3 = 0 THEN o_orderkey % 50 + 1 END AS most, CAST((o_orderkey // 23) % 5 AS INT) AS turn FROM orders JOIN customer ON o_custkey = c_custkey)"""


def parts(spark, d: str) -> DataFrame:
    key = F.col("idx")
    turn = lambda by, of: F.floor(key / by) % of
    pick = lambda items, k: F.element_at(F.array(*map(F.lit, items)), (k + 1).cast("int"))
    rows = dealt(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.select(F.col("o_orderkey").alias("idx"), F.col("c_name").alias("customer"), F.col("o_orderdate").cast("date").alias("day"))
    return rows.select(
        "*", pick(_MEASURES, key % 4).alias("measure"), turn(7, 3).cast("int").alias("fn"), pick(_TYPES, turn(11, 3)).alias("kind"), turn(13, 4).cast("int").alias("grp"),
        (key % 2 == 0).alias("by_customer"), (turn(3, 2) == 0).alias("by_day"), (turn(5, 2) == 0).alias("by_kind"), (turn(17, 2) == 0).alias("sorted"),
        F.when(turn(19, 3) == 0, key % 50 + 1).alias("most"), turn(23, 5).cast("int").alias("turn"),
    )


def text(fn: Column, day: Column, grp: Column, most: Column) -> Column:
    """A query's text from its parts; the others are columns of ``parts``."""
    c = F.col
    call = F.element_at(F.array(*map(F.lit, _CALLS)), fn + 1)
    group = F.element_at(F.array(*map(F.lit, _GROUPS)), grp + 1)
    tests = F.array_compact(F.array(
        F.when(c("by_customer"), F.format_string("Customers = '%s'", "customer")), F.when(c("by_day"), F.format_string("Transaction_DATE >= '%s'", day.cast("string"))), F.when(c("by_kind"), F.format_string("Transaction_TYPE = '%s'", "kind")),
    ))
    shown = F.concat(F.lit("SELECT "), F.when(group != "", F.concat(group, F.lit(", "))).otherwise(""), call, F.lit("("), c("measure"), F.lit(") AS v FROM master_txn_table"))
    where = F.when(F.size(tests) > 0, F.concat(F.lit(" WHERE "), F.array_join(tests, " AND "))).otherwise("")
    tail = F.concat(F.when(group != "", F.concat(F.lit(" GROUP BY "), group)).otherwise(""), F.when(c("sorted"), " ORDER BY v DESC").otherwise(""), F.coalesce(F.concat(F.lit(" LIMIT "), most.cast("string")), F.lit("")))
    return F.concat(shown, where, tail)


@query("composed_facts", f"""WITH {_PARTS} SELECT idx, [['sum', 'average', 'max'][fn + 1]] AS functions, [measure] AS measures, CASE WHEN grp = 0 THEN [] ELSE [['', 'Customers', 'Vendor', 'Account'][grp + 1]] END AS groups,
  list_filter([CASE WHEN by_customer AND by_kind AND by_day THEN 'Transaction_TYPE = ' || kind END, CASE WHEN by_customer THEN 'Customers = ' || customer END, CASE WHEN by_kind AND NOT (by_customer AND by_day) THEN 'Transaction_TYPE = ' || kind END, CASE WHEN by_day THEN 'Transaction_DATE >= ' || CAST(day AS VARCHAR) END], lambda x: x IS NOT NULL) AS tests,
  CASE WHEN sorted THEN ['v DESC'] ELSE [] END AS order_by, most AS row_limit FROM p""")
def composed_facts(spark, d):
    """Comparisons come by operator, then level by level: of three, the last one stands above the others."""
    rows = parts(spark, d).select("idx", text(F.col("fn"), F.col("day"), F.col("grp"), F.col("most")).alias("sql"))
    f = facts.facts_frame(rows, "sql", ("aggregations", "filters", "group_by", "order_by", "row_limit"))
    tests = F.transform("filters", lambda x: F.concat(F.element_at(x.columns, 1).column, F.lit(" "), x.operator, F.lit(" "), F.element_at(x.column_values, 1)))
    measures = F.flatten(F.transform("aggregations", lambda a: F.transform(a.columns, lambda x: x.column)))
    return f.select("idx", F.transform("aggregations", lambda a: a.func).alias("functions"), measures.alias("measures"), F.transform("group_by", lambda g: g.column).alias("groups"), tests.alias("tests"), "order_by", "row_limit")


@query("composed_changes", f"""WITH {_PARTS} SELECT idx, list_filter([CASE WHEN turn = 1 OR turn = 3 THEN 'SELECT' END, CASE WHEN turn = 2 AND by_day THEN 'WHERE' END, CASE WHEN turn = 3 THEN 'GROUP BY' END, CASE WHEN turn = 4 THEN 'LIMIT' END], lambda x: x IS NOT NULL) AS changed,
  CASE WHEN turn = 2 AND by_day THEN ['transaction_date >= ''' || CAST(day AS VARCHAR) || '''', 'transaction_date >= ''' || CAST(CAST(day + 400 AS DATE) AS VARCHAR) || ''''] ELSE [] END AS predicates FROM p""")
def composed_changes(spark, d):
    c = F.col
    rows = parts(spark, d)
    one = text(c("fn"), c("day"), c("grp"), c("most"))
    two = text(F.when(c("turn") == 1, (c("fn") + 1) % 3).otherwise(c("fn")), F.when(c("turn") == 2, F.date_add("day", 400)).otherwise(c("day")), F.when(c("turn") == 3, (c("grp") + 1) % 4).otherwise(c("grp")), F.when(c("turn") == 4, F.coalesce(c("most"), F.lit(0)) + 1).otherwise(c("most")))
    both = rows.select("idx", one.alias("one"), two.alias("two"))
    for side, name in (("one", "before"), ("two", "after")):
        both = facts.with_facts(both, side, name, ("clauses", "filters"))
    return both.select("idx", gates.changed_clauses(c("before"), c("after")).alias("changed"), gates.changed_predicates(c("before"), c("after")).alias("predicates"))
