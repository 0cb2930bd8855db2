"""Registered queries over tables of SQL texts, each with its DuckDB SQL."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ledgerlens.functions import scalars as S
from ledgerlens.operators import reports
from ledgerlens.operators.queries import AS_OF, n_if, query
from ledgerlens.plans import contradict, execute, facts, fixtures, gates, layers, notes, profile, repair, states, verify
from ledgerlens.sources.ledger import LED_SQL, dealt, ledger_lines, table


def values(rows: list[tuple], names: str) -> str:
    """Rows as a table of DuckDB SQL."""
    def cell(v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, (list, tuple)):
            return "[" + ", ".join(map(cell, v)) + "]"
        return str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"

    return f"(VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) v({names})"


def orders(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("idx"), F.col("o_custkey").alias("cust"))


def by_case(*texts: str):
    """One of several texts by the order's number, with ``{k}`` as the number."""
    key = F.col("idx")
    out = None
    for n, t in enumerate(texts):
        parts = [F.lit(p) if i % 2 == 0 else key.cast("string") for i, p in enumerate(t.split("{k}")[:1])]
        for rest in t.split("{k}")[1:]:
            parts += [key.cast("string"), F.lit(rest)]
        shown = F.concat(*parts)
        out = F.when(key % len(texts) == n, shown) if out is None else out.when(key % len(texts) == n, shown)
    return out


# Facts


@query("query_facts", """SELECT o_orderkey AS idx, CASE o_orderkey % 4 WHEN 0 THEN ['ledger'] WHEN 1 THEN ['ledger', 'customers'] WHEN 2 THEN ['t'] ELSE [] END AS tables,
  CASE o_orderkey % 4 WHEN 0 THEN ['sum'] WHEN 1 THEN ['count'] ELSE [] END AS functions, CASE o_orderkey % 4 WHEN 0 THEN ['=', '>'] ELSE [] END AS operators,
  CASE o_orderkey % 4 WHEN 0 THEN [CAST(o_orderkey AS VARCHAR), '5'] ELSE [] END AS compared, CASE o_orderkey % 4 WHEN 0 THEN ['Customers'] ELSE [] END AS groups,
  CASE o_orderkey % 4 WHEN 0 THEN ['s DESC'] ELSE [] END AS order_by, CASE o_orderkey % 4 WHEN 0 THEN o_orderkey END AS row_limit,
  CASE o_orderkey % 4 WHEN 1 THEN 'ledger.Customers = customers.customer_name' END AS on_expression, o_orderkey % 4 = 2 AS unsupported_lineage, o_orderkey % 4 = 3 AS unreadable FROM orders""")
def query_facts(spark, d):
    texts = by_case(
        "SELECT SUM(l.Credit) AS s FROM ledger l WHERE l.Amount > 5 AND l.Account = '{k}' GROUP BY l.Customers ORDER BY s DESC LIMIT {k}", "SELECT COUNT(*) FROM ledger JOIN customers ON ledger.Customers = customers.customer_name -- {k}",
        "SELECT a FROM (SELECT b AS a FROM t) x", "SELEC {k}",
    )
    only = ("tables", "aggregations", "filters", "group_by", "order_by", "row_limit", "joins", "unsupported_lineage", "error")
    f = facts.facts_frame(dealt(orders(spark, d)).select("idx", texts.alias("sql")), "sql", only)
    pick = lambda c, k: F.transform(c, lambda x: x[k])
    return f.select(
        "idx", "tables", pick("aggregations", "func").alias("functions"), pick("filters", "operator").alias("operators"), F.flatten(pick("filters", "column_values")).alias("compared"), pick("group_by", "column").alias("groups"),
        "order_by", "row_limit", F.get(F.col("joins"), 0)["on_expression"].alias("on_expression"), "unsupported_lineage", F.col("error").isNotNull().alias("unreadable"),
    )


_PARTS = ("date('now','start of year')", "date('now','start of month')", "date('now','weekday 0','-6 days')", "date('now','-12 months')", "date('now','-1 year')", "2024-01-01", "x")
_ENDS = ("date('now')", "current_date", "date('now','start of month','-1 day')", "2024-02-01", "y")
_OPS = ("BETWEEN", ">=", "<", "=", "LIKE")



def _sql_list(items: tuple[str, ...], modulus: str) -> str:
    return "[" + ", ".join("'" + i.replace("'", "''") + "'" for i in items) + f"][CAST({modulus} % {len(items)} + 1 AS INT)]"


@query("period_hints", f"""SELECT idx, CASE op WHEN 'BETWEEN' THEN CASE
    WHEN lo LIKE '%start of year%' AND now THEN 'year_to_date' WHEN lo LIKE '%start of month%' AND now THEN 'month_to_date' WHEN lo LIKE '%weekday%' AND now THEN 'week_to_date'
    WHEN lo LIKE '%-12 month%' AND now THEN 'trailing_12_months' WHEN lo LIKE '%-1 year%' AND now THEN 'trailing_1_year' WHEN contains(lo || ' ' || hi, 'start of year') AND contains(lo || ' ' || hi, 'month') THEN 'relative_month_range'
    WHEN contains(lo || ' ' || hi, 'start of year') THEN 'relative_year_range' WHEN contains(lo || ' ' || hi, 'start of month') THEN 'relative_month_range' WHEN regexp_matches(lo || ' ' || hi, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN 'absolute_date_range' ELSE 'date_range' END
  WHEN '>=' THEN CASE WHEN lo LIKE '%start of year%' THEN 'year_to_date_lower_bound' WHEN lo LIKE '%start of month%' THEN 'month_to_date_lower_bound' WHEN lo LIKE '%weekday%' THEN 'week_to_date_lower_bound' WHEN lo LIKE '%-12 month%' THEN 'trailing_12_months_lower_bound'
    WHEN lo LIKE '%-1 year%' THEN 'trailing_1_year_lower_bound' WHEN lo = '2024-01-01' THEN 'absolute_date_lower_bound' ELSE 'date_lower_bound' END
  WHEN '<' THEN CASE WHEN lo = '2024-01-01' THEN 'absolute_date_upper_bound' ELSE 'date_upper_bound' END WHEN '=' THEN CASE WHEN lo = '2024-01-01' THEN 'absolute_date_match' ELSE 'date_match' END ELSE 'temporal_filter' END AS hint
  FROM (SELECT *, hi IN ('date(''now'')', 'current_date') AS now FROM (SELECT o_orderkey AS idx, {_sql_list(_OPS, 'o_orderkey')} AS op, {_sql_list(_PARTS, 'o_orderkey')} AS lo, CASE WHEN o_orderkey % 5 = 0 THEN {_sql_list(_ENDS, '(o_orderkey // 5)')} ELSE '' END AS hi FROM orders))""")
def period_hints(spark, d):
    key = F.col("idx")
    pick = lambda items, k: F.element_at(F.array(*map(F.lit, items)), (k % len(items) + 1).cast("int"))
    op = pick(_OPS, key)
    high = F.when(op == "BETWEEN", pick(_ENDS, F.floor(key / 5)))
    return orders(spark, d).select("idx", S.period_hint(op, pick(_PARTS, key), high, F.lit("")).alias("hint"))


# Annotations

_NOTES = notes.ledger_notes()
_FLAT = [(n.table, n.column, n.get("semantic_role")) for own in _NOTES.by_column.values() for n in own]
_ASKED = ("Balance", " amount", "Product_Service", "AR_paid", "nothing", "customer_name")


@query("annotation_lookup", f"""SELECT idx, note_table, note_column, semantic_role, CASE WHEN n = 0 THEN 'unresolved' WHEN tab IS NOT NULL THEN 'qualified' WHEN n > 1 THEN 'ambiguous_unqualified' ELSE 'unique_unqualified' END AS resolution FROM (
  SELECT idx, tab, v.t AS note_table, v.c AS note_column, v.r AS semantic_role, count(v.t) OVER (PARTITION BY idx) AS n FROM (
    SELECT o_orderkey AS idx, {_sql_list(_ASKED, 'o_orderkey')} AS col, CASE o_orderkey % 5 WHEN 0 THEN 'CUSTOMERS' WHEN 1 THEN 'vendors' END AS tab, CASE o_orderkey % 5 WHEN 2 THEN ['customers', 'products', 'master_txn_table'] ELSE [] END AS cand FROM orders) q
  LEFT JOIN {values(_FLAT, 't, c, r')} ON lower(trim(q.col)) = lower(v.c) AND (CASE WHEN tab IS NOT NULL THEN lower(tab) = lower(v.t) WHEN len(cand) > 0 THEN list_contains(cand, lower(v.t)) ELSE true END))""")
def annotation_lookup(spark, d):
    key = F.col("idx")
    refs = orders(spark, d).select(
        "idx", F.element_at(F.array(*map(F.lit, _ASKED)), (key % len(_ASKED) + 1).cast("int")).alias("column"), F.when(key % 5 == 0, "CUSTOMERS").when(key % 5 == 1, "vendors").alias("table"),
        F.when(key % 5 == 2, F.array(*map(F.lit, ("customers", "products", "master_txn_table")))).otherwise(F.array().cast("array<string>")).alias("candidates"),
    )
    return notes.look_up_columns(refs, _NOTES).select("idx", "note_table", "note_column", "semantic_role", "resolution")


_TRIED = ("Income", "'income'", "Equity", "paid", "--", "BILL", "refund", None)
_COLUMNS = (("chart_of_accounts", "Account_type"), ("master_txn_table", "AR_paid"), ("master_txn_table", "Transaction_TYPE"), ("customers", "Balance"))


@query("value_resolution", f"""SELECT idx, status, concept FROM (SELECT o_orderkey AS idx, o_orderkey % 8 AS v, (o_orderkey // 8) % 4 AS c FROM orders) JOIN {values([
    (0, 0, 'exact_match', 'income'), (0, 1, 'normalised_match', 'income'), (0, 2, 'unmapped_literal', None), (0, 3, 'unmapped_literal', None), (0, 4, 'unmapped_literal', None), (0, 5, 'unmapped_literal', None), (0, 6, 'unmapped_literal', None), (0, 7, 'missing_marker', 'missing'),
    (1, 0, 'unmapped_literal', None), (1, 1, 'unmapped_literal', None), (1, 2, 'unmapped_literal', None), (1, 3, 'exact_match', 'paid'), (1, 4, 'missing_marker', 'no settlement recorded'), (1, 5, 'unmapped_literal', None), (1, 6, 'unmapped_literal', None), (1, 7, 'missing_marker', 'no settlement recorded'),
    (2, 0, 'unobserved_literal', None), (2, 1, 'unobserved_literal', None), (2, 2, 'unobserved_literal', None), (2, 3, 'unobserved_literal', None), (2, 4, 'unobserved_literal', None), (2, 5, 'normalised_match', 'bill'), (2, 6, 'unobserved_literal', None), (2, 7, 'missing_marker', 'missing'),
    (3, 0, 'no_value_map', None), (3, 1, 'no_value_map', None), (3, 2, 'no_value_map', None), (3, 3, 'no_value_map', None), (3, 4, 'no_value_map', None), (3, 5, 'no_value_map', None), (3, 6, 'no_value_map', None), (3, 7, 'missing_marker', 'missing')], 'cc, vv, status, concept')} ON c = cc AND v = vv""")
def value_resolution(spark, d):
    key = F.col("idx")
    column = F.floor(key / 8) % 4
    tried = F.when(key % 8 < 7, F.element_at(F.array(*[F.lit(v) for v in _TRIED[:7]]), (key % 8 + 1).cast("int")))
    pick = lambda n: F.element_at(F.array(*[F.lit(c[n]) for c in _COLUMNS]), (column + 1).cast("int"))
    asked = orders(spark, d).select("idx", pick(0).alias("table"), pick(1).alias("column"), F.when(key % 8 < 7, tried).alias("value"))
    return notes.resolve_values(asked, _NOTES).select("idx", "status", "concept")


# Profiles


@query("semantic_profiles", """SELECT o_orderkey AS idx, CASE o_orderkey % 6 WHEN 5 THEN 'PARSE_ERROR' WHEN 4 THEN 'UNSUPPORTED_LINEAGE' ELSE 'OK' END AS profile_status,
  CASE o_orderkey % 6 WHEN 0 THEN 'customer_level' WHEN 1 THEN 'global_summary' WHEN 2 THEN 'raw_rows' WHEN 3 THEN 'temporal_period_by_vendor' WHEN 4 THEN 'raw_rows' END AS grain,
  CASE o_orderkey % 6 WHEN 0 THEN ['SUM'] WHEN 1 THEN ['COUNT'] WHEN 3 THEN ['AVERAGE'] ELSE [] END AS functions, CASE o_orderkey % 6 WHEN 0 THEN ['flow'] WHEN 2 THEN ['stock'] WHEN 3 THEN ['flow'] ELSE [] END AS measure_types,
  CASE o_orderkey % 6 WHEN 0 THEN ['transaction_type'] WHEN 1 THEN ['payment_status'] ELSE [] END AS scope_roles, CASE o_orderkey % 6 WHEN 0 THEN ['invoice'] WHEN 1 THEN ['no settlement recorded'] ELSE [] END AS scope_concepts,
  CASE o_orderkey % 6 WHEN 0 THEN ['year_to_date_lower_bound'] ELSE [] END AS periods, CASE o_orderkey % 6 WHEN 5 THEN NULL WHEN 0 THEN 'present' ELSE 'missing' END AS type_filter, CASE o_orderkey % 6 WHEN 5 THEN NULL WHEN 0 THEN 'present' WHEN 3 THEN 'present' ELSE 'none' END AS grouping,
  CASE o_orderkey % 6 WHEN 5 THEN NULL WHEN 1 THEN 'present' ELSE 'none' END AS ordering FROM orders""")
def semantic_profiles(spark, d):
    texts = by_case(
        "SELECT Customers, SUM(Credit) FROM master_txn_table WHERE Transaction_TYPE = 'Invoice' AND Transaction_DATE >= date('now', 'start of year') GROUP BY Customers", "SELECT COUNT(*) AS n FROM master_txn_table WHERE AR_paid = '--' ORDER BY n",
        "SELECT Balance FROM customers", "SELECT AVG(Amount) FROM master_txn_table GROUP BY Transaction_DATE, Vendor", "SELECT a FROM (SELECT Account AS a FROM master_txn_table) s", "SELEC {k}",
    )
    p = profile.with_profiles(dealt(orders(spark, d)).select("idx", texts.alias("sql")), "sql", _NOTES)
    return p.select("idx", "profile_status", "grain", "functions", "measure_types", "scope_roles", "scope_concepts", "periods", F.col("absence")["transaction_type_filter"].alias("type_filter"), F.col("absence")["grouping"].alias("grouping"), F.col("absence")["ordering"].alias("ordering"))


# Contradictions

_MADE = ("SELECT SUM(Credit) FROM master_txn_table", "SELECT SUM(Debit) FROM master_txn_table", "SELECT AVG(Rate) FROM master_txn_table", "SELECT COUNT(*) FROM master_txn_table", "SELECT AVG(Credit) FROM master_txn_table", "SELECT SUM(Credit) FROM", "SELECT SUM(Credit) FROM master_txn_table WHERE Transaction_TYPE = 'bill'")
_JUDGED = [
    (0, contradict.NONE, [], []), (1, contradict.HARD, ["posting_side_reversal"], []), (2, contradict.HARD, ["rate_as_total_amount_substitution"], []), (3, contradict.NONE, [], ["aggregation_or_grain_error"]), (4, contradict.NONE, [], ["aggregation_or_grain_error"]),
    (5, contradict.UNKNOWN, ["parse_failure"], []), (6, contradict.NONE, [], ["financial_scope_warning"]),
]


@query("contradiction_pairs", f"SELECT o_orderkey AS idx, status, codes, warnings FROM orders JOIN {values([(n, s, c or ['-'], w or ['-']) for n, s, c, w in _JUDGED], 'm, status, codes0, warnings0')} ON o_orderkey % 7 = m, LATERAL (SELECT list_filter(codes0, lambda x: x <> '-') AS codes, list_filter(warnings0, lambda x: x <> '-') AS warnings)")
def contradiction_pairs(spark, d):
    pairs = orders(spark, d).select("idx", F.lit(_MADE[0]).alias("gold_sql"), by_case(*_MADE).alias("generated_sql"))
    return contradict.with_contradictions(pairs, _NOTES).select("idx", "status", "codes", "warnings")


@query("contradiction_histogram", f"SELECT code, CAST(count(*) AS BIGINT) AS n FROM orders JOIN {values([(1, 'posting_side_reversal'), (2, 'rate_as_total_amount_substitution'), (5, 'parse_failure')], 'm, code')} ON o_orderkey % 7 = m GROUP BY 1")
def contradiction_histogram(spark, d):
    return contradiction_pairs(spark, d).select(F.explode("codes").alias("code")).groupBy("code").agg(F.count("*").alias("n"))


def judged_pairs(spark, d):
    key = F.col("idx")
    return contradiction_pairs(spark, d).withColumns({"execution_match": F.when(key % 3 < 2, key % 3 == 0), "excluded_from_primary_metrics": F.when(key % 5 < 3, key % 5 == 0)})


_JUDGED_SQL = """FROM (SELECT CASE WHEN o_orderkey % 7 IN (1, 2) THEN 'hard' WHEN o_orderkey % 7 = 5 THEN 'unknown' ELSE 'none' END AS s, CASE o_orderkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS m,
  o_orderkey % 5 = 0 AS x, o_orderkey % 7 AS k FROM orders)"""


@query("contradiction_report", "SELECT *, hard / greatest(evaluable, 1) AS hard_rate, none / greatest(evaluable, 1) AS none_rate, not_evaluable / greatest(total, 1) AS not_evaluable_rate, measured_pass / greatest(measured, 1) AS execution_accuracy FROM (SELECT " + ", ".join(
    f"{n_if(t)} AS {n}" for n, t in {"total": "true", "evaluable": "s <> 'unknown'", "hard": "s = 'hard'", "none": "s = 'none'", "not_evaluable": "s = 'unknown'", "hard_pass": "s = 'hard' AND m", "hard_fail": "s = 'hard' AND NOT m", "none_pass": "s = 'none' AND m",
    "none_fail": "s = 'none' AND NOT m", "without_match": "s <> 'unknown' AND m IS NULL", "measured": "m IS NOT NULL AND NOT x", "measured_pass": "m AND NOT x"}.items()) + f" {_JUDGED_SQL})")
def contradiction_report(spark, d):
    return reports.contradiction_report(judged_pairs(spark, d))


@query("warning_rates", f"SELECT code, n, n / greatest(e, 1) AS rate FROM (SELECT {n_if('k <> 5')} AS e, {n_if('k IN (3, 4)')} AS g, {n_if('k = 6')} AS f {_JUDGED_SQL}), LATERAL (SELECT unnest({list(contradict.WARNINGS)!r}) AS code), LATERAL (SELECT CASE code WHEN 'aggregation_or_grain_error' THEN g WHEN 'financial_scope_warning' THEN f ELSE 0 END AS n)")
def warning_rates(spark, d):
    return reports.warning_rates(judged_pairs(spark, d))


# Layers


@query("query_layers", """SELECT o_orderkey AS idx, CASE k WHEN 4 THEN 'UNSUPPORTED_LINEAGE' WHEN 5 THEN 'PARSE_ERROR' ELSE 'OK' END AS layer_status,
  CASE k WHEN 4 THEN 'unknown_due_to_extraction_limit' WHEN 5 THEN 'unknown_due_to_parse_error' WHEN 2 THEN 'no_scope_in_sql' ELSE 'explicit_scope' END AS scope_status,
  CASE k WHEN 0 THEN 'customer_by_temporal_period' WHEN 1 THEN 'global_summary' WHEN 3 THEN 'vendor_level' WHEN 5 THEN 'unknown' ELSE 'raw_transaction' END AS grain,
  CASE k WHEN 0 THEN ['transaction_event', 'measure_filter'] WHEN 1 THEN ['transaction_event', 'payment_status'] WHEN 3 THEN ['transaction_event'] ELSE [] END AS scope_roles,
  CASE k WHEN 0 THEN ['credit', 'debit'] WHEN 1 THEN ['credit'] WHEN 2 THEN ['balance'] WHEN 3 THEN ['row_count'] WHEN 4 THEN ['unknown'] ELSE [] END AS vectors,
  CASE k WHEN 0 THEN ['single_column_aggregate'] WHEN 1 THEN ['single_column_aggregate', 'composite_expression'] WHEN 2 THEN ['raw_column_selection'] WHEN 3 THEN ['row_count'] WHEN 4 THEN ['raw_column_selection'] ELSE [] END AS types,
  CASE k WHEN 1 THEN ['include_only', 'invert_sign_polarity'] ELSE [] END AS effects,
  CASE k WHEN 0 THEN ['prior_month'] WHEN 1 THEN ['prior_calendar_year'] ELSE [] END AS period_labels,
  CASE k WHEN 0 THEN 'normalized' WHEN 1 THEN 'partially_normalized' WHEN 3 THEN 'normalized' WHEN 5 THEN 'unknown' ELSE 'no_temporal_filter' END AS temporal_status,
  CASE k WHEN 0 THEN 'possible_pre_aggregation_threshold_filter' ELSE 'none_detected' END AS threshold_risk FROM (SELECT o_orderkey, o_orderkey % 6 AS k FROM orders)""")
def query_layers(spark, d):
    texts = by_case(
        "SELECT Customers, SUM(Credit) - SUM(Debit) FROM master_txn_table WHERE Transaction_TYPE = 'invoice' AND Transaction_DATE BETWEEN date(current_date, 'start of month', '-1 months') AND date('now', 'start of month', '-1 days') AND Amount > {k} GROUP BY Customers, strftime('%Y', Transaction_DATE)",
        "SELECT SUM(CASE WHEN Transaction_TYPE IN ('invoice', 'bill') THEN Credit ELSE 0 END), SUM(CASE WHEN AR_paid = 'paid' THEN -Credit ELSE Credit END) FROM master_txn_table WHERE strftime('%Y', Transaction_DATE) = strftime('%Y', 'now') - 1",
        "SELECT Balance FROM customers", "SELECT COUNT(*) FROM master_txn_table WHERE Transaction_TYPE = 'bill' AND Transaction_DATE >= '2024-01-01' GROUP BY Vendor", "SELECT a FROM (SELECT {k} AS a) t", "SELEC {k}",
    )
    return layers.with_layers(dealt(orders(spark, d)).select("idx", texts.alias("sql")), "sql", _NOTES).select("idx", "layer_status", "scope_status", "grain", "scope_roles", "vectors", "types", "effects", "period_labels", "temporal_status", "threshold_risk")


# Gates

_REPAIRS = [
    ("financial_measure_error", "SELECT SUM(Credit) FROM l", "SELECT SUM(Debit) FROM l", ["SELECT"], "accepted", None),
    ("financial_measure_error", "SELECT SUM(Credit) FROM l", "select  sum(credit)  from l ;", [], "accepted", None),
    ("financial_measure_error", "SELECT SUM(Credit) FROM l", "SELECT SUM(Credit) FROM l WHERE a = 1", ["WHERE"], "rejected", None),
    ("financial_object_error", "SELECT a FROM l WHERE t = 'x'", "SELECT a FROM l WHERE t = 'y'", ["WHERE"], "accepted", None),
    ("computation_logic_error", "SELECT a FROM l WHERE due_date > '2024-01-01'", "SELECT a FROM l WHERE due_date > '2023-01-01' LIMIT 3", ["WHERE", "LIMIT"], "accepted", "not_applicable"),
    ("computation_logic_error", "SELECT a FROM l WHERE t = 'x'", "SELECT a FROM l WHERE t = 'y'", ["WHERE"], "rejected", "not_applicable"),
    ("computation_logic_error", "SELECT SUM(a) AS s, c FROM l GROUP BY c ORDER BY s", "SELECT SUM(a), c FROM l GROUP BY c ORDER BY s", ["SELECT"], "rejected", "not_applicable"),
    ("computation_logic_error", "SELECT a FROM l", "SELECT a FROM m", ["FROM"], "rejected", "not_applicable"),
    ("computation_logic_error", "SELECT SUM(a) FROM l", "SELECT SUM(a) FROM l GROUP BY c", ["GROUP BY"], "accepted", "by"),
    ("other", "SELECT a FROM l", "SELECT b FROM l", ["SELECT"], "rejected", None),
    ("financial_measure_error", "SELECT a FROM l", "SELECT a FROM", ["SELECT", "FROM"], "rejected", None),
    ("financial_object_error", "SELECT a FROM l JOIN m ON l.x = m.x WHERE b = 1", "SELECT a FROM l LEFT JOIN m ON l.x = m.x WHERE b = 1", ["JOIN"], "rejected", None),
]


@query("scope_gate_cases", f"SELECT o_orderkey AS idx, changed, scope_status, CASE WHEN grouping_status = 'by' THEN CASE WHEN (o_orderkey // {len(_REPAIRS)}) % 3 = 2 THEN 'rejected' ELSE 'accepted' END ELSE grouping_status END AS grouping_status FROM orders JOIN {values([(n, r[3] if r[3] else ['-'], r[4], r[5]) for n, r in enumerate(_REPAIRS)], 'm, changed0, scope_status, grouping_status')} ON o_orderkey % {len(_REPAIRS)} = m, LATERAL (SELECT list_filter(changed0, lambda x: x <> '-') AS changed)")
def scope_gate_cases(spark, d):
    pick = lambda n: F.element_at(F.array(*[F.lit(r[n]) for r in _REPAIRS]), (F.col("idx") % len(_REPAIRS) + 1).cast("int"))
    turn = F.floor(F.col("idx") / len(_REPAIRS)) % 3
    question = F.when(turn == 0, "total by customer").when(turn == 1, "which  vendor was paid").otherwise("what was paid hourly")
    rows = dealt(orders(spark, d)).select("idx", pick(0).alias("repair_mode"), pick(1).alias("before_sql"), pick(2).alias("after_sql"), question.alias("question"))
    return gates.with_gates(rows, question="question").select("idx", "changed", F.col("scope.status").alias("scope_status"), F.col("grouping.status").alias("grouping_status"))


@query("grouping_evidence", """SELECT o_orderkey AS idx, list_concat(CASE o_orderkey % 5 WHEN 0 THEN ['intent.slots.time.requires_group_by_period'] WHEN 1 THEN ['intent.slots.operation.group_by', 'intent.slots.operation.limit'] WHEN 2 THEN ['intent.slots.operation.comparison.required'] ELSE [] END,
  CASE o_orderkey % 3 WHEN 0 THEN ['question token: by', 'question token: top'] WHEN 1 THEN ['question phrase: which dimension'] ELSE [] END) AS evidence FROM orders""")
def grouping_evidence(spark, d):
    key = F.col("idx")
    question = F.when(key % 3 == 0, "Top sales by customer").when(key % 3 == 1, "Which  vendor was paid").otherwise("What is the total of bills paid hourly")
    intents = [{"slots": {"time": {"requires_group_by_period": True}}}, {"operation": {"group_by": ["customer"], "limit": 5}}, {"slots": {"operation": {"comparison": {"required": True}, "group_by": []}}}, {"slots": {"operation": {"limit": None}}}, {}]
    intent = F.element_at(F.array(*[F.lit(json.dumps(i)) for i in intents]), (key % 5 + 1).cast("int"))
    return orders(spark, d).select("idx", gates.grouping_evidence(question, intent).alias("evidence"))


# Execution


def execution_pairs(spark, d):
    """Reference and candidate queries about each vendor and type of transaction, and about each vendor's types; some fail on purpose."""
    vendor = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("v"))
    kinds = F.posexplode(F.array(*map(F.lit, ("bill", "deposit", "invoice", None)))).alias("n", "t")
    rows = vendor.select("k", "v", kinds).withColumn("idx", F.col("k") * 4 + F.col("n"))
    fill = lambda text: F.format_string(text.replace("%", "%%").replace("{v}", "%1$s").replace("{t}", "%2$s").replace("{T}", "%3$s"), "v", "t", F.upper("t"))
    gold = F.when(F.col("t").isNull(), fill("SELECT Transaction_TYPE, COUNT(*) FROM ledger_lines WHERE Vendor = '{v}' GROUP BY Transaction_TYPE ORDER BY Transaction_TYPE")).otherwise(
        fill("SELECT ROUND(SUM(Amount), 2) FROM ledger_lines WHERE Vendor = '{v}' AND Transaction_TYPE = '{t}' AND Transaction_DATE <= date('1997-01-01', '+1 year', '-1 day')"))
    made = F.when(F.col("t").isNull(), fill("SELECT Transaction_TYPE AS kind, SUM(1) AS n FROM ledger_lines WHERE Vendor = '{v}' GROUP BY Transaction_TYPE ORDER BY Transaction_TYPE")).otherwise(
        fill("SELECT ROUND(SUM(Amount), 2) AS total FROM ledger_lines WHERE Transaction_TYPE LIKE '{T}' AND strftime('%Y', Transaction_DATE) < '1998' AND Vendor = '{v}'"))
    made = F.when((F.col("idx") % 5 == 1) & F.col("t").isNotNull(), F.concat(made, F.lit(' AND AR_paid = "paid"'))).when((F.col("idx") % 5 == 1), F.concat(made, F.lit(" DESC"))).otherwise(made)
    gold = F.when(F.col("idx") % 23 == 22, F.replace(gold, F.lit("FROM"), F.lit("FORM"))).otherwise(gold)
    made = F.when(F.col("idx") % 9 == 8, F.replace(made, F.lit("ledger_lines"), F.lit("lines"))).otherwise(made)
    return rows.select("idx", gold.alias("gold_sql"), made.alias("generated_sql"))


@query("guarded_execution", f"""WITH {LED_SQL}, t AS (SELECT Vendor AS v, Transaction_TYPE AS t, round(sum(Amount), 2) AS a, round(sum(CASE WHEN AR_paid = 'paid' THEN Amount END), 2) AS p FROM led WHERE Transaction_DATE < DATE '1998-01-01' GROUP BY 1, 2),
  g AS (SELECT Vendor AS v, count(DISTINCT Transaction_TYPE) AS kinds FROM led GROUP BY 1),
  c AS (SELECT s_suppkey * 4 + k.n AS idx, s_name AS v, k.t FROM supplier, (VALUES (0, 'bill'), (1, 'deposit'), (2, 'invoice'), (3, NULL)) k(n, t)),
  e AS (SELECT idx, c.t, a, p, coalesce(kinds, 0) AS kinds, idx % 23 = 22 AS bad_gold, idx % 9 = 8 AS bad_made, idx % 5 = 1 AS other, CASE WHEN idx % 5 = 1 THEN p ELSE a END AS m FROM c LEFT JOIN t ON t.v = c.v AND t.t = c.t LEFT JOIN g ON g.v = c.v)
  SELECT idx, CASE WHEN bad_gold THEN 'D_ambiguous' WHEN bad_made THEN 'C_non_executable' WHEN t IS NULL AND other AND kinds > 1 OR t IS NOT NULL AND m IS DISTINCT FROM a THEN 'B_wrong_executable' ELSE 'A_correct_executable' END AS evaluation_group,
  list_filter([CASE WHEN bad_gold THEN 'gold_sql_error' END, CASE WHEN bad_made THEN 'generated_sql_error' END, CASE WHEN NOT bad_gold AND NOT bad_made AND t IS NULL AND kinds = 0 THEN 'both_results_empty' END, CASE WHEN NOT bad_gold AND NOT bad_made AND t IS NOT NULL AND a IS NULL THEN 'gold_result_all_null' END, CASE WHEN NOT bad_gold AND NOT bad_made AND t IS NOT NULL AND m IS NULL THEN 'generated_result_all_null' END], lambda x: x IS NOT NULL) AS ambiguity_flags
  FROM e""")
def guarded_execution(spark, d):
    lines = execute.spread(ledger_lines(spark, d)).persist()
    engine = execute.Engine(spark, {"ledger_lines": lines}, AS_OF)
    try:
        return execute.evaluate_pairs(execution_pairs(spark, d), engine).select("idx", "evaluation_group", "ambiguity_flags")
    finally:
        engine.close()
        lines.unpersist()


# Fixtures


@query("template_mutants", """SELECT k, family, replace(mutant, '{c}', c) AS mutant FROM (SELECT c_custkey AS k, c_name AS c FROM customer WHERE c_custkey % 7 <> 6), """ + values([
    ("swap_credit_debit", "SELECT SUM(Debit) FROM master_txn_table WHERE Transaction_TYPE = 'invoice' AND Customers = '{c}'"),
    ("swap_transaction_type_literals", "SELECT SUM(Credit) FROM master_txn_table WHERE Transaction_TYPE = 'bill' AND Customers = '{c}'"), ("remove_transaction_type_predicate", "SELECT SUM(Credit) FROM master_txn_table WHERE Customers = '{c}'"),
    ("swap_customer_vendor_columns", "SELECT SUM(Credit) FROM master_txn_table WHERE Transaction_TYPE = 'invoice' AND Vendor = '{c}'"), ("remove_party_predicate", "SELECT SUM(Credit) FROM master_txn_table WHERE Transaction_TYPE = 'invoice'")], "family, mutant"))
def template_mutants(spark, d):
    found = states.planned(customer_pairs(spark, d)).select(F.col("pair").cast("long").alias("k"), F.explode("statements").alias("s"))
    return found.where("s.kind = 'mutant'").select("k", "s.family", F.col("s.sql").alias("mutant"))


_LINE = "(SELECT l_extendedprice AS a, l_orderkey AS k, CASE l_returnflag WHEN 'R' THEN 'bill' WHEN 'A' THEN 'deposit' ELSE 'invoice' END AS t, CASE WHEN l_orderkey % 3 = 0 THEN 'paid' ELSE '--' END AS paid FROM lineitem)"


@query("template_discrimination", f"""SELECT 'quantity_transaction_count' AS template, (SELECT sum(l_quantity) <> count(*) AND sum(l_quantity) <> count(DISTINCT l_orderkey) FROM lineitem) AS discriminative
  UNION ALL SELECT 'transaction_type_scope', (SELECT count(DISTINCT a) = 3 FROM (SELECT t, sum(a) AS a FROM {_LINE} GROUP BY t)) UNION ALL SELECT 'customer_vendor_scope', false
  UNION ALL SELECT 'balance_count_status_proxy', (SELECT count(*) <> 0 AND count(*) FILTER (WHERE paid = 'paid') <> 0 FROM {_LINE})""")
def template_discrimination(spark, d):
    lines = ledger_lines(spark, d).withColumns({"Open_balance": F.lit(0.0), "AP_paid": F.lit(None).cast("string")})
    return fixtures.preflight(lines).where(F.col("template").isin("quantity_transaction_count", "transaction_type_scope", "customer_vendor_scope", "balance_count_status_proxy")).select("template", "discriminative")


@query("fixture_day", "SELECT o_orderkey AS idx, CASE WHEN (lo IS NULL OR '1996-01-01' >= lo) AND (hi IS NULL OR '1996-01-01' <= hi) THEN '1996-01-01' WHEN lo IS NOT NULL AND (hi IS NULL OR lo <= hi) THEN lo ELSE coalesce(hi, '1996-01-01') END AS day FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS lo, CASE WHEN o_orderkey % 4 <> 0 THEN '1996-06-30' END AS hi FROM orders)")
def fixture_day(spark, d):
    key = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(key.alias("idx"), F.when(key % 3 != 0, F.col("o_orderdate").cast("date").cast("string")).alias("lo"), F.when(key % 4 != 0, "1996-06-30").alias("hi"))
    return rows.select("idx", fixtures.clamped_day(F.lit("1996-01-01"), F.col("lo"), F.col("hi")).alias("day"))


_ASKED_SUM = "SELECT SUM(Credit) FROM master_txn_table WHERE Transaction_TYPE = 'invoice' AND Customers = '{c}'"
#: Candidates for the same question: as it is, in other words, and with a wrong side, type, party and status.
_CANDIDATES = (
    _ASKED_SUM, "SELECT SUM(m.Credit) AS total FROM master_txn_table m WHERE m.Customers = '{c}' AND lower(m.Transaction_TYPE) LIKE 'INVOICE'", "SELECT SUM(Debit) FROM master_txn_table WHERE Transaction_TYPE = 'invoice' AND Customers = '{c}'",
    "SELECT SUM(Credit) FROM master_txn_table WHERE Transaction_TYPE = 'bill' AND Customers = '{c}'", "SELECT SUM(Credit) FROM master_txn_table WHERE Transaction_TYPE = 'invoice'", "SELECT SUM(Credits) FROM master_txn_table WHERE Customers = '{c}'",
)


def customer_pairs(spark, d):
    """A reference about each customer, and one of six candidates by the customer's key; each seventh reference has no accounting meaning."""
    c = dealt(table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("c")))
    fill = lambda t: F.replace(F.lit(t), F.lit("{c}"), F.col("c"))
    made = F.element_at(F.array(*map(fill, _CANDIDATES)), (F.col("k") % len(_CANDIDATES) + 1).cast("int"))
    return c.select("k", F.col("k").cast("string").alias("pair"), F.when(F.col("k") % 7 == 6, "SELECT Account_name FROM chart_of_accounts").otherwise(fill(_ASKED_SUM)).alias("gold_sql"), made.alias("generated_sql"))


@query("accounting_verdicts", "SELECT c_custkey AS k, CASE WHEN c_custkey % 7 = 6 THEN NULL WHEN c_custkey % 6 < 3 THEN 1 ELSE 0 END AS eq_acct, CASE WHEN c_custkey % 7 = 6 THEN 0 ELSE 3 END AS valid_states, CASE WHEN c_custkey % 7 = 6 THEN 'no_applicable_template' END AS reason FROM customer")
def accounting_verdicts(spark, d):
    """Without an account, both sides of balanced entries add up to the same, so the wrong side is not told apart."""
    found = states.verdicts(spark, customer_pairs(spark, d))
    return found.select(F.col("pair").cast("long").alias("k"), "eq_acct", F.coalesce(F.size(F.filter("states", lambda s: s.reason.isNull())), F.lit(0)).alias("valid_states"), F.when(F.size("applicable") == 0, F.element_at(F.map_keys("reasons"), 1)).alias("reason"))


# Verification and repair, with a model that follows rules


def scripted(prompts: list[str]) -> list[str]:
    """Stands in for a language model: debits are right, credits are a wrong measure, anything else is unclear."""
    out = []
    for p in prompts:
        if p.startswith("Compare"):
            shown = p.rpartition("Computed:")[2]
            verdict = {"evidence_match": "sufficient"} if "SUM(Debit)" in shown else {"evidence_match": "insufficient", "primary_mismatch_type": "financial_measure_error", "failed_evidence": ["credit"]} if "SUM(Credit)" in shown else {"evidence_match": "unclear", "suggested_probe": "which side?"}
            out.append(json.dumps(verdict))
        elif p.startswith("Answer a question about"):
            out.append('{"probe_resolution": "unclear", "reasoning": "not told"}')
        elif p.startswith("A SQL query does not answer"):
            out.append('```json\n{"repair_hint": "sum debits", "confidence": "high"}\n```')
        else:
            out.append('Here: {"repaired_sql": "SELECT SUM(Debit) FROM master_txn_table"}')
    return out


def asked(spark, d):
    texts = by_case("SELECT SUM(Debit) FROM master_txn_table", "SELECT SUM(Credit) FROM master_txn_table", "SELECT Account FROM master_txn_table", "SELECT a FROM (SELECT 1 AS a) s", "SELECT SUM( FROM {k}")
    return dealt(orders(spark, d)).where("idx % 10 < 5").select("idx", F.lit("total debit").alias("question"), texts.alias("generated_sql"), F.when(F.col("idx") % 5 == 4, "syntax error").alias("generated_error"))


@query("verification_rounds", """SELECT o_orderkey AS idx, CASE o_orderkey % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 4 THEN false END AS answers_question, CASE o_orderkey % 5 WHEN 1 THEN 'financial_measure_error' WHEN 4 THEN 'non_executable_error' END AS mismatch_type,
  CASE o_orderkey % 5 WHEN 2 THEN 'marked_unclear' WHEN 3 THEN 'UNSUPPORTED_LINEAGE' END AS abstain_reason, CAST(CASE o_orderkey % 5 WHEN 2 THEN 7 ELSE 0 END AS INT) AS probes_used, o_orderkey % 5 IN (1, 4) AS hinted FROM orders WHERE o_orderkey % 10 < 5""")
def verification_rounds(spark, d):
    v = F.col("verification")
    return verify.verified(asked(spark, d), scripted, _NOTES).select("idx", v["answers_question"].alias("answers_question"), v["mismatch_type"].alias("mismatch_type"), v["abstain_reason"].alias("abstain_reason"), v["probes_used"].alias("probes_used"), v["repair_hint"].isNotNull().alias("hinted"))


@query("repair_chain", """SELECT o_orderkey AS idx, CASE WHEN o_orderkey % 5 IN (1, 4) THEN 'SELECT SUM(Debit) FROM master_txn_table' END AS repaired_sql, CASE o_orderkey % 5 WHEN 1 THEN 'specialized_chain_repair' WHEN 4 THEN 'non_executable_repair' ELSE 'original_generated_sql' END AS final_sql_source,
  CASE o_orderkey % 5 WHEN 1 THEN 'verifier_accepts_after_repair' WHEN 4 THEN 'verifier_accepts_after_execution_repair' END AS stop_reason, CAST(CASE WHEN o_orderkey % 5 IN (1, 4) THEN 1 ELSE 0 END AS INT) AS num_repair_attempts FROM orders WHERE o_orderkey % 10 < 5""")
def repair_chain(spark, d):
    rows = verify.verified(asked(spark, d), scripted, _NOTES)
    kind = F.when(F.col("generated_error").isNotNull(), "non_executable").when(F.col("verification.answers_question").eqNullSafe(False), "semantic")
    rows = rows.withColumns({"candidate_kind": kind, "intent_representation": F.lit("{}")})
    return repair.repaired(rows, scripted, _NOTES).select("idx", "repaired_sql", "final_sql_source", "stop_reason", "num_repair_attempts")


@query("generic_refine", "SELECT o_orderkey AS idx, CASE WHEN o_orderkey % 5 = 0 THEN 'no_change' ELSE 'changed' END AS refine_decision FROM orders WHERE o_orderkey % 10 < 5")
def generic_refine(spark, d):
    revise = lambda prompts: ['{"changed": true, "revised_sql": "select sum(debit)  from master_txn_table;"}'] * len(prompts)
    return repair.refined(asked(spark, d), revise).select("idx", "refine_decision")


