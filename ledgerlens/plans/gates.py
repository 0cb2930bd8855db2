"""Which clauses a repair changed, and whether it was allowed to.

Everything is built-in functions over the facts of the query before and after.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.scalars import GROUPING, TEMPORAL_WORDS, is_temporal
from ledgerlens.plans.facts import CLAUSES, with_facts

# Kinds of error that a repair takes on, and the clauses that it may change.
MODES = ("financial_measure_error", "financial_object_error", "computation_logic_error")
ALLOWED = {
    "financial_measure_error": ("SELECT",),
    "financial_object_error": ("WHERE",),
    "computation_logic_error": ("SELECT", "WHERE", "GROUP BY", "HAVING", "ORDER BY", "LIMIT"),
}
ACCEPTED, REJECTED, NOT_APPLICABLE = "accepted", "rejected", "not_applicable"


def _plain(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")))


def changed_clauses(before: Column, after: Column) -> Column:
    """Clauses that differ, but for case and white space, in the order of the text."""
    tests = [F.when(_plain(before["clauses"][c]) != _plain(after["clauses"][c]), c) for c in CLAUSES]
    return F.array_compact(F.array(*tests))


def changed_predicates(before: Column, after: Column) -> Column:
    """Comparisons of the WHERE clauses that only one of the two queries has, sorted."""
    of = lambda facts: F.transform(facts["filters"], lambda f: _plain(f["expression"]))
    a, b = of(before), of(after)
    return F.array_sort(F.array_union(F.array_except(a, b), F.array_except(b, a)))


def orphaned_aliases(before: Column, after: Column) -> Column:
    """Names of outputs that are gone while ORDER BY still uses them."""
    low = lambda names: F.transform(names, lambda n: F.lower(n))
    gone = F.array_except(low(before["output_names"]), low(after["output_names"]))
    return F.array_intersect(gone, F.array_intersect(low(before["order_names"]), low(after["order_names"])))


def _policy(mode: Column) -> Column:
    return F.try_element_at(F.create_map(*[x for m in MODES for x in (F.lit(m), F.array(*map(F.lit, ALLOWED[m])))]), mode)


def scope_check(before: Column, after: Column, mode: Column) -> Column:
    """Whether a repair of a kind of error stays in its scope: struct of status, changed, violated, error; the first reason holds."""
    changed, allowed = changed_clauses(before, after), _policy(mode)
    outside = F.array_except(changed, F.coalesce(allowed, F.array().cast("array<string>")))
    timeless = F.filter(changed_predicates(before, after), lambda p: ~is_temporal(p))
    orphans = orphaned_aliases(before, after)
    none = F.array().cast("array<string>")
    logic = (mode == "computation_logic_error") & F.array_contains(changed, "WHERE") & (F.size(timeless) > 0)
    orphaned = F.array_contains(changed, "SELECT") & ~F.array_contains(changed, "ORDER BY") & (F.size(orphans) > 0)
    listed = lambda names: F.concat_ws(", ", names)
    result = lambda status, ch, violated, error: F.struct(F.lit(status).alias("status"), ch.alias("changed"), violated.alias("violated"), error.cast("string").alias("error"))
    return (
        F.when(allowed.isNull(), result(REJECTED, none, none, F.concat(F.lit("no policy for "), F.coalesce(mode, F.lit("null")))))
        .when(before["error"].isNotNull(), result(REJECTED, none, none, F.concat(F.lit("the query before cannot be read: "), before["error"])))
        .when(after["error"].isNotNull(), result(REJECTED, none, none, F.concat(F.lit("the repaired query cannot be read: "), after["error"])))
        .when(F.size(outside) > 0, result(REJECTED, changed, outside, F.concat(F.lit("clauses that must stay: "), listed(outside))))
        .when(logic, result(REJECTED, changed, F.array(F.lit("WHERE")), F.concat(F.lit("predicates that speak of no time: "), listed(timeless))))
        .when(orphaned, result(REJECTED, changed, F.array(F.lit("SELECT")), F.concat(F.lit("ORDER BY uses names that are gone: "), listed(orphans))))
        .otherwise(result(ACCEPTED, changed, none, F.lit(None)))
    )


#: Where an intent says that its answer is grouped, as paths of its JSON, with the test that says so.
SIGNALS = {
    "time.requires_group_by_period": lambda v: v == "true",
    "operation.group_by": lambda v: v.startswith("[") & (v != "[]"),
    "operation.comparison.required": lambda v: v == "true",
    "operation.order_by": lambda v: v.startswith("[") & (v != "[]"),
    "operation.limit": lambda v: ~v.isin("", "none", "null"),
}


def grouping_evidence(question: Column, intent: Column) -> Column:
    """What asks for grouped output: signals of the intent (JSON, its slots at the top or under ``slots``), then words of the question."""
    said = []
    for path, test in SIGNALS.items():
        value = F.coalesce(F.get_json_object(intent, f"$.{path}"), F.get_json_object(intent, f"$.slots.{path}"))
        said.append(F.when(F.coalesce(test(value), F.lit(False)), f"intent.slots.{path}"))
    for words in GROUPING:
        pattern = rf"\b{words}\b".replace(" ", r"\s+")
        kind = "question token" if " " not in words else "question phrase"
        shown = words if " " not in words else f"{words.split()[0]} dimension"
        said.append(F.when(F.lower(F.coalesce(question, F.lit(""))).rlike(pattern), f"{kind}: {shown}"))
    return F.array_distinct(F.array_compact(F.array(*said)))


def grouping_check(before: Column, after: Column, mode: Column, question: Column, intent: Column) -> Column:
    """Whether a repair of logic may group: struct of status (null for other repairs), required, evidence, error."""
    evidence = grouping_evidence(question, intent)
    required = F.size(evidence) > 0
    none = F.lit(None).cast("string")
    now, was = _plain(after["clauses"]["GROUP BY"]), _plain(before["clauses"]["GROUP BY"])
    result = lambda status, req, ev, error: F.struct(status.cast("string").alias("status"), req.cast("boolean").alias("required"), ev.alias("evidence"), error.cast("string").alias("error"))
    unread = F.coalesce(before["error"], after["error"])
    return (
        F.when(mode != "computation_logic_error", result(none, F.lit(None), F.array().cast("array<string>"), none))
        .when(unread.isNotNull(), result(F.lit(REJECTED), required, evidence, unread))
        .when((now == "") | (now == was), result(F.lit(NOT_APPLICABLE), required, evidence, none))
        .when(required, result(F.lit(ACCEPTED), required, evidence, none))
        .otherwise(result(F.lit(REJECTED), required, evidence, F.lit("GROUP BY changed, and nothing asks for groups")))
    )


def temporal(predicate: str) -> bool:
    """Whether a predicate speaks of time: one of the words anywhere in it."""
    return any(w in predicate.lower() for w in TEMPORAL_WORDS)


def with_gates(df: DataFrame, before: str = "before_sql", after: str = "after_sql", mode: str = "repair_mode", question: str | None = None, intent: str | None = None) -> DataFrame:
    """``df`` with changed, scope (see ``scope_check``) and grouping (see ``grouping_check``) of each repair."""
    read = with_facts(with_facts(df, before, "_before"), after, "_after")
    asked = F.col(question) if question else F.lit(None).cast("string")
    meant = F.col(intent) if intent else F.lit(None).cast("string")
    b, a, m = F.col("_before"), F.col("_after"), F.col(mode)
    out = read.withColumns({"changed": changed_clauses(b, a), "scope": scope_check(b, a, m), "grouping": grouping_check(b, a, m, asked, meant)})
    return out.select(*df.columns, "changed", "scope", "grouping")
