"""Reports over repair runs: every figure of a report is a conditional count or a rate of two counts, all taken in one pass."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.scalars import count_and_rate, filled, percent, rate, signed_points, worsened
from ledgerlens.operators.metrics import bottleneck, count_if
from ledgerlens.plans.contradict import HARD, NONE, UNKNOWN, WARNINGS
from ledgerlens.sources.ledger import A, B, C, D


def tallied(df: DataFrame, counts: dict[str, Column], rates: dict[str, tuple[str, str]], by: list[str] | None = None, empty: float | None = 0.0) -> DataFrame:
    """Counts and sums by name in one pass, then rates of two of them; with ``by`` for each group."""
    held = (df.groupBy(*by) if by else df).agg(*[c.alias(n) for n, c in counts.items()])
    return held.select("*", *[rate(F.col(a), F.col(b), empty).alias(n) for n, (a, b) in rates.items()])


def verification_flags(verification: str = "verification") -> dict[str, Column]:
    """What a verification says: rejected, abstained (also without a verdict), ambiguous, sure, and the probes used (no number counts as none)."""
    v = F.col(verification)
    return {
        "rejected": v["answers_question"].eqNullSafe(False),
        "abstained": v["answers_question"].isNull() | v["should_abstain"].eqNullSafe(True),
        "ambiguous": v["ambiguous"].eqNullSafe(True),
        "sure": F.coalesce(F.lower(v["confidence"]) == "high", F.lit(False)),
        "probes": F.coalesce(v["probes_used"], F.lit(0)),
    }


def with_final_sql(df: DataFrame, original: tuple[str, ...] = ("generated_sql",)) -> DataFrame:
    """Adds the query that counts in the end: final_sql (the repair, else the original), its source, final_sql_repaired, and the status and error that follow.

    A source that the run names itself is kept; a row without any query fails.
    """
    c = F.col
    first = filled(*[c(o) for o in original if o in df.columns])
    repair = filled(c("repaired_sql"))
    named = filled(c("final_sql_source")) if "final_sql_source" in df.columns else F.lit(None).cast("string")
    source = F.when(repair.isNotNull(), F.when(named.isNotNull() & ~named.isin("original_generated_sql", "missing"), named).otherwise("repaired_sql")).otherwise("original_generated_sql")
    final = F.coalesce(repair, first)
    status = filled(c("status")) if "status" in df.columns else F.lit(None).cast("string")
    return df.withColumns({
        "final_sql": final, "final_sql_source": F.when(final.isNull(), "missing").otherwise(source), "final_sql_repaired": repair.isNotNull(), "original_sql": first,
        "final_status": F.when(final.isNull(), "failed").otherwise(F.coalesce(status, F.lit("success"))), "final_error": F.when(final.isNull(), "missing final SQL"),
    })


def repair_report(df: DataFrame) -> DataFrame:
    """All figures of a repair run, one row; names begin with their section.

    Reads evaluation_group (before), after_group, status, repair_status,
    verification, and what ``with_final_sql`` adds. Rates without a denominator are 0.
    """
    c, was, now = F.col, F.col("evaluation_group"), F.col("after_group")
    v = verification_flags()
    used, tried = c("final_sql_repaired"), ~c("status").eqNullSafe("skipped")
    wrong = was.isin(B, C)
    counted = {
        "rows": F.count(F.lit(1)),
        "comparison_original_total": count_if(was.isin(A, B, C)), "comparison_final_total": count_if(now.isin(A, B, C)), "comparison_original_correct": count_if(was == A), "comparison_final_correct": count_if(now == A),
        "coverage_rejected": count_if(v["rejected"]), "coverage_attempted": count_if(tried), "coverage_applied": count_if(used), "coverage_skipped": count_if(c("status") == "skipped"),
        "coverage_errors": count_if(c("repair_status").isNotNull() & ~c("repair_status").isin("skipped", "success")), "coverage_fallback": count_if(c("final_sql_source") == "original_generated_sql"), "coverage_missing": count_if(c("final_sql_source") == "missing"),
        "effect_wrong": count_if(wrong), "effect_corrected": count_if(wrong & (now == A)), "effect_applied_wrong": count_if(used & wrong), "effect_applied_corrected": count_if(used & wrong & (now == A)),
        "effect_still_wrong": count_if(wrong & now.isin(B, C)), "effect_nonexec": count_if(was == C), "effect_nonexec_corrected": count_if((was == C) & (now == A)), "effect_executable": count_if(used & now.isin(A, B)), "effect_repaired_correct": count_if(used & (now == A)),
        "safety_touched_correct": count_if(used & (was == A)), "safety_preserved": count_if((was == A) & (now == A)), "safety_corrupted": count_if(used & (was == A) & (now != A)),
        "probe_rows": count_if(v["probes"] > 0), "probe_total": F.sum(v["probes"]).cast("long"), "probe_total_rejected": F.sum(F.when(v["rejected"], v["probes"]).otherwise(0)).cast("long"),
        "probe_rejected": count_if((v["probes"] > 0) & v["rejected"]), "probe_none": count_if(v["probes"] <= 0), "probe_none_rejected": count_if((v["probes"] <= 0) & v["rejected"]),
        "probe_ambiguous": count_if(v["ambiguous"]), "probe_abstained": count_if(v["abstained"]), "probe_sure": count_if(v["sure"]), "probe_sure_rejected": count_if(v["sure"] & v["rejected"]),
    }
    rates = {
        "comparison_original_accuracy": ("comparison_original_correct", "comparison_original_total"), "comparison_final_accuracy": ("comparison_final_correct", "comparison_final_total"),
        "coverage_rejection_rate": ("coverage_rejected", "rows"), "coverage_attempt_rate": ("coverage_attempted", "rows"), "coverage_generation_rate": ("coverage_applied", "coverage_attempted"),
        "coverage_application_rate": ("coverage_applied", "rows"), "coverage_skip_rate": ("coverage_skipped", "rows"), "coverage_failure_rate": ("coverage_errors", "coverage_attempted"),
        "effect_corrected_rate": ("effect_corrected", "effect_wrong"), "effect_applied_corrected_rate": ("effect_applied_corrected", "effect_applied_wrong"), "effect_success_rate": ("effect_corrected", "coverage_attempted"),
        "effect_precision": ("effect_applied_corrected", "coverage_applied"), "effect_still_wrong_rate": ("effect_still_wrong", "effect_wrong"), "effect_nonexec_rate": ("effect_nonexec_corrected", "effect_nonexec"),
        "effect_executable_rate": ("effect_executable", "coverage_applied"), "effect_repaired_correct_rate": ("effect_repaired_correct", "coverage_applied"),
        "safety_corruption_rate": ("safety_corrupted", "safety_touched_correct"), "safety_overall_corruption_rate": ("safety_corrupted", "comparison_original_correct"), "safety_preservation_rate": ("safety_preserved", "comparison_original_correct"),
        "movement_corrected_rate": ("effect_corrected", "comparison_original_total"), "movement_corrupted_rate": ("safety_corrupted", "comparison_original_total"),
        "probe_rate": ("probe_rows", "rows"), "probe_average": ("probe_total", "rows"), "probe_average_rejected": ("probe_total_rejected", "coverage_rejected"), "probe_rejection_rate": ("probe_rejected", "probe_rows"),
        "probe_none_rejection_rate": ("probe_none_rejected", "probe_none"), "probe_ambiguous_rate": ("probe_ambiguous", "rows"), "probe_abstention_rate": ("probe_abstained", "rows"), "probe_sure_rejection_rate": ("probe_sure_rejected", "probe_sure"),
    }
    out = tallied(df, counted, rates)
    net = c("effect_corrected") - c("safety_corrupted")
    return out.withColumns({
        "comparison_accuracy_delta": c("comparison_final_accuracy") - c("comparison_original_accuracy"), "comparison_net_correct": c("comparison_final_correct") - c("comparison_original_correct"),
        "movement_net_rows": net, "movement_net_rate": rate(net, c("comparison_original_total")),
    })


def contradiction_report(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Figures of pairs judged by ``contradict.with_contradictions`` (status, execution_match, excluded_from_primary_metrics).

    Rates of contradictions are of the pairs that can be judged. The crosstab with
    execution leaves out pairs that cannot be judged and those without a match.
    """
    status, match = F.col("status"), F.col("execution_match")
    measured = match.isNotNull() & ~F.coalesce("excluded_from_primary_metrics", F.lit(False))
    judged = status != UNKNOWN
    counts = {"total": F.count(F.lit(1)), "evaluable": count_if(judged), "hard": count_if(status == HARD), "none": count_if(status == NONE), "not_evaluable": count_if(status == UNKNOWN)}
    counts |= {f"{name}_{end}": count_if((status == kind) & (match == held)) for name, kind in (("hard", HARD), ("none", NONE)) for end, held in (("pass", True), ("fail", False))}
    counts |= {"without_match": count_if(judged & match.isNull()), "measured": count_if(measured), "measured_pass": count_if(measured & match)}
    rates = {"hard_rate": ("hard", "evaluable"), "none_rate": ("none", "evaluable"), "not_evaluable_rate": ("not_evaluable", "total"), "execution_accuracy": ("measured_pass", "measured")}
    return tallied(df, counts, rates, by)


def warning_rates(df: DataFrame) -> DataFrame:
    """Each known warning with the pairs that have it, also none, and its rate of the pairs that can be judged."""
    held = [count_if(F.array_contains("warnings", w)).alias(w) for w in WARNINGS]
    every = df.agg(count_if(F.col("status") != UNKNOWN).alias("evaluable"), *held)
    rows = F.inline(F.array(*[F.struct(F.lit(w).alias("code"), F.col(w).alias("n")) for w in WARNINGS]))
    return every.select("evaluable", rows).select("code", "n", rate(F.col("n"), F.col("evaluable"), 0.0).alias("rate"))


def histograms(df: DataFrame, columns: list[str]) -> DataFrame:
    """Counts of the values of several columns in one pass over the rows: (name, value, n), nulls counted."""
    pairs = F.explode(F.array(*[F.struct(F.lit(x).alias("name"), F.col(x).cast("string").alias("value")) for x in columns]))
    return df.select(pairs.alias("p")).groupBy("p.name", "p.value").agg(F.count("*").alias("n"))


def mode_report(df: DataFrame, group: str = "evaluation_group", mode: str = "mode") -> DataFrame:
    """A verifier's quality in each way of probing, over rows that execution calls right or wrong; rates without a denominator are null."""
    v, right, wrong = verification_flags(), F.col(group) == A, F.col(group) == B
    said = F.col("verification")["answers_question"]
    accepts = said.eqNullSafe(True)
    counts = {
        "n": F.count(F.lit(1)), "group_a": count_if(right), "group_b": count_if(wrong), "correct": count_if((accepts & right) | (v["rejected"] & wrong)),
        "true_accepts": count_if(accepts & right), "true_rejects": count_if(v["rejected"] & wrong), "accepted": count_if(accepts), "refused": count_if(v["rejected"]),
        "false_rejects": count_if(v["rejected"] & right), "missed": count_if(~v["rejected"] & wrong), "ambiguous_a": count_if(v["ambiguous"] & right), "ambiguous_b": count_if(v["ambiguous"] & wrong),
        "abstained_a": count_if(v["abstained"] & right), "abstained_b": count_if(v["abstained"] & wrong), "probes": F.sum(v["probes"]).cast("long"),
        "sure": count_if(v["sure"]), "sure_right": count_if(v["sure"] & ((accepts & right) | (v["rejected"] & wrong))),
    }
    rates = {
        "accuracy": ("correct", "n"), "accept_precision": ("true_accepts", "accepted"), "accept_recall": ("true_accepts", "group_a"), "reject_precision": ("true_rejects", "refused"), "reject_recall": ("true_rejects", "group_b"),
        "avg_probes": ("probes", "n"), "sure_rate": ("sure", "n"), "sure_precision": ("sure_right", "sure"),
    }
    out = tallied(df.where(F.col(group).isin(A, B)), counts, rates, [mode], None)
    f1 = lambda p, r: F.try_divide(2 * F.col(p) * F.col(r), F.col(p) + F.col(r))
    return out.withColumns({"accept_f1": f1("accept_precision", "accept_recall"), "reject_f1": f1("reject_precision", "reject_recall"), "sure_wrong": F.col("sure") - F.col("sure_right"), "unsure": F.col("n") - F.col("sure")})


def probe_cost(modes: DataFrame, baseline: str = "none", mode: str = "mode") -> DataFrame:
    """Points of accuracy gained over the mode without probes, for each further probe; null for that mode itself or without further probes."""
    base = modes.where(F.col(mode) == baseline).agg(F.first("accuracy").alias("_a"), F.first("avg_probes").alias("_p"))
    more = F.col("avg_probes") - F.col("_p")
    cost = F.when((F.col(mode) != baseline) & (more > 0), 100 * (F.col("accuracy") - F.col("_a")) / more)
    return modes.crossJoin(F.broadcast(base)).withColumn("probe_gain", cost).drop("_a", "_p")  # one row


def candidate_report(df: DataFrame) -> DataFrame:
    """Rates of repair candidates: attempted, generated, executable and successful, and attempts by group."""
    c = F.col
    tried, made = ~c("status").eqNullSafe("skipped"), filled(c("repaired_sql")).isNotNull()
    counts = {
        "total": F.count(F.lit(1)), "attempted": count_if(tried), "generated": count_if(tried & made), "executable": count_if(tried & made & (c("repaired_execution_status") == "success")),
        "successful": count_if(c("repair_success")), "attempted_b": count_if(tried & (c("evaluation_group") == B)), "attempted_c": count_if(tried & (c("evaluation_group") == C)),
    }
    rates = {"generation_rate": ("generated", "attempted"), "executable_rate": ("executable", "generated"), "correction_rate": ("successful", "attempted"), "accuracy_contribution": ("successful", "total")}
    return tallied(df, counts, rates)


def repair_outcome(df: DataFrame, match: str = "execution_match", error: str = "generated_error") -> DataFrame:
    """Before and after of each repair: before_exec_match from the group, after_exec_match, repair_success; a row without a repair is skipped."""
    c = F.col
    before = F.when(c("evaluation_group") == A, True).when(c("evaluation_group").isin(B, C), False)
    made = filled(c("repaired_sql")).isNotNull()
    after = F.when(made, F.coalesce(c(match), F.lit(False)))
    return df.withColumns({
        "repair_evaluation_status": F.when(made, "success").otherwise("skipped_no_repaired_sql"), "before_exec_match": before, "after_exec_match": after,
        "repair_success": F.coalesce(~before & after, F.lit(False)), "repaired_execution_status": F.when(made, F.when(c(error).isNull(), "success").otherwise("error")),
    })


# Accounting accuracy


def asa_report(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Figures of rows scored by ``metrics.asa_rows``; ``by`` for each set."""
    c = F.col
    passed, known = c("ex") == 1, c("inv_used").isNotNull()
    counts = {
        "total": F.count(F.lit(1)), "ex_known": count_if(c("ex").isNotNull()), "ex_pass": count_if(passed), "ex_fail": count_if(c("ex") == 0), "available": count_if(c("available")),
        "strict_pass": count_if(c("asa_strict") == 1), "strict_fail": count_if(c("asa_strict") == 0), "lower_pass": count_if(c("asa_lower") == 1), "inv_known": count_if(passed & known), "inv_failed": count_if(passed & (c("inv_used") == 0)),
        "lower_failed_ex_pass": count_if(passed & (c("asa_lower") == 0)),
    }
    rates = {
        "ex_accuracy": ("ex_pass", "ex_known"), "strict_accuracy": ("strict_pass", "available"), "lower_accuracy": ("lower_pass", "ex_known"), "fper": ("inv_failed", "inv_known"),
        "fper_lower": ("lower_failed_ex_pass", "ex_pass"), "evaluability": ("inv_known", "ex_pass"),
    }
    return tallied(df, counts, rates, by)


DELTAS = ("ex_accuracy", "strict_accuracy", "lower_accuracy", "fper", "fper_lower")


def asa_deltas(report: DataFrame, label: str = "label") -> DataFrame:
    """After less before, for five rates of a report by set."""
    of = lambda which, name: F.max(F.when(F.col(label) == which, F.col(name)))
    return report.agg(*[(of("after", d) - of("before", d)).alias(f"{d}_delta") for d in DELTAS])


# Attribution


def attributed(df: DataFrame) -> DataFrame:
    """Where a failure of accounting was lost or mended: flags of each row and its primary bottleneck.

    Reads before_EX, before_Inv, before_asa_strict, before_asa_lower and the same
    with after_; verification; repair_mode, repair_status, repaired_sql and final_sql_repaired.
    """
    c, v = F.col, F.col("verification")
    yes = lambda test: F.coalesce(test, F.lit(False))
    metrics = ("EX", "Inv", "asa_strict", "asa_lower")
    worse = worsened([c(f"before_{m}") for m in metrics], [c(f"after_{m}") for m in metrics])
    applied = yes(c("final_sql_repaired"))
    df = df.withColumns({
        "hard_failure": yes(c("before_Inv") == 0), "verifier_caught": v["answers_question"].eqNullSafe(False),
        "repair_attempted": yes(c("repair_mode") == "semantic") & ~c("repair_status").eqNullSafe("skipped"), "repair_generated": yes(c("repair_status") == "success") & yes(F.length("repaired_sql") > 0),
        "metric_worsened": worse, "inv_unevaluable": yes(c("before_Inv") == 0) & c("after_Inv").isNull(),
    })
    df = df.withColumn("verifier_actionable", c("verifier_caught") & ~v["should_abstain"].eqNullSafe(True) & yes(F.length(v["repair_hint"]) > 0))
    hard, fixed = c("hard_failure"), c("hard_failure") & yes(c("after_Inv") == 1)
    df = df.withColumns({
        "missed_by_verifier": hard & ~c("verifier_caught"), "caught_but_not_actionable": hard & c("verifier_caught") & ~c("verifier_actionable"),
        "actionable_but_not_attempted": hard & c("verifier_actionable") & ~c("repair_attempted"), "attempted_but_no_sql": hard & c("repair_attempted") & ~c("repair_generated"),
        "generated_but_inv_not_fixed": hard & c("repair_generated") & ~fixed, "inv_fixed": fixed, "still_hard": hard & yes(c("after_Inv") == 0),
        "fixed_but_ex_broken": fixed & yes((c("before_EX") == 1) & (c("after_EX") == 0)), "fixed_and_ex_preserved": fixed & yes((c("before_EX") == 1) & (c("after_EX") == 1)),
        "harmful_gate_accept": applied & c("metric_worsened"), "over_repair_candidate": yes((c("before_EX") == 1) & (c("before_Inv") == 1)) & applied & c("metric_worsened"),
    })
    # Bottlenecks in the order in which they are named.
    reasons = [
        ("not_primary_cohort", ~hard), ("verifier_miss", c("missed_by_verifier")), ("weak_verifier_signal", c("caught_but_not_actionable")), ("repair_not_attempted", c("actionable_but_not_attempted")),
        ("repair_generation_failure", c("attempted_but_no_sql")), ("repair_fixed_inv_but_broke_ex", c("fixed_but_ex_broken")), ("gate_accepted_harmful_repair", c("harmful_gate_accept")),
        ("repair_did_not_fix_inv", c("generated_but_inv_not_fixed")), ("not_bottleneck_fixed", c("fixed_and_ex_preserved")),
    ]
    return df.withColumn("primary_bottleneck", bottleneck(reasons, "weak_verifier_signal"))


def attribution_report(rows: DataFrame) -> DataFrame:
    """The funnel of hard failures, each step among the rows of the step before, and harm inside and outside it."""
    c = F.col
    steps = {"hard_failures": "hard_failure", "caught": "verifier_caught", "actionable": "verifier_actionable", "attempted": "repair_attempted", "generated": "repair_generated", "fixed": "inv_fixed", "fixed_and_preserved": "fixed_and_ex_preserved"}
    counts, so_far = {}, F.lit(True)
    for name, flag in steps.items():
        so_far = so_far & c(flag)
        counts[name] = count_if(so_far)
    counts |= {
        "still_hard": count_if(c("still_hard")), "became_unevaluable": count_if(c("inv_unevaluable")), "harmful": count_if(c("harmful_gate_accept")),
        "harmful_in_cohort": count_if(c("harmful_gate_accept") & c("hard_failure")), "over_repaired_outside": count_if(c("over_repair_candidate") & ~c("hard_failure")),
    }
    return rows.agg(*[v.alias(n) for n, v in counts.items()])


def breakdown(df: DataFrame, column: str) -> DataFrame:
    """Counts by a column's value as text (lists as sorted JSON), in order of the value."""
    kind = df.schema[column].dataType.typeName()
    value = F.to_json(F.array_sort(F.coalesce(column, F.array().cast(df.schema[column].dataType)))) if kind == "array" else F.coalesce(F.col(column).cast("string"), F.lit("None"))
    return df.groupBy(value.alias("value")).agg(F.count("*").alias("n")).orderBy("value")


def metric_moves(df: DataFrame, metrics: tuple[str, ...] = ("EX", "Inv", "asa_strict", "asa_lower")) -> DataFrame:
    """Counts by all metrics before and after, as one JSON text."""
    side = lambda which: F.struct(*[F.col(f"{which}_{m}").cast("int").alias(m) for m in metrics]).alias(which)
    return df.groupBy(F.to_json(F.struct(side("before"), side("after")), {"ignoreNullFields": "false"}).alias("value")).agg(F.count("*").alias("n")).orderBy("value")


def split_sets(df: DataFrame, set_column: str = "set", key: str = "question_id", order: str = "at") -> DataFrame:
    """Rows before and after side by side: (key, before, after), the last row of each by ``order``. A null key or an unknown set fails."""
    checked = F.when(F.col(key).isNotNull() & F.col(set_column).isin("before", "after"), F.col(set_column)).otherwise(F.raise_error(F.lit("a row without an id or of an unknown set")).cast("string"))
    row = F.struct(*[c for c in df.columns if c not in (set_column, key, order)])
    last = lambda which: F.max_by(F.when(F.col("_s") == which, row), F.when(F.col("_s") == which, F.col(order))).alias(which)
    return df.withColumn("_s", checked).groupBy(key).agg(last("before"), last("after"))


# Published tables


def common_total(df: DataFrame, total: str, label: str) -> DataFrame:
    """``df`` unchanged; reading it fails if its rows do not share one total (nulls aside)."""
    distinct = df.agg(F.count_distinct(total).alias("_n"))
    fine = F.when(F.col("_n") <= 1, F.lit(True)).otherwise(F.raise_error(F.lit(f"{label}: rows do not share one total")).cast("boolean"))
    return df.crossJoin(F.broadcast(distinct.select(fine.alias("_fine")))).where("_fine").drop("_fine")  # one row


def movement(reports: DataFrame) -> DataFrame:
    """Rates for published tables, of repair reports by system; null without a denominator.

    A report without its movement figures has them made up from its other counts.
    """
    c = F.col
    optional = lambda name: c(name) if name in reports.columns else F.lit(None).cast("long")
    corrected = F.coalesce(optional("movement_corrected_rows"), c("effect_corrected"))
    corrupted = F.coalesce(optional("movement_corrupted_rows"), c("safety_corrupted"))
    total = F.coalesce(optional("movement_total"), c("comparison_original_total"), optional("metric_total"))
    net = F.coalesce(optional("movement_net_rows"), corrected - corrupted)
    part = lambda a, b: rate(a, b, None)
    return reports.select(
        "*", corrected.alias("correction_count"), corrupted.alias("corruption_count"), net.alias("net_gain_count"), total.alias("movement_rows"), part(corrected, total).alias("correction_rate"), part(corrupted, total).alias("corruption_rate"),
        part(net, total).alias("net_gain_rate"), part(corrected, c("effect_wrong")).alias("conditional_correction"), part(corrupted, c("comparison_original_correct")).alias("conditional_corruption"),
    )


def preferred_set(sets: Column) -> Column:
    """Of an array of structs with a label: the one labelled after, else before, else the first."""
    of = lambda label: F.get(F.filter(sets, lambda s: s["label"] == label), 0)
    return F.coalesce(of("after"), of("before"), F.get(sets, 0))


def main_comparison(systems: DataFrame) -> DataFrame:
    """One row for each system (system, kind, execution_accuracy, asa_sets and a repair report's counts): accuracies and movement, which generators do not have."""
    own = movement(systems)
    asa = preferred_set(F.col("asa_sets"))
    only = lambda name: F.when(F.col("kind") != "generator", F.col(name)).alias(name)
    accuracy = F.coalesce("execution_accuracy", "comparison_final_accuracy")
    table = own.select("system", accuracy.alias("ex_accuracy"), asa["strict_accuracy"].alias("asa_strict_accuracy"), *[only(n) for n in ("correction_rate", "correction_count", "corruption_rate", "corruption_count", "net_gain_rate", "net_gain_count", "movement_rows")])
    return common_total(table, "movement_rows", "main comparison")


def against_full(variants: DataFrame, key: str = "key", value: str = "ex_accuracy", full: str = "full") -> DataFrame:
    """Variants with their difference to the full system; without a full system reading fails."""
    base = variants.agg(F.max(F.when(F.col(key) == full, F.col(value))).alias("_full"), count_if(F.col(key) == full).alias("_n"))
    checked = base.select(F.when(F.col("_n") > 0, F.col("_full")).otherwise(F.raise_error(F.lit("no full system")).cast("double")).alias("_full"))
    return variants.crossJoin(F.broadcast(checked)).withColumn(f"delta_{value}", F.col(value) - F.col("_full")).drop("_full")  # one row


def levels(df: DataFrame, sets: list[list[str]], figures: dict[str, Column]) -> DataFrame:
    """Figures at several levels of grouping in one pass: all columns of ``sets`` (null where a level sums over them), ``level`` (its place in ``sets``) and the figures, distinct counts among them.

    A null in a grouping column is a group of its own, told from a level that sums over the column by ``level``.
    """
    columns = list(dict.fromkeys(c for s in sets for c in s))
    # the bit of a column is set where a level sums over it
    number = {sum(1 << (len(columns) - 1 - k) for k, c in enumerate(columns) if c not in s): n for n, s in enumerate(sets)}
    level = F.element_at(F.create_map(*[F.lit(x) for pair in number.items() for x in pair]), F.grouping_id().cast("int"))
    return df.groupingSets([[F.col(c) for c in s] for s in sets], *columns).agg(level.alias("level"), *[c.alias(n) for n, c in figures.items()]).select("level", *columns, *figures)


# What a profile's flags are counted as, and the words that say so.
FLAG_KINDS = {
    "unobserved_literal": ("unobserved_literal",), "missing_literal": ("missing_marker", "missing_literal"), "ambiguous_resolution": ("ambiguous",),
    "transaction_line_grain": ("transaction_line", "transaction lines"), "requires_account_context": ("requires_account_context", "requires account"),
}


def flag_histogram(df: DataFrame, flags: str, statuses: dict[str, str]) -> DataFrame:
    """Rows (what, value, n): how many rows there are, their statuses (columns by what they are called; null is none), and how many flags of each kind; a flag may be of several. Kinds and statuses that do not come are left out."""
    kinds = F.flatten(F.transform(F.coalesce(flags, F.array().cast("array<string>")), lambda f: F.array_compact(F.array(*[F.when(_any(F.lower(f), words), name) for name, words in FLAG_KINDS.items()]))))
    listed = [F.array(F.struct(F.lit("rows").alias("what"), F.lit("").alias("value")))]
    listed += [F.array(F.struct(F.lit(what).alias("what"), F.col(c).cast("string").alias("value"))) for what, c in statuses.items()]
    listed.append(F.transform(kinds, lambda k: F.struct(F.lit("flag").alias("what"), k.alias("value"))))
    return df.select(F.explode(F.concat(*listed)).alias("x")).where("x.value IS NOT NULL").groupBy("x.what", "x.value").agg(F.count("*").alias("n"))


def _any(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def strategy_table(reports: DataFrame, labels: dict[str, str], key: str = "system") -> DataFrame:
    """Movement of each strategy in the order of ``labels``, with its label and its accuracies after repair; strategies without a report are left out, and all must share one total."""
    own = movement(reports)
    asa = preferred_set(F.col("asa_sets"))
    place = F.element_at(F.create_map(*[F.lit(x) for k, name in enumerate(labels) for x in (name, k)]), F.col(key))
    label = F.element_at(F.create_map(*[F.lit(x) for pair in labels.items() for x in pair]), F.col(key))
    names = ("correction_count", "correction_rate", "corruption_count", "corruption_rate", "net_gain_count", "net_gain_rate", "movement_rows")
    table = own.where(F.col(key).isin(*labels)).select(F.col(key).alias("strategy"), label.alias("label"), place.alias("place"), *names, asa["strict_accuracy"].alias("asa_strict_accuracy"))
    return common_total(table, "movement_rows", "strategies").orderBy("place").drop("place")


#: Bits of a distinct-count sketch (about 0.8 % of standard error) and size of a quantile sketch (about 1 % of rank).
HLL_BITS, KLL_SIZE = 14, 400


def sketches(df: DataFrame, by: list[str], distinct: str, value: str) -> DataFrame:
    """Sketches of each group: a distinct count, a distribution, and the number of rows; tables of them are stored for each run and merge."""
    return df.groupBy(*by).agg(F.hll_sketch_agg(distinct, HLL_BITS).alias("distinct_sketch"), F.kll_sketch_agg_double(F.col(value).cast("double"), KLL_SIZE).alias("value_sketch"), F.count("*").alias("n"))


def merged_sketches(stored: DataFrame, by: list[str], shares: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """Figures of sketches of any number of runs: rows, distinct values, and the values below which the shares lie."""
    merged = stored.groupBy(*by).agg(F.hll_union_agg("distinct_sketch").alias("d"), F.kll_merge_agg_double("value_sketch").alias("v"), F.sum("n").alias("n"))
    quantiles = [F.kll_sketch_get_quantile_double("v", F.lit(s)).alias(f"p{round(100 * s)}") for s in shares]
    return merged.select(*by, "n", F.hll_sketch_estimate("d").alias("distinct"), *quantiles)


def examples_by_code(df: DataFrame, codes: str, most: int = 10, order: tuple[str, ...] = ("set", "question_id")) -> DataFrame:
    """The first findings of each code by an order, at most ``most``: what a reader looks at first (a report's limit).

    The limit on the row number reaches the tasks before the exchange
    (WindowGroupLimit), which send ``most`` rows of a code each.
    """
    from pyspark.sql.window import Window

    each = df.withColumn("code", F.explode(F.array_distinct(codes)))
    return each.withColumn("place", F.row_number().over(Window.partitionBy("code").orderBy(*order))).where(F.col("place") <= most)


# As text


def markdown(df: DataFrame, columns: dict[str, Column | str], most: int = 1000) -> str:
    """A small table as Markdown: headings and the columns under them, rows in the order of ``df``; over ``most`` rows is an error."""
    rows = df.select(*[(F.col(v) if isinstance(v, str) else v).alias(k) for k, v in columns.items()]).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of over {most} rows")
    lines = ["| " + " | ".join(columns) + " |", "| " + " | ".join("---" for _ in columns) + " |"]
    return "\n".join([*lines, *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows)]) + "\n"


def comparison_markdown(table: DataFrame) -> str:
    c = F.col
    cell = lambda name: F.when(c(f"{name}_count").isNull(), "n/a").otherwise(F.concat(percent(c(f"{name}_rate")), F.lit(" ("), c(f"{name}_count").cast("string"), F.lit("/"), c("movement_rows").cast("string"), F.lit(")")))
    return markdown(table, {"System": "system", "EX": percent(c("ex_accuracy")), "ASA": percent(c("asa_strict_accuracy")), "Corrected": cell("correction"), "Corrupted": cell("corruption"), "Net Gain": F.when(c("net_gain_rate").isNull(), "n/a").otherwise(signed_points(c("net_gain_rate")))})


def modes_markdown(modes: DataFrame) -> str:
    c = F.col
    return markdown(modes, {"Mode": "mode", "N": "n", "Accuracy": count_and_rate(c("correct"), c("n")), "Accept F1": percent(c("accept_f1"), 1), "Reject F1": percent(c("reject_f1"), 1), "Probes": F.format_string("%.2f", "avg_probes")})


def document(report: DataFrame) -> str:
    """A report of one row as JSON, its sections (the words before the first underscore) as objects."""
    row = report.first().asDict(recursive=True)
    out: dict = {}
    for name, value in row.items():
        section, _, rest = name.partition("_")
        if rest and sum(k.startswith(section + "_") for k in row) > 1:
            out.setdefault(section, {})[rest] = value
        else:
            out[name] = value
    return json.dumps(out, ensure_ascii=False, indent=2)
