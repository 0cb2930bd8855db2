"""Registered queries over repair runs and over records, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.operators import dataflow, metrics, reports, rows
from ledgerlens.operators.queries import n_if, query, r0, rn
from ledgerlens.plans import verdicts
from ledgerlens.sources import records
from ledgerlens.sources.ledger import A, B, EV_SQL, REP_SQL, evaluation_records, ledger_lines, repair_records, table


def rep_sql(body: str, *more: str) -> str:
    return "WITH " + ", ".join([EV_SQL, REP_SQL, *more]) + " " + body


#: The query that counts in the end, in DuckDB SQL.
FINAL_SQL = """fin AS (SELECT *, CASE WHEN trim(coalesce(repaired_sql, '')) <> '' THEN repaired_sql END AS rs,
    CASE WHEN trim(coalesce(repaired_sql, '')) <> '' THEN coalesce(final_sql_source, 'repaired_sql') WHEN generated_sql IS NULL THEN 'missing' ELSE 'original_generated_sql' END AS src FROM rep)"""
X, Y, Z = "'A_correct_executable'", "'B_wrong_executable'", "'C_non_executable'"


def final_rows(spark, d):
    return reports.with_final_sql(repair_records(spark, d))


@query("final_sql_rows", rep_sql("SELECT idx, coalesce(rs, generated_sql) AS final_sql, src AS final_sql_source, rs IS NOT NULL AS final_sql_repaired, CASE WHEN rs IS NULL AND generated_sql IS NULL THEN 'failed' ELSE status END AS final_status, CASE WHEN rs IS NULL AND generated_sql IS NULL THEN 'missing final SQL' END AS final_error FROM fin", FINAL_SQL))
def final_sql_rows(spark, d):
    return final_rows(spark, d).select("idx", "final_sql", "final_sql_source", "final_sql_repaired", "final_status", "final_error")


_W, _U, _T = f"evaluation_group IN ({Y}, {Z})", "rs IS NOT NULL", "status <> 'skipped'"
_REJ = "answers IS NOT DISTINCT FROM false"
_COUNTS = {
    "rows": "true", "comparison_original_total": f"evaluation_group <> 'D_ambiguous'", "comparison_final_total": "after_group <> 'D_ambiguous'", "comparison_original_correct": f"evaluation_group = {X}", "comparison_final_correct": f"after_group = {X}",
    "coverage_rejected": _REJ, "coverage_attempted": _T, "coverage_applied": _U, "coverage_skipped": "status = 'skipped'", "coverage_errors": "repair_status = 'failed'", "coverage_fallback": "src = 'original_generated_sql'", "coverage_missing": "src = 'missing'",
    "effect_wrong": _W, "effect_corrected": f"{_W} AND after_group = {X}", "effect_applied_wrong": f"{_U} AND {_W}", "effect_applied_corrected": f"{_U} AND {_W} AND after_group = {X}", "effect_still_wrong": f"{_W} AND after_group IN ({Y}, {Z})",
    "effect_nonexec": f"evaluation_group = {Z}", "effect_nonexec_corrected": f"evaluation_group = {Z} AND after_group = {X}", "effect_executable": f"{_U} AND after_group IN ({X}, {Y})", "effect_repaired_correct": f"{_U} AND after_group = {X}",
    "safety_touched_correct": f"{_U} AND evaluation_group = {X}", "safety_preserved": f"evaluation_group = {X} AND after_group = {X}", "safety_corrupted": f"{_U} AND evaluation_group = {X} AND after_group <> {X}",
    "probe_rows": "probes > 0", "probe_rejected": f"probes > 0 AND {_REJ}", "probe_none": "probes = 0", "probe_none_rejected": f"probes = 0 AND {_REJ}", "probe_ambiguous": "ambiguous", "probe_abstained": "answers IS NULL OR abstain",
    "probe_sure": "confidence = 'high'", "probe_sure_rejected": f"confidence = 'high' AND {_REJ}",
}
_RATES = {
    "comparison_original_accuracy": "comparison_original_correct/comparison_original_total", "comparison_final_accuracy": "comparison_final_correct/comparison_final_total", "coverage_rejection_rate": "coverage_rejected/rows", "coverage_attempt_rate": "coverage_attempted/rows",
    "coverage_generation_rate": "coverage_applied/coverage_attempted", "coverage_application_rate": "coverage_applied/rows", "coverage_skip_rate": "coverage_skipped/rows", "coverage_failure_rate": "coverage_errors/coverage_attempted",
    "effect_corrected_rate": "effect_corrected/effect_wrong", "effect_applied_corrected_rate": "effect_applied_corrected/effect_applied_wrong", "effect_success_rate": "effect_corrected/coverage_attempted", "effect_precision": "effect_applied_corrected/coverage_applied",
    "effect_still_wrong_rate": "effect_still_wrong/effect_wrong", "effect_nonexec_rate": "effect_nonexec_corrected/effect_nonexec", "effect_executable_rate": "effect_executable/coverage_applied", "effect_repaired_correct_rate": "effect_repaired_correct/coverage_applied",
    "safety_corruption_rate": "safety_corrupted/safety_touched_correct", "safety_overall_corruption_rate": "safety_corrupted/comparison_original_correct", "safety_preservation_rate": "safety_preserved/comparison_original_correct",
    "movement_corrected_rate": "effect_corrected/comparison_original_total", "movement_corrupted_rate": "safety_corrupted/comparison_original_total", "probe_rate": "probe_rows/rows", "probe_average": "probe_total/rows", "probe_average_rejected": "probe_total_rejected/coverage_rejected",
    "probe_rejection_rate": "probe_rejected/probe_rows", "probe_none_rejection_rate": "probe_none_rejected/probe_none", "probe_ambiguous_rate": "probe_ambiguous/rows", "probe_abstention_rate": "probe_abstained/rows", "probe_sure_rejection_rate": "probe_sure_rejected/probe_sure",
}
_Q = lambda n: '"rows"' if n == "rows" else n
REPORT_SQL = (
    "t AS (SELECT " + ", ".join(f"{n_if(t)} AS {_Q(n)}" for n, t in _COUNTS.items()) + f", CAST(sum(probes) AS BIGINT) AS probe_total, CAST(sum(CASE WHEN {_REJ} THEN probes ELSE 0 END) AS BIGINT) AS probe_total_rejected FROM fin{{where}}), "
    "r AS (SELECT *, " + ", ".join(f"{r0(*map(_Q, v.split('/')))} AS {n}" for n, v in _RATES.items()) + " FROM t)"
)
REPORT_LAST = f"SELECT *, comparison_final_accuracy - comparison_original_accuracy AS comparison_accuracy_delta, comparison_final_correct - comparison_original_correct AS comparison_net_correct, effect_corrected - safety_corrupted AS movement_net_rows, {r0('effect_corrected - safety_corrupted', 'comparison_original_total')} AS movement_net_rate FROM r"


@query("repair_report", rep_sql(REPORT_LAST, FINAL_SQL, REPORT_SQL.format(where="")))
def repair_report(spark, d):
    return reports.repair_report(final_rows(spark, d))


@query("run_histograms", rep_sql("SELECT name, value, CAST(count(*) AS BIGINT) AS n FROM (SELECT 'final_sql_source' AS name, src AS value FROM fin UNION ALL SELECT 'evaluation_group', evaluation_group FROM fin UNION ALL SELECT 'after_group', after_group FROM fin UNION ALL SELECT 'status', status FROM fin UNION ALL SELECT 'repair_status', repair_status FROM fin UNION ALL SELECT 'repair_mode', repair_mode FROM fin) GROUP BY ALL", FINAL_SQL))
def run_histograms(spark, d):
    return reports.histograms(final_rows(spark, d), ["final_sql_source", "evaluation_group", "after_group", "status", "repair_status", "repair_mode"])


_MODES = f"""m AS (SELECT mode, {n_if('true')} AS n, {n_if('a')} AS group_a, {n_if('NOT a')} AS group_b, {n_if('(yes AND a) OR (no AND NOT a)')} AS correct, {n_if('yes AND a')} AS true_accepts, {n_if('no AND NOT a')} AS true_rejects,
  {n_if('yes')} AS accepted, {n_if('no')} AS refused, {n_if('no AND a')} AS false_rejects, {n_if('NOT no AND NOT a')} AS missed, {n_if('ambiguous AND a')} AS ambiguous_a, {n_if('ambiguous AND NOT a')} AS ambiguous_b,
  {n_if('(answers IS NULL OR abstain) AND a')} AS abstained_a, {n_if('(answers IS NULL OR abstain) AND NOT a')} AS abstained_b, CAST(sum(probes) AS BIGINT) AS probes, {n_if("confidence = 'high'")} AS sure, {n_if("confidence = 'high' AND ((yes AND a) OR (no AND NOT a))")} AS sure_right
  FROM (SELECT *, evaluation_group = {X} AS a, coalesce(answers, false) AS yes, coalesce(NOT answers, false) AS no FROM rep WHERE evaluation_group IN ({X}, {Y})) GROUP BY mode),
 p AS (SELECT *, {rn('correct', 'n')} AS accuracy, {rn('true_accepts', 'accepted')} AS accept_precision, {rn('true_accepts', 'group_a')} AS accept_recall, {rn('true_rejects', 'refused')} AS reject_precision, {rn('true_rejects', 'group_b')} AS reject_recall,
  {rn('probes', 'n')} AS avg_probes, {rn('sure', 'n')} AS sure_rate, {rn('sure_right', 'sure')} AS sure_precision FROM m),
 f AS (SELECT *, 2 * accept_precision * accept_recall / nullif(accept_precision + accept_recall, 0) AS accept_f1, 2 * reject_precision * reject_recall / nullif(reject_precision + reject_recall, 0) AS reject_f1, sure - sure_right AS sure_wrong, n - sure AS unsure FROM p)"""


@query("verifier_mode_report", rep_sql("SELECT f.*, CASE WHEN f.mode <> 'none' AND f.avg_probes > b.avg_probes THEN 100 * (f.accuracy - b.accuracy) / (f.avg_probes - b.avg_probes) END AS probe_gain FROM f, (SELECT * FROM f WHERE mode = 'none') b", _MODES))
def verifier_mode_report(spark, d):
    return reports.probe_cost(reports.mode_report(repair_records(spark, d)))


def candidate_rows(spark, d):
    rows = repair_records(spark, d)
    return reports.repair_outcome(rows.withColumns({"execution_match": F.col("after_group") == A, "generated_error": F.when(F.col("after_group") == "C_non_executable", "error")}))


_MADE = "trim(coalesce(repaired_sql, '')) <> ''"


@query("repair_outcomes", rep_sql(f"SELECT idx, CASE WHEN {_MADE} THEN 'success' ELSE 'skipped_no_repaired_sql' END AS repair_evaluation_status, CASE WHEN evaluation_group = {X} THEN true WHEN evaluation_group <> 'D_ambiguous' THEN false END AS before_exec_match, CASE WHEN {_MADE} THEN after_group = {X} END AS after_exec_match, evaluation_group IN ({Y}, {Z}) AND {_MADE} AND after_group = {X} AS repair_success, CASE WHEN {_MADE} THEN CASE WHEN after_group = {Z} THEN 'error' ELSE 'success' END END AS repaired_execution_status FROM rep"))
def repair_outcomes(spark, d):
    return candidate_rows(spark, d).select("idx", "repair_evaluation_status", "before_exec_match", "after_exec_match", "repair_success", "repaired_execution_status")


@query("repair_candidate_metrics", rep_sql(f"SELECT *, {r0('generated', 'attempted')} AS generation_rate, {r0('executable', 'generated')} AS executable_rate, {r0('successful', 'attempted')} AS correction_rate, {r0('successful', 'total')} AS accuracy_contribution FROM (SELECT {n_if('true')} AS total, {n_if(_T)} AS attempted, {n_if(f'{_T} AND {_MADE}')} AS generated, {n_if(f'{_T} AND {_MADE} AND after_group <> {Z}')} AS executable, {n_if(f'{_MADE} AND after_group = {X} AND evaluation_group IN ({Y}, {Z})')} AS successful, {n_if(f'{_T} AND evaluation_group = {Y}')} AS attempted_b, {n_if(f'{_T} AND evaluation_group = {Z}')} AS attempted_c FROM rep)"))
def repair_candidate_metrics(spark, d):
    return reports.candidate_report(candidate_rows(spark, d))


# Accounting accuracy of two sets


def asa_sets(spark, d):
    rows = repair_records(spark, d)
    scored = lambda label, group, inv: metrics.asa_rows(rows.withColumn("label", F.lit(label)), F.when(F.col(group) == A, 1).when(F.col(group).isin(B, "C_non_executable"), 0), inv)
    return scored("before", "evaluation_group", F.col("inv")).unionByName(scored("after", "after_group", F.when(F.col("idx") % 9 != 0, (F.col("idx") % 4 != 0).cast("int"))))


_ASA = f"""s AS (SELECT 'before' AS label, idx, CASE evaluation_group WHEN {X} THEN 1 WHEN 'D_ambiguous' THEN NULL ELSE 0 END AS ex, inv FROM rep
  UNION ALL SELECT 'after', idx, CASE after_group WHEN {X} THEN 1 WHEN 'D_ambiguous' THEN NULL ELSE 0 END, CASE WHEN idx % 9 <> 0 THEN CASE WHEN idx % 4 <> 0 THEN 1 ELSE 0 END END FROM rep),
 u AS (SELECT label, idx, ex, CASE WHEN ex = 1 THEN inv END AS iu, CASE WHEN ex = 0 THEN 0 WHEN ex = 1 THEN inv END AS st, CASE WHEN ex IS NOT NULL THEN CASE WHEN ex = 1 AND inv = 1 THEN 1 ELSE 0 END END AS lo FROM s),
 g AS (SELECT label, {n_if('true')} AS total, {n_if('ex IS NOT NULL')} AS ex_known, {n_if('ex = 1')} AS ex_pass, {n_if('ex = 0')} AS ex_fail, {n_if('st IS NOT NULL')} AS available, {n_if('st = 1')} AS strict_pass, {n_if('st = 0')} AS strict_fail, {n_if('lo = 1')} AS lower_pass,
  {n_if('ex = 1 AND iu IS NOT NULL')} AS inv_known, {n_if('ex = 1 AND iu = 0')} AS inv_failed, {n_if('ex = 1 AND lo = 0')} AS lower_failed_ex_pass FROM u GROUP BY label),
 a AS (SELECT *, {r0('ex_pass', 'ex_known')} AS ex_accuracy, {r0('strict_pass', 'available')} AS strict_accuracy, {r0('lower_pass', 'ex_known')} AS lower_accuracy, {r0('inv_failed', 'inv_known')} AS fper, {r0('lower_failed_ex_pass', 'ex_pass')} AS fper_lower, {r0('inv_known', 'ex_pass')} AS evaluability FROM g)"""


@query("asa_report", rep_sql("SELECT * FROM a", _ASA))
def asa_report(spark, d):
    return reports.asa_report(asa_sets(spark, d), ["label"])


@query("asa_deltas", rep_sql("SELECT " + ", ".join(f"max(CASE WHEN label = 'after' THEN {x} END) - max(CASE WHEN label = 'before' THEN {x} END) AS {x}_delta" for x in reports.DELTAS) + " FROM a", _ASA))
def asa_deltas(spark, d):
    return reports.asa_deltas(asa_report(spark, d))


# Attribution


def attribution(spark, d):
    group = lambda c: F.when(F.col(c) == A, 1).when(F.col(c).isin(B, "C_non_executable"), 0)
    key = F.col("idx")
    rows = final_rows(spark, d).withColumns({
        "before_EX": group("evaluation_group"), "after_EX": group("after_group"), "before_Inv": F.col("inv"), "after_Inv": F.when(key % 9 != 0, (key % 4 != 0).cast("int")),
    })
    strict = lambda side: F.when(F.col(f"{side}_EX") == 1, F.col(f"{side}_Inv")).otherwise(F.col(f"{side}_EX"))
    lower = lambda side: F.when(F.col(f"{side}_EX").isNotNull(), F.coalesce(strict(side), F.lit(0)))
    return reports.attributed(rows.withColumns({f"{s}_{m}": f(s) for s in ("before", "after") for m, f in (("asa_strict", strict), ("asa_lower", lower))}))


_ATT = f"""w AS (SELECT *, CASE evaluation_group WHEN {X} THEN 1 WHEN 'D_ambiguous' THEN NULL ELSE 0 END AS be, CASE after_group WHEN {X} THEN 1 WHEN 'D_ambiguous' THEN NULL ELSE 0 END AS ae, inv AS bi, CASE WHEN idx % 9 <> 0 THEN CASE WHEN idx % 4 <> 0 THEN 1 ELSE 0 END END AS ai FROM fin),
 k AS (SELECT *, CASE be WHEN 1 THEN bi ELSE be END AS bs, CASE ae WHEN 1 THEN ai ELSE ae END AS s2 FROM w),
 h AS (SELECT *, coalesce(bi = 0, false) AS hard, {_REJ} AS caught, {_REJ} AND NOT abstain AND has_verification AS act, repair_mode = 'semantic' AND repair_status IS DISTINCT FROM 'skipped' AS tried, coalesce(repair_status = 'success' AND length(repaired_sql) > 0, false) AS made,
  coalesce(ae, -1) < coalesce(be, -1) OR coalesce(ai, -1) < coalesce(bi, -1) OR coalesce(s2, -1) < coalesce(bs, -1) OR (CASE WHEN ae IS NULL THEN -1 ELSE coalesce(s2, 0) END) < (CASE WHEN be IS NULL THEN -1 ELSE coalesce(bs, 0) END) AS worse FROM k),
 q AS (SELECT *, hard AND coalesce(ai = 1, false) AS fixed, rs IS NOT NULL AND worse AS harm FROM h),
 z AS (SELECT *, fixed AND be = 1 AND ae = 0 AS broke, fixed AND be = 1 AND ae = 1 AS kept FROM q)"""


@query("attribution_rows", rep_sql("SELECT idx, hard AND NOT caught AS missed_by_verifier, hard AND caught AND NOT act AS caught_but_not_actionable, hard AND act AND NOT tried AS actionable_but_not_attempted, hard AND tried AND NOT made AS attempted_but_no_sql, hard AND made AND NOT fixed AS generated_but_inv_not_fixed, fixed AS inv_fixed, coalesce(broke, false) AS fixed_but_ex_broken, coalesce(kept, false) AS fixed_and_ex_preserved, harm AS harmful_gate_accept, coalesce(be = 1 AND bi = 1, false) AND harm AS over_repair_candidate, CASE WHEN NOT hard THEN 'not_primary_cohort' WHEN NOT caught THEN 'verifier_miss' WHEN NOT act THEN 'weak_verifier_signal' WHEN NOT tried THEN 'repair_not_attempted' WHEN NOT made THEN 'repair_generation_failure' WHEN broke THEN 'repair_fixed_inv_but_broke_ex' WHEN harm THEN 'gate_accepted_harmful_repair' WHEN NOT fixed THEN 'repair_did_not_fix_inv' WHEN kept THEN 'not_bottleneck_fixed' ELSE 'weak_verifier_signal' END AS primary_bottleneck FROM z", FINAL_SQL, _ATT))
def attribution_rows(spark, d):
    flags = ["missed_by_verifier", "caught_but_not_actionable", "actionable_but_not_attempted", "attempted_but_no_sql", "generated_but_inv_not_fixed", "inv_fixed", "fixed_but_ex_broken", "fixed_and_ex_preserved", "harmful_gate_accept", "over_repair_candidate", "primary_bottleneck"]
    return attribution(spark, d).select("idx", *flags)


@query("attribution_report", rep_sql("SELECT " + ", ".join(f"{n_if(t)} AS {n}" for n, t in {
    "hard_failures": "hard", "caught": "hard AND caught", "actionable": "hard AND caught AND act", "attempted": "hard AND caught AND act AND tried", "generated": "hard AND caught AND act AND tried AND made", "fixed": "hard AND caught AND act AND tried AND made AND fixed",
    "fixed_and_preserved": "hard AND caught AND act AND tried AND made AND fixed AND kept", "still_hard": "hard AND ai = 0", "became_unevaluable": "hard AND ai IS NULL", "harmful": "harm", "harmful_in_cohort": "harm AND hard", "over_repaired_outside": "be = 1 AND bi = 1 AND harm AND NOT hard",
}.items()) + " FROM z", FINAL_SQL, _ATT))
def attribution_report(spark, d):
    return reports.attribution_report(attribution(spark, d))


@query("bottleneck_breakdown", rep_sql("SELECT value, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN idx % 6 <> 0 AND has_verification THEN '[\"e' || idx % 3 || '\"]' ELSE '[]' END AS value FROM rep) GROUP BY 1"))
def bottleneck_breakdown(spark, d):
    return reports.breakdown(repair_records(spark, d).select(F.col("verification")["stage2_failed_evidence"].alias("evidence")), "evidence")


@query("metric_move_counts", rep_sql("SELECT '{\"before\":{\"EX\":' || coalesce(CAST(be AS VARCHAR), 'null') || ',\"Inv\":' || coalesce(CAST(bi AS VARCHAR), 'null') || '},\"after\":{\"EX\":' || coalesce(CAST(ae AS VARCHAR), 'null') || ',\"Inv\":' || coalesce(CAST(ai AS VARCHAR), 'null') || '}}' AS value, CAST(count(*) AS BIGINT) AS n FROM z GROUP BY 1", FINAL_SQL, _ATT))
def metric_move_counts(spark, d):
    return reports.metric_moves(attribution(spark, d), ("EX", "Inv"))


# Published tables


def systems(spark, d):
    rows = final_rows(spark, d)
    made = None
    for n, (name, kind) in enumerate((("none", "generator"), ("probe", "repair"), ("hybrid", "repair"))):
        # every system is the whole run, with other rows repaired
        own = rows.withColumn("final_sql_repaired", F.col("final_sql_repaired") & (F.col("idx") % 3 != n))
        one = reports.repair_report(own).withColumns({"system": F.lit(name), "kind": F.lit(kind), "execution_accuracy": F.lit(None).cast("double") if n else F.lit(0.5), "asa_sets": F.array(F.struct(F.lit("before").alias("label"), F.lit(0.25).alias("strict_accuracy")), *([F.struct(F.lit("after").alias("label"), F.lit(0.5 + n / 8).alias("strict_accuracy"))] if n else []))})
        made = one if made is None else made.unionByName(one)
    return made


_SYSTEMS = ", ".join(
    f"s{n} AS (SELECT '{name}' AS system, '{kind}' AS kind, {n_if(f'evaluation_group IN ({Y}, {Z}) AND after_group = {X}')} AS cc, {n_if(f'rs IS NOT NULL AND idx % 3 <> {n} AND evaluation_group = {X} AND after_group <> {X}')} AS kc, {n_if(chr(39) + 'x' + chr(39) + f' = ' + chr(39) + 'x' + chr(39) + ' AND evaluation_group <> ' + chr(39) + 'D_ambiguous' + chr(39))} AS t, {n_if(f'after_group = {X}')} AS fc, {n_if('after_group <> ' + chr(39) + 'D_ambiguous' + chr(39))} AS ft FROM fin)"
    for n, (name, kind) in enumerate((("none", "generator"), ("probe", "repair"), ("hybrid", "repair")))
)


@query("main_comparison", rep_sql(
    f"SELECT system, CASE system WHEN 'none' THEN 0.5 ELSE {rn('fc', 'ft')} END AS ex_accuracy, CASE system WHEN 'none' THEN 0.25 WHEN 'probe' THEN 0.625 ELSE 0.75 END AS asa_strict_accuracy, CASE WHEN kind <> 'generator' THEN {rn('cc', 't')} END AS correction_rate, CASE WHEN kind <> 'generator' THEN cc END AS correction_count, "
    f"CASE WHEN kind <> 'generator' THEN {rn('kc', 't')} END AS corruption_rate, CASE WHEN kind <> 'generator' THEN kc END AS corruption_count, CASE WHEN kind <> 'generator' THEN {rn('cc - kc', 't')} END AS net_gain_rate, CASE WHEN kind <> 'generator' THEN cc - kc END AS net_gain_count, CASE WHEN kind <> 'generator' THEN t END AS movement_rows "
    "FROM (SELECT * FROM s0 UNION ALL SELECT * FROM s1 UNION ALL SELECT * FROM s2)", FINAL_SQL, _SYSTEMS))
def main_comparison(spark, d):
    return reports.main_comparison(systems(spark, d))


# Rows


@query("candidate_rows", rep_sql(f"""SELECT idx, CASE WHEN reason IS NULL THEN CASE WHEN evaluation_group = {Z} THEN 'non_executable' ELSE 'semantic' END END AS candidate_kind, reason AS skip_reason FROM (
  SELECT idx, evaluation_group, CASE WHEN evaluation_group IN ({X}, {Y}) THEN CASE WHEN status <> 'success' THEN 'upstream_verification_failed' WHEN NOT has_verification THEN 'missing_verification' WHEN answers IS DISTINCT FROM false THEN 'verification_not_rejected' WHEN abstain THEN 'verification_abstained'
    WHEN mismatch IS NULL THEN 'missing_mismatch_type' WHEN idx % 6 = 0 THEN 'missing_failed_evidence' WHEN NOT hinted THEN 'missing_repair_hint' WHEN idx % 5 = 4 THEN 'missing_intent_representation' WHEN idx % 21 = 0 THEN 'missing_execution_profile' END
  WHEN evaluation_group = {Z} THEN CASE WHEN generated_sql IS NULL THEN 'missing_generated_sql' END ELSE 'unsupported_evaluation_group' END AS reason FROM rep)"""))
def candidate_query(spark, d):
    kind, reason = verdicts.candidate()
    return repair_records(spark, d).select("idx", kind.alias("candidate_kind"), reason.alias("skip_reason"))


@query("learning_skips", rep_sql(f"""SELECT skip_reason, CAST(count(*) AS BIGINT) AS n, {n_if(f'skip_reason IS NULL AND evaluation_group = {X}')} AS corruption_probes FROM (SELECT evaluation_group, CASE WHEN split <> 'validation' THEN 'split_filtered'
  WHEN evaluation_group = 'D_ambiguous' THEN 'unsupported_evaluation_group' WHEN evaluation_group = {Z} THEN CASE WHEN generated_sql IS NULL THEN 'missing_generated_sql' END WHEN status <> 'success' THEN 'upstream_verification_failed' WHEN NOT has_verification THEN 'missing_verification'
  WHEN answers IS DISTINCT FROM false THEN 'verification_not_rejected' WHEN abstain THEN 'verification_abstained' WHEN mismatch IS NULL THEN 'missing_mismatch_type' WHEN idx % 6 = 0 THEN 'missing_failed_evidence' WHEN NOT hinted THEN 'missing_repair_hint' WHEN idx % 5 = 4 THEN 'missing_intent_representation' WHEN idx % 21 = 0 THEN 'missing_execution_profile' END AS skip_reason FROM rep) GROUP BY 1"""))
def learning_skips(spark, d):
    examples = rows.learning_examples(repair_records(spark, d), F.concat(F.lit("Repair: "), "generated_sql"), "validation")
    return examples.groupBy("skip_reason").agg(F.count("*").alias("n"), metrics.count_if(F.col("is_corruption_probe")).alias("corruption_probes"))


@query("run_keys", rep_sql("SELECT idx, question_id, substr(sha256(coalesce(generated_sql, '')), 1, 16) AS generated_sql_hash, repair_mode, CAST(NULL AS VARCHAR) AS model, 'unknown' AS intent_mode, CAST(NULL AS VARCHAR) AS context_hash FROM rep"))
def run_keys(spark, d):
    return rows.with_run_key(repair_records(spark, d), "repair").select("idx", *rows.RUN_KEYS["repair"])


@query("subset_rows", "SELECT o_orderkey AS idx FROM orders ORDER BY o_orderkey LIMIT 500 OFFSET 250")
def subset_rows(spark, d):
    return rows.subset(table(spark, d, "orders").select(F.col("o_orderkey").alias("idx")), 250, 500, "idx")


@query("positional_pairs", "SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS _row_index, o_orderkey AS source, 2 * o_orderkey AS evaluated FROM orders")
def positional_pairs(spark, d):
    orders = table(spark, d, "orders").orderBy("o_orderkey")
    left = dataflow.numbered(orders.select(F.col("o_orderkey").alias("source")), "_row_index")
    return rows.zipped(left, dataflow.numbered(orders.select((2 * F.col("o_orderkey")).alias("evaluated")), "_row_index"))


@query("bag_equal_ordered", "SELECT place, a.v AS left_key, b.v AS right_key FROM (SELECT row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS place, o_orderkey AS v FROM orders) a FULL JOIN (SELECT row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS place, o_orderkey AS v FROM orders WHERE o_orderkey % 5000 <> 1) b USING (place) WHERE a.v IS DISTINCT FROM b.v")
def bag_equal_ordered(spark, d):
    orders = table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey")
    found = dataflow.ordered_difference(orders.select("o_orderkey"), orders.where("o_orderkey % 5000 <> 1").select("o_orderkey"))
    number = lambda side: F.regexp_replace(F.get(side, 0), "^n:", "").cast("long")
    return found.select(F.col("at").alias("place"), number("left").alias("left_key"), number("right").alias("right_key"))


@query("dedupe_counts", "SELECT CAST(count(*) AS BIGINT) AS \"rows\", CAST(count(DISTINCT o_custkey) AS BIGINT) AS ids, CAST(count(*) - count(DISTINCT o_custkey) AS BIGINT) AS repeats FROM orders")
def dedupe_counts(spark, d):
    return rows.dedupe(table(spark, d, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey")[1]


@query("before_after_sets", rep_sql("SELECT o_custkey AS question_id, max_by(o_orderkey, o_orderkey) FILTER (WHERE o_orderkey % 2 = 0) AS before_key, max_by(o_orderkey, o_orderkey) FILTER (WHERE o_orderkey % 2 = 1) AS after_key FROM orders GROUP BY 1"))
def before_after_sets(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("question_id"), F.col("o_orderkey").alias("at"), F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") % 2 == 0, "before").otherwise("after").alias("set"))
    return reports.split_sets(orders).select("question_id", F.col("before.k").alias("before_key"), F.col("after.k").alias("after_key"))


@query("code_examples", rep_sql("SELECT code, idx, place FROM (SELECT code, idx, CAST(row_number() OVER (PARTITION BY code ORDER BY idx) AS INT) AS place FROM (SELECT idx, 'e' || idx % 3 AS code FROM rep WHERE has_verification AND idx % 6 <> 0)) WHERE place <= 10"))
def code_examples(spark, d):
    own = repair_records(spark, d).select("idx", F.col("verification")["stage2_failed_evidence"].alias("codes"))
    return reports.examples_by_code(own.where("codes IS NOT NULL"), "codes", 10, ("idx",)).select("code", "idx", "place")


@query("question_records", "SELECT printf('booksql_%06d', row_number() OVER (ORDER BY o_orderkey) - 1) AS question_id, 'ledger' AS db_id, 'total of ' || o_custkey AS question, 'select ' || o_orderkey AS gold_sql, o_orderpriority AS level, CASE o_orderkey % 3 WHEN 0 THEN 'validation' WHEN 1 THEN 'train' ELSE 'test' END AS split FROM orders")
def question_records(spark, d):
    key = F.col("o_orderkey")
    source = table(spark, d, "orders").orderBy("o_orderkey").select(F.concat(F.lit("total of "), "o_custkey").alias("Query"), F.concat(F.lit("select "), "o_orderkey").alias("SQL"), F.col("o_orderpriority").alias("Levels"), F.when(key % 3 == 0, F.when(key % 2 == 0, " Dev").otherwise("val")).when(key % 3 == 1, "TRAIN").otherwise("test").alias("split"))
    return records.question_records(source, "ledger")


@query("catalog_columns", "SELECT table_name AS \"table\", CAST(ordinal_position - 1 AS INT) AS place, column_name AS \"column\", column_name IN ('n_nationkey', 'r_regionkey') AS primary_key FROM information_schema.columns WHERE table_name IN ('nation', 'region')")
def catalog_columns(spark, d):
    found = records.columns_of_tables({t: table(spark, d, t) for t in ("nation", "region")}, {"nation": "n_nationkey", "region": "r_regionkey"})
    return found.drop("type")


@query("integrity_orphans", "SELECT l_partkey AS key, CAST(count(*) AS BIGINT) AS n FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 10 <> 0) GROUP BY 1")
def integrity_orphans(spark, d):
    from ledgerlens.plans.fixtures import orphans

    return orphans(table(spark, d, "lineitem"), "l_partkey", table(spark, d, "part").where("p_partkey % 10 <> 0"), "p_partkey")


@query("support_probe", "WITH " + "led AS (SELECT l_extendedprice AS Amount, CASE l_returnflag WHEN 'R' THEN 'bill' WHEN 'A' THEN 'deposit' ELSE 'invoice' END AS tt, CAST(l_shipdate AS DATE) AS td FROM lineitem) SELECT tt AS Transaction_TYPE, CAST(count(*) AS BIGINT) AS n FROM led WHERE tt IN ('bill', 'invoice') AND td BETWEEN DATE '1995-01-01' AND DATE '1996-12-31' GROUP BY 1")
def support_probe(spark, d):
    from ledgerlens.plans.fixtures import supported_rows

    needs = {"literals": {"Transaction_TYPE": ["bill", "invoice"]}, "from": "1995-01-01", "to": "1996-12-31"}
    return supported_rows(ledger_lines(spark, d), needs, "Transaction_DATE").groupBy("Transaction_TYPE").agg(F.count("*").alias("n"))
