"""Registered queries over ledger lines and evaluation records, each with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions import scalars as S
from ledgerlens.operators import dataflow, metrics, reports
from ledgerlens.sources.ledger import EV_SQL, LED_SQL, A, B, evaluation_records, ledger_lines, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Reports are made as of this day, never today.
AS_OF = "1998-06-24"


def query(name: str, sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


def ev_sql(body: str) -> str:
    return f"WITH {EV_SQL} {body}"


def led_sql(body: str) -> str:
    return f"WITH {LED_SQL} {body}"


RATE0 = "coalesce(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0), 0.0)"
RATEN = "CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0)"


def r0(a: str, b: str) -> str:
    return RATE0.format(a=a, b=b)


def rn(a: str, b: str) -> str:
    return RATEN.format(a=a, b=b)


def n_if(test: str) -> str:
    return f"CAST(count(*) FILTER (WHERE {test}) AS BIGINT)"


EXECUTION = "SELECT a AS group_a, b AS group_b, c AS group_c, d AS group_d, a + b + c AS evaluated, {ex} AS execution_accuracy, {va} AS valid_sql_rate, {wr} AS executable_wrong_rate FROM (SELECT {a} AS a, {b} AS b, {c} AS c, {d} AS d FROM {src})"


def execution_sql(source: str, group: str) -> str:
    names = {k: n_if(f"{group} = '{v}'") for k, v in (("a", "A_correct_executable"), ("b", "B_wrong_executable"), ("c", "C_non_executable"), ("d", "D_ambiguous"))}
    return EXECUTION.format(ex=r0("a", "a + b + c"), va=r0("a + b", "a + b + c"), wr=r0("b", "a + b + c"), src=source, **names)


@query("execution_metrics", ev_sql(execution_sql("ev", "before_group")))
def execution_metrics(spark, d):
    return metrics.execution_metrics(evaluation_records(spark, d), "before_group")


FLAGS_SQL = "flags AS (SELECT o_orderkey AS idx, o_orderkey % 19 = 0 AS ge, o_orderkey % 11 = 0 AS xe, o_orderkey % 9 = 0 AS gn, o_orderkey % 10 = 0 AS xn, o_orderkey % 3 <> 0 AS m FROM orders)"
GROUP_SQL = "CASE WHEN ge THEN 'D_ambiguous' {strict} WHEN xe THEN 'C_non_executable' WHEN m THEN 'A_correct_executable' ELSE 'B_wrong_executable' END"
STRICT_SQL = "WHEN NOT xe AND (gn OR xn) THEN 'D_ambiguous'"


def flags(spark, d):
    key = F.col("o_orderkey")
    return table(spark, d, "orders").select(key.alias("idx"), (key % 19 == 0).alias("ge"), (key % 11 == 0).alias("xe"), (key % 9 == 0).alias("gn"), (key % 10 == 0).alias("xn"), (key % 3 != 0).alias("m"))


def grouped(spark, d, strict):
    return flags(spark, d).withColumn("g", metrics.group_of(*[F.col(c) for c in ("ge", "xe", "gn", "xn", "m")], strict=strict))


@query("execution_metrics_strict", f"WITH {FLAGS_SQL}, s AS (SELECT {GROUP_SQL.format(strict=STRICT_SQL)} AS g FROM flags) " + execution_sql("s", "g"))
def execution_metrics_strict(spark, d):
    return metrics.execution_metrics(grouped(spark, d, True), "g")


@query("group_assignment", f"WITH {FLAGS_SQL} SELECT idx, {GROUP_SQL.format(strict='')} AS evaluation_group, concat_ws('; ', CASE WHEN ge THEN 'gold error' END, CASE WHEN xe THEN 'generated error' END, CASE WHEN gn AND xn THEN 'both empty' WHEN gn OR xn THEN 'one empty' END) AS flags FROM flags")
def group_assignment(spark, d):
    notes = F.concat_ws("; ", F.when(F.col("ge"), "gold error"), F.when(F.col("xe"), "generated error"), F.when(F.col("gn") & F.col("xn"), "both empty").when(F.col("gn") | F.col("xn"), "one empty"))
    return grouped(spark, d, False).select("idx", F.col("g").alias("evaluation_group"), notes.alias("flags"))


@query("slowest_rows_topk", ev_sql("SELECT question_id, seconds FROM ev ORDER BY seconds DESC, question_id LIMIT 10"))
def slowest_rows_topk(spark, d):
    return evaluation_records(spark, d).select("question_id", "seconds").orderBy(F.desc("seconds"), "question_id").limit(10)


def runs(spark, d):
    return table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("at"), F.col("o_totalprice").alias("price"))


@query("dedupe_first", "SELECT o_custkey AS k, min(o_orderkey) AS at, min_by(o_totalprice, o_orderkey) AS price FROM orders GROUP BY 1")
def dedupe_first(spark, d):
    return dataflow.dedupe(runs(spark, d), "k", "at")


@query("dedupe_last", "SELECT o_custkey AS k, max(o_orderkey) AS at, max_by(o_totalprice, o_orderkey) AS price FROM orders GROUP BY 1")
def dedupe_last(spark, d):
    return dataflow.dedupe(runs(spark, d), "k", "at", "last")


@query("histogram_with_null", ev_sql("SELECT answers_question, CAST(count(*) AS BIGINT) AS n FROM ev GROUP BY 1"))
def histogram_with_null(spark, d):
    return evaluation_records(spark, d).groupBy("answers_question").agg(F.count("*").alias("n"))


def halves(spark, d):
    ev = evaluation_records(spark, d)
    before = ev.where("idx % 4 <> 0").select("question_id", "before_group")
    return before, ev.where("idx % 3 <> 0").select("question_id", "after_group")


HALVES = "b AS (SELECT question_id, before_group FROM ev WHERE idx % 4 <> 0), a AS (SELECT question_id, after_group FROM ev WHERE idx % 3 <> 0)"


@query("before_after_join", f"WITH {EV_SQL}, {HALVES} SELECT question_id, before_group, after_group FROM b JOIN a USING (question_id)")
def before_after_join(spark, d):
    before, after = halves(spark, d)
    return before.join(after, "question_id")


@query("joined_group_d_filter", f"WITH {EV_SQL}, {HALVES} SELECT question_id, before_group, after_group FROM b JOIN a USING (question_id) WHERE before_group <> 'D_ambiguous' AND after_group <> 'D_ambiguous'")
def joined_group_d_filter(spark, d):
    return before_after_join(spark, d).where("before_group <> 'D_ambiguous' AND after_group <> 'D_ambiguous'")


@query("dev_excluded_complement", ev_sql("SELECT question_id FROM ev WHERE idx NOT IN (SELECT idx FROM ev WHERE idx % 8 = 0)"))
def dev_excluded_complement(spark, d):
    ev = evaluation_records(spark, d).select("question_id", "idx")
    return dataflow.complement(ev, ev.where("idx % 8 = 0").select("question_id"), "question_id").select("question_id")


@query("resume_pending", ev_sql("SELECT question_id, mode FROM ev e WHERE NOT EXISTS (SELECT 1 FROM ev x WHERE x.idx % 5 = 0 AND x.question_id = e.question_id AND x.answers_question IS NOT DISTINCT FROM e.answers_question)"))
def resume_pending(spark, d):
    ev = evaluation_records(spark, d)
    done = ev.where("idx % 5 = 0").select("question_id", "answers_question")
    return dataflow.pending(ev, done, ["question_id", "answers_question"]).select("question_id", "mode")


def cache_pair(spark, d):
    ev = evaluation_records(spark, d).withColumn("question_hash", S.hash16(F.col("mode")))
    cache = ev.where("idx % 50 = 0").select("question_id", F.when(F.col("idx") % 100 == 0, F.col("question_hash")).otherwise(F.lit("x")).alias("question_hash"), F.col("idx").alias("at"), F.format_string("intent %d", "idx").alias("intent"))
    return ev, cache


CACHE = "h AS (SELECT *, substr(sha256(mode), 1, 16) AS question_hash FROM ev), c AS (SELECT question_id, CASE WHEN idx % 100 = 0 THEN question_hash ELSE 'x' END AS question_hash, idx AS seen, printf('intent %d', idx) AS intent FROM h WHERE idx % 50 = 0)"


@query("intent_cache_semi_id", f"WITH {EV_SQL}, {CACHE} SELECT question_id FROM h WHERE question_id IN (SELECT question_id FROM c)")
def intent_cache_semi_id(spark, d):
    return dataflow.cached_rows(*cache_pair(spark, d), by="id").select("question_id")


@query("intent_cache_either", f"WITH {EV_SQL}, {CACHE} SELECT question_id FROM h WHERE question_id IN (SELECT question_id FROM c) OR question_hash IN (SELECT question_hash FROM c)")
def intent_cache_either(spark, d):
    return dataflow.cached_rows(*cache_pair(spark, d), by="either").select("question_id")


@query("intent_lookup_fallback", f"WITH {EV_SQL}, {CACHE} SELECT h.question_id, coalesce(i.v, g.v) AS intent FROM h LEFT JOIN (SELECT question_id, max_by(intent, seen) AS v FROM c GROUP BY 1) i ON i.question_id = h.question_id LEFT JOIN (SELECT question_hash, max_by(intent, seen) AS v FROM c GROUP BY 1) g ON g.question_hash = h.question_hash")
def intent_lookup_fallback(spark, d):
    return dataflow.looked_up(*cache_pair(spark, d), value="intent", order="at").select("question_id", "intent")


@query("routing_split", ev_sql("SELECT CASE WHEN before_group IN ('A_correct_executable', 'B_wrong_executable') THEN 'verify' WHEN before_group = 'C_non_executable' THEN 'repair' ELSE 'skip' END AS route, CAST(count(*) AS BIGINT) AS n FROM ev GROUP BY 1"))
def routing_split(spark, d):
    return evaluation_records(spark, d).groupBy(dataflow.route(F.col("before_group")).alias("route")).agg(F.count("*").alias("n"))


REJ, COR = "answers_question IS NOT DISTINCT FROM false", "'A_correct_executable'"
SUMMARY_COUNTS = ", ".join(f"{n_if(t)} AS {n}" for n, t in (
    ("total", "true"), ("was_correct", f"before_group = {COR}"), ("now_correct", f"after_group = {COR}"), ("rejected", REJ), ("applied", "repaired"),
    ("applied_wrong", "repaired AND before_group = 'B_wrong_executable'"), ("corrected", f"repaired AND before_group <> {COR} AND after_group = {COR}"),
    ("corrupted", f"repaired AND before_group = {COR} AND after_group <> {COR}"), ("touched_correct", f"repaired AND before_group = {COR}"),
    ("c_to_a", f"repaired AND before_group = 'C_non_executable' AND after_group = {COR}")))


@query("repair_summary", ev_sql(f"SELECT *, {r0('was_correct', 'total')} AS original_accuracy, {r0('now_correct', 'total')} AS final_accuracy, {r0('rejected', 'total')} AS rejection_rate, {r0('applied', 'total')} AS application_rate, {r0('corrected', 'applied')} AS repair_precision, {r0('corrupted', 'touched_correct')} AS corruption_rate, 1.0 - {r0('corrupted', 'was_correct')} AS preservation_rate, corrected - corrupted AS net_gain, {r0('probes', 'total')} AS avg_probes, {r0('pr', 'rejected')} AS avg_probes_rejected FROM (SELECT {SUMMARY_COUNTS}, CAST(sum(probes_used) AS BIGINT) AS probes, CAST(sum(CASE WHEN {REJ} THEN probes_used ELSE 0 END) AS BIGINT) AS pr FROM ev WHERE before_group <> 'D_ambiguous')").replace("SELECT *, coalesce", "SELECT * EXCLUDE (pr), coalesce"))
def repair_summary(spark, d):
    return metrics.repair_summary(evaluation_records(spark, d))


ASA_SQL = "r AS (SELECT idx, ex, CASE WHEN ex = 1 THEN inv END AS inv_used, CASE WHEN ex = 0 THEN 0 WHEN ex = 1 THEN inv END AS asa_strict, CASE WHEN ex IS NOT NULL THEN CASE WHEN ex = 1 AND inv = 1 THEN 1 ELSE 0 END END AS asa_lower, CASE WHEN ex IS NULL THEN 'missing_execution_match' WHEN ex = 1 AND inv IS NULL THEN 'inv_not_evaluable' END AS reason FROM (SELECT *, CASE before_group WHEN 'A_correct_executable' THEN 1 WHEN 'B_wrong_executable' THEN 0 END AS ex FROM ev))"


def asa_scored(spark, d):
    group = F.col("before_group")
    return metrics.asa_rows(evaluation_records(spark, d), F.when(group == A, 1).when(group == B, 0), F.col("inv"))


@query("asa_row_scores", f"WITH {EV_SQL}, {ASA_SQL} SELECT idx, CAST(ex AS INT) AS ex, inv_used, asa_strict, asa_lower, asa_strict IS NOT NULL AS available, reason FROM r")
def asa_row_scores(spark, d):
    return asa_scored(spark, d).select("idx", "ex", "inv_used", "asa_strict", "asa_lower", "available", "reason")


@query("asa_metrics", f"WITH {EV_SQL}, {ASA_SQL} SELECT *, {r0('ex_pass', 'ex_known')} AS ex_rate, {r0('strict_pass', 'available')} AS asa_strict_rate, {r0('lower_pass', 'ex_known')} AS asa_lower_rate, {r0('false_pass', 'inv_known')} AS fper, {r0('inv_known', 'ex_pass')} AS evaluability FROM (SELECT {n_if('true')} AS total, {n_if('ex IS NOT NULL')} AS ex_known, {n_if('ex = 1')} AS ex_pass, {n_if('asa_strict IS NOT NULL')} AS available, {n_if('asa_strict = 1')} AS strict_pass, {n_if('asa_lower = 1')} AS lower_pass, {n_if('ex = 1 AND inv_used = 0')} AS false_pass, {n_if('ex = 1 AND inv_used IS NOT NULL')} AS inv_known FROM r)")
def asa_metrics(spark, d):
    return metrics.asa_metrics(asa_scored(spark, d))


@query("fcr_code_histogram", ev_sql("SELECT code, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(list_filter([CASE WHEN idx % 2 = 0 THEN 'posting_side_reversal' END, CASE WHEN idx % 3 = 0 THEN 'incompatible_financial_output' END], lambda x: x IS NOT NULL)) AS code FROM ev) GROUP BY 1"))
def fcr_code_histogram(spark, d):
    codes = F.array_compact(F.array(F.when(F.col("idx") % 2 == 0, "posting_side_reversal"), F.when(F.col("idx") % 3 == 0, "incompatible_financial_output")))
    return evaluation_records(spark, d).select(F.explode(codes).alias("code")).groupBy("code").agg(F.count("*").alias("n"))


CONF = f"SELECT {n_if(f'w AND {REJ}')} AS tp, {n_if(f'NOT w AND {REJ}')} AS fp, {n_if(f'w AND NOT ({REJ})')} AS fn, {n_if(f'NOT w AND NOT ({REJ})')} AS tn FROM (SELECT *, before_group = 'B_wrong_executable' AS w FROM ev WHERE before_group IN ('A_correct_executable', 'B_wrong_executable'))"
PRF = f"{rn('tp', 'tp + fp')} AS precision, {rn('tp', 'tp + fn')} AS recall, {rn('2 * tp', '2 * tp + fp + fn')} AS f1"


@query("verifier_confusion", ev_sql(f"SELECT *, {PRF} FROM ({CONF})"))
def verifier_confusion(spark, d):
    return metrics.confusion(evaluation_records(spark, d))


MODES = f"m AS (SELECT mode, \"rows\", \"right\", undecided, avg_probes, {rn('\"right\"', '\"rows\"')} AS accuracy, {PRF} FROM (SELECT mode, {n_if('true')} AS \"rows\", {n_if('(answers_question AND NOT w) OR (NOT answers_question AND w)')} AS \"right\", {n_if('answers_question IS NULL')} AS undecided, {n_if('NOT answers_question AND w')} AS tp, {n_if('NOT answers_question AND NOT w')} AS fp, {n_if(f'w AND NOT ({REJ})')} AS fn, avg(probes_used) AS avg_probes FROM (SELECT *, before_group = 'B_wrong_executable' AS w FROM ev WHERE before_group IN ('A_correct_executable', 'B_wrong_executable')) GROUP BY mode))"


@query("verifier_mode_stats", f"WITH {EV_SQL}, {MODES} SELECT * FROM m")
def verifier_mode_stats(spark, d):
    return metrics.mode_stats(evaluation_records(spark, d))


@query("probe_gain_cost", f"WITH {EV_SQL}, {MODES} SELECT m.mode, m.accuracy - b.accuracy AS gain, CASE WHEN m.mode <> 'none' THEN 100 * (m.accuracy - b.accuracy) / nullif(m.avg_probes - b.avg_probes, 0) END AS gain_per_probe FROM m, (SELECT * FROM m WHERE mode = 'none') b")
def probe_gain_cost(spark, d):
    return metrics.probe_gain(metrics.mode_stats(evaluation_records(spark, d)))


def steps():
    c = F.col
    return {"hard": c("inv") == 0, "caught": c("answers_question") == F.lit(False), "actionable": c("probes_used") > 0, "attempted": c("idx") % 3 == 0, "generated": c("idx") % 9 != 0, "fixed": c("repaired"), "preserved": c("after_group") == A}


FUNNEL = ["inv = 0", "answers_question = false", "probes_used > 0", "idx % 3 = 0", "idx % 9 <> 0", "repaired", f"after_group = {COR}"]


@query("attribution_funnel", ev_sql("SELECT " + ", ".join(n_if(" AND ".join(FUNNEL[: k + 1])) + f" AS {name}" for k, name in enumerate(metrics.FUNNEL)) + " FROM ev"))
def attribution_funnel(spark, d):
    return metrics.funnel(evaluation_records(spark, d), steps())


@query("primary_bottleneck", ev_sql("SELECT CASE WHEN inv IS DISTINCT FROM 0 THEN 'non_cohort' WHEN answers_question THEN 'missed' WHEN answers_question IS NULL THEN 'abstained' WHEN probes_used = 0 THEN 'not_actionable' WHEN NOT repaired THEN 'not_attempted' WHEN after_group <> 'A_correct_executable' THEN 'not_fixed' ELSE 'fixed' END AS bottleneck, CAST(count(*) AS BIGINT) AS n FROM ev GROUP BY 1"))
def primary_bottleneck(spark, d):
    c = F.col
    reason = metrics.bottleneck([("non_cohort", ~c("inv").eqNullSafe(0)), ("missed", c("answers_question")), ("abstained", c("answers_question").isNull()), ("not_actionable", c("probes_used") == 0), ("not_attempted", ~c("repaired")), ("not_fixed", c("after_group") != A)], "fixed")
    return evaluation_records(spark, d).groupBy(reason.alias("bottleneck")).agg(F.count("*").alias("n"))


@query("before_after_breakdown", ev_sql("SELECT before_group, after_group, repaired, CAST(count(*) AS BIGINT) AS n FROM ev GROUP BY ALL"))
def before_after_breakdown(spark, d):
    return evaluation_records(spark, d).groupBy("before_group", "after_group", "repaired").agg(F.count("*").alias("n"))


@query("status_execution_crosstab", ev_sql("SELECT mode, " + ", ".join(f"{n_if(f'before_group LIKE {chr(39)}{g}%{chr(39)}')} AS {g.lower()}" for g in "ABCD") + " FROM ev GROUP BY mode"))
def status_execution_crosstab(spark, d):
    ev = evaluation_records(spark, d).withColumn("g", F.lower(F.substring("before_group", 1, 1)))
    return ev.groupBy("mode").pivot("g", ["a", "b", "c", "d"]).agg(F.count(F.lit(1))).na.fill(0)


@query("ablation_delta", ev_sql(f"SELECT mode AS key, x AS ex_accuracy, x - (SELECT {rn(f'count(*) FILTER (WHERE before_group = {COR})', 'count(*)')} FROM ev WHERE mode = 'hybrid') AS delta_ex_accuracy FROM (SELECT mode, {rn(f'count(*) FILTER (WHERE before_group = {COR})', 'count(*)')} AS x FROM ev GROUP BY mode)"))
def ablation_delta(spark, d):
    share = S.rate(F.count_if(F.col("before_group") == A), F.count("*"), None)
    variants = evaluation_records(spark, d).groupBy(F.col("mode").alias("key")).agg(share.alias("ex_accuracy"))
    return reports.against_full(variants, full="hybrid")


@query("reward_matrix", ev_sql(f"SELECT idx, CAST(CASE WHEN after_group = 'C_non_executable' THEN -1 WHEN before_group = {COR} THEN CASE WHEN after_group = {COR} THEN 0 ELSE -2 END WHEN after_group = {COR} THEN 2 ELSE -0.25 END + CASE WHEN after_group = {COR} AND inv = 1 THEN 0.5 ELSE 0 END AS DOUBLE) AS reward FROM ev"))
def reward_matrix(spark, d):
    c = F.col
    return evaluation_records(spark, d).select("idx", metrics.reward(c("after_group") != "C_non_executable", c("before_group") == A, c("after_group") == A, c("inv") == 1).alias("reward"))


@query("few_shot_selection", "SELECT l AS level, min(k) AS idx FROM (SELECT o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' ELSE 'hard' END AS l FROM orders) GROUP BY 1")
def few_shot_selection(spark, d):
    level = F.when(F.col("o_orderkey") % 3 == 0, "easy").when(F.col("o_orderkey") % 3 == 1, "medium").otherwise("hard")
    return dataflow.dedupe(table(spark, d, "orders").select(level.alias("level"), F.col("o_orderkey").alias("idx")), "level", "idx").select("level", "idx")


@query("final_sql_selection", "SELECT o_orderkey AS idx, coalesce(r, o) AS final_sql, r IS NOT NULL AS repaired FROM (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'select ' || o_orderkey END AS r, 'select ' || o_custkey AS o FROM orders)")
def final_sql_selection(spark, d):
    key = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(key.alias("idx"), F.when(key % 3 == 0, F.concat(F.lit("select "), key)).when(key % 3 == 1, " ").alias("r"), F.concat(F.lit("select "), "o_custkey").alias("o"))
    return rows.select("idx", S.filled(F.col("r"), F.col("o")).alias("final_sql"), S.filled(F.col("r")).isNotNull().alias("repaired"))


@query("sql_hash16", "SELECT o_orderkey AS idx, substr(sha256('select ' || o_custkey), 1, 16) AS h FROM orders")
def sql_hash16(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("idx"), S.hash16(F.concat(F.lit("select "), "o_custkey")).alias("h"))


@query("normalise_sql", "SELECT p_partkey AS idx, 'select ' || lower(p_name) || ' from t' AS s FROM part")
def normalise_sql(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("idx"), S.plain_sql(F.concat(F.lit("  SELECT \n "), "p_name", F.lit("  FROM\tT ; ;"))).alias("s"))


@query("extract_sql", "SELECT o_orderkey AS idx, CASE o_orderkey % 4 WHEN 3 THEN '' ELSE 'SELECT ' || o_orderkey END AS s FROM orders")
def extract_sql(spark, d):
    key = F.col("o_orderkey")
    sql = F.concat(F.lit("SELECT "), key)
    answer = F.when(key % 4 == 0, F.concat(F.lit("Here:\n```sql\n"), sql, F.lit("\n```\nand ```x```"))).when(key % 4 == 1, F.concat(F.lit("```\n"), sql, F.lit("\n``` ok"))).when(key % 4 == 2, F.concat(F.lit("The query is "), sql, F.lit("; done"))).otherwise("no query")
    return table(spark, d, "orders").select(key.alias("idx"), S.sql_from_answer(answer).alias("s"))


@query("temporal_predicate_test", "SELECT p_partkey AS idx, regexp_matches(lower(p_name), '(date|time|year|month|day|week|quarter|fiscal|period|posted|posting|created)') AS loose FROM part")
def temporal_predicate_test(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("idx"), S.is_temporal(F.col("p_name")).alias("loose"))


@query("grouped_question_gate", "SELECT o_orderkey AS idx, o_orderkey % 3 <> 2 AS grouped FROM orders")
def grouped_question_gate(spark, d):
    key = F.col("o_orderkey")
    question = F.when(key % 3 == 0, "Total sales by customer").when(key % 3 == 1, "Which  vendor was paid").otherwise("What is the total of bills paid hourly")
    return table(spark, d, "orders").select(key.alias("idx"), S.asks_for_groups(question).alias("grouped"))


@query("bag_equal_unordered", "SELECT 't:' || l_returnflag AS c0, CAST(count(*) AS BIGINT) AS surplus FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1")
def bag_equal_unordered(spark, d):
    lines = table(spark, d, "lineitem")
    return dataflow.bag_difference(lines.select("l_returnflag"), lines.where("l_linestatus <> 'F'").select(F.col("l_returnflag").alias("other")))


@query("double_entry_imbalance", led_sql("SELECT Transaction_ID, round(sum(Debit), 2) AS debit, round(sum(Credit), 2) AS credit FROM led GROUP BY 1 HAVING round(coalesce(sum(Debit), 0), 6) <> round(coalesce(sum(Credit), 0), 6)"))
def double_entry_imbalance(spark, d):
    sums = ledger_lines(spark, d).groupBy("Transaction_ID").agg(F.coalesce(F.sum("Debit"), F.lit(0.0)).alias("x"), F.coalesce(F.sum("Credit"), F.lit(0.0)).alias("y"))
    return sums.where(dataflow.round6(F.col("x")) != dataflow.round6(F.col("y"))).select("Transaction_ID", F.round("x", 2).alias("debit"), F.round("y", 2).alias("credit"))


@query("template_preflight", led_sql("SELECT Transaction_TYPE, CAST(count(DISTINCT Transaction_ID) AS BIGINT) AS transactions, CAST(count(*) FILTER (WHERE AR_paid = 'paid') AS BIGINT) AS paid, round(sum(Amount), 2) AS amount FROM led GROUP BY 1"))
def template_preflight(spark, d):
    return ledger_lines(spark, d).groupBy("Transaction_TYPE").agg(F.count_distinct("Transaction_ID").alias("transactions"), F.count_if(F.col("AR_paid") == "paid").alias("paid"), F.round(F.sum("Amount"), 2).alias("amount"))


# Ledger questions, in SQL that both engines read alike.
LEDGER_SQL = {
    "top_account_ytd": f"SELECT Account, round(sum(Debit), 2) AS total FROM led WHERE Transaction_DATE BETWEEN DATE '1998-01-01' AND DATE '{AS_OF}' GROUP BY Account ORDER BY total DESC, Account LIMIT 1",
    "income_minus_expense": "SELECT round(sum(Credit) - sum(Debit), 2) AS net FROM led",
    "open_balance_by_customer": "SELECT Customers, round(sum(CASE WHEN AR_paid = '--' THEN Amount ELSE 0 END), 2) AS open_balance FROM led GROUP BY Customers",
    "count_distinct_txn": "SELECT Transaction_TYPE, count(DISTINCT Transaction_ID) AS n FROM led GROUP BY Transaction_TYPE",
    "avg_bill_by_vendor": "SELECT Vendor, round(avg(Amount), 4) AS average FROM led WHERE Transaction_TYPE = 'bill' GROUP BY Vendor",
    "max_invoice": "SELECT max(Amount) AS largest, min(Amount) AS smallest FROM led WHERE Transaction_TYPE = 'invoice'",
    "qty_by_product": "SELECT Product_Service, sum(Quantity) AS quantity FROM led GROUP BY Product_Service",
    "prior_month_sales": "SELECT round(sum(Amount), 2) AS sales, count(*) AS n FROM led WHERE Transaction_DATE BETWEEN DATE '1998-05-01' AND DATE '1998-05-31' AND Transaction_TYPE = 'invoice'",
    "customers_having_total": "SELECT Customers, count(*) AS n FROM led GROUP BY Customers HAVING count(*) > 30",
    "payment_exists": "SELECT CAST(EXISTS (SELECT 1 FROM led WHERE AR_paid = 'paid' AND Amount > 100000) AS INT) AS paid",
    "case_conditional_sum": "SELECT Account, round(sum(CASE WHEN Transaction_TYPE = 'bill' THEN -Amount ELSE Amount END), 2) AS net FROM led GROUP BY Account",
    "instr_account_filter": "SELECT count(*) AS n FROM led WHERE instr(lower(Account), 'e') > 0",
    "distinct_accounts": "SELECT DISTINCT Account, Transaction_TYPE FROM led",
    "union_of_parties": "SELECT Customers AS party FROM led UNION SELECT Vendor FROM led",
}


def _ledger_query(sql: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return spark.sql(sql.replace(" FROM led", " FROM {led}"), led=ledger_lines(spark, d))

    return run


for _name, _sql in LEDGER_SQL.items():
    query(_name, led_sql(_sql))(_ledger_query(_sql))


@query("submission_rows", "SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS id, 'select ' || o_orderkey AS pred_sql FROM orders")
def submission_rows(spark, d):
    from ledgerlens.sources.records import submission, with_question_ids

    rows = with_question_ids(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", "", 1)
    return submission(rows.select(F.col("question_id").cast("long").alias("id"), F.concat(F.lit("select "), "o_orderkey").alias("pred_sql")))


@query("common_denominator", ev_sql("SELECT count(DISTINCT n) <= 1 AS common FROM (SELECT count(*) AS n FROM ev GROUP BY mode)"))
def common_denominator(spark, d):
    return evaluation_records(spark, d).groupBy("mode").agg(F.count("*").alias("n")).agg((F.count_distinct("n") <= 1).alias("common"))


@query("enumerated_order", ev_sql("SELECT mode, CAST(CASE mode WHEN 'none' THEN 1 WHEN 'hybrid' THEN 2 ELSE 3 END AS BIGINT) AS place, CAST(count(*) AS BIGINT) AS n FROM ev GROUP BY mode ORDER BY place"))
def enumerated_order(spark, d):
    order = F.array(*[F.lit(m) for m in ("none", "hybrid", "probe")])
    return evaluation_records(spark, d).groupBy("mode").agg(F.count("*").alias("n")).withColumn("place", F.array_position(order, F.col("mode"))).orderBy("place")


@query("predicate_symmetric_difference", "SELECT o_orderkey AS idx, CASE WHEN o_orderkey % 2 = 0 THEN ['b', 'c'] ELSE ['a'] END AS changed FROM orders")
def predicate_symmetric_difference(spark, d):
    a = F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a")))
    b = F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit("a"), F.lit("c"))).otherwise(F.array().cast("array<string>"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("idx"), F.array_union(F.array_except(a, b), F.array_except(b, a)).alias("changed"))


@query("verdict_normalisation", "SELECT o_orderkey AS idx, CASE o_orderkey % 3 WHEN 0 THEN true WHEN 1 THEN CASE WHEN o_orderkey % 2 = 0 THEN false END END AS answers, o_orderkey % 2 = 0 AS flag FROM orders")
def verdict_normalisation(spark, d):
    from ledgerlens.plans.verdicts import truth, verdict

    key = F.col("o_orderkey")
    evidence = F.when(key % 3 == 0, " Sufficient").when(key % 3 == 1, "insufficient").otherwise("unclear")
    mismatch = F.when(key % 2 == 0, "computation_logic_error").otherwise("other")
    return table(spark, d, "orders").select(key.alias("idx"), verdict(evidence, mismatch).alias("answers"), truth(F.when(key % 2 == 0, "Yes").otherwise(" no ")).alias("flag"))


@query("profile_status", "SELECT o_orderkey AS idx, CASE o_orderkey % 4 WHEN 0 THEN 'OK' WHEN 1 THEN 'PARSE_ERROR' WHEN 2 THEN 'EMPTY' END AS status FROM orders")
def profile_status(spark, d):
    from ledgerlens.plans.verdicts import profile_status as status

    key = F.col("o_orderkey")
    text = F.when(key % 4 == 0, '{"status": "ok"}').when(key % 4 == 1, '{"profile": {"status": "parse_error"}}').when(key % 4 == 2, "Tables: t\n[Status] EMPTY\n").otherwise("nothing")
    return table(spark, d, "orders").select(key.alias("idx"), status(text).alias("status"))
