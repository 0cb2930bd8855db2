"""Aggregates over evaluation records; each is one pass of conditional counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.scalars import rate
from ledgerlens.sources.ledger import A, B, C, D


def count_if(test: Column) -> Column:
    return F.count_if(F.coalesce(test, F.lit(False)))


def group_of(gold_error: Column, generated_error: Column, gold_empty: Column, generated_empty: Column, match: Column, strict: bool = False) -> Column:
    """Evaluation group: gold errors are ambiguous; so are empty results in strict mode; then errors, matches, the rest."""
    out = F.when(gold_error, D)
    if strict:
        out = out.when(~generated_error & (gold_empty | generated_empty), D)
    return out.when(generated_error, C).when(match, A).otherwise(B)


def execution_metrics(df: DataFrame, group: str) -> DataFrame:
    """Counts of the groups, and rates over rows that are not ambiguous."""
    g = F.col(group)
    counted = df.agg(*[count_if(g == v).alias(n) for n, v in (("group_a", A), ("group_b", B), ("group_c", C), ("group_d", D))])
    n = F.col("group_a") + F.col("group_b") + F.col("group_c")
    return counted.select("group_a", "group_b", "group_c", "group_d", n.alias("evaluated"), rate(F.col("group_a"), n).alias("execution_accuracy"), rate(F.col("group_a") + F.col("group_b"), n).alias("valid_sql_rate"), rate(F.col("group_b"), n).alias("executable_wrong_rate"))


def repair_summary(df: DataFrame) -> DataFrame:
    """Coverage, effectiveness, safety and movement of repairs, and probes, over non-ambiguous rows."""
    was, now, fixed = F.col("before_group"), F.col("after_group"), F.col("repaired")
    rejected = F.col("answers_question").eqNullSafe(False)
    used = df.where(was != D)
    counted = used.agg(
        F.count("*").alias("total"),
        count_if(was == A).alias("was_correct"),
        count_if(now == A).alias("now_correct"),
        count_if(rejected).alias("rejected"),
        count_if(fixed).alias("applied"),
        count_if(fixed & (was == B)).alias("applied_wrong"),
        count_if(fixed & (was != A) & (now == A)).alias("corrected"),
        count_if(fixed & (was == A) & (now != A)).alias("corrupted"),
        count_if(fixed & (was == A)).alias("touched_correct"),
        count_if(fixed & (was == C) & (now == A)).alias("c_to_a"),
        F.sum("probes_used").alias("probes"),
        F.sum(F.when(rejected, F.col("probes_used")).otherwise(0)).alias("probes_rejected"),
    )
    c = F.col
    return counted.select(
        "total", "was_correct", "now_correct", "rejected", "applied", "applied_wrong", "corrected", "corrupted", "touched_correct", "c_to_a", "probes",
        rate(c("was_correct"), c("total")).alias("original_accuracy"),
        rate(c("now_correct"), c("total")).alias("final_accuracy"),
        rate(c("rejected"), c("total")).alias("rejection_rate"),
        rate(c("applied"), c("total")).alias("application_rate"),
        rate(c("corrected"), c("applied")).alias("repair_precision"),
        rate(c("corrupted"), c("touched_correct")).alias("corruption_rate"),
        (F.lit(1.0) - rate(c("corrupted"), c("was_correct"))).alias("preservation_rate"),
        (c("corrected") - c("corrupted")).alias("net_gain"),
        rate(c("probes"), c("total")).alias("avg_probes"),
        rate(c("probes_rejected"), c("rejected")).alias("avg_probes_rejected"),
    )


def asa_rows(df: DataFrame, ex: Column, inv: Column) -> DataFrame:
    """Accounting accuracy of each row from execution match and invariant (1, 0 or null); the invariant counts only after a match."""
    used = F.when(ex == 1, inv)
    strict = F.when(ex == 0, 0).when((ex == 1) & used.isNotNull(), used)
    lower = F.when(ex.isNotNull(), F.when((ex == 1) & (used == 1), 1).otherwise(0))
    reason = F.when(ex.isNull(), "missing_execution_match").when((ex == 1) & used.isNull(), "inv_not_evaluable")
    return df.withColumns({"ex": ex.cast("int"), "inv_used": used.cast("int"), "asa_strict": strict.cast("int"), "asa_lower": lower.cast("int"), "available": strict.isNotNull(), "reason": reason})


def asa_metrics(df: DataFrame) -> DataFrame:
    c = F.col
    counted = df.agg(
        F.count("*").alias("total"), count_if(c("ex").isNotNull()).alias("ex_known"), count_if(c("ex") == 1).alias("ex_pass"), count_if(c("available")).alias("available"),
        count_if(c("asa_strict") == 1).alias("strict_pass"), count_if(c("asa_lower") == 1).alias("lower_pass"), count_if((c("ex") == 1) & (c("inv_used") == 0)).alias("false_pass"),
        count_if((c("ex") == 1) & c("inv_used").isNotNull()).alias("inv_known"),
    )
    return counted.select("*", rate(c("ex_pass"), c("ex_known")).alias("ex_rate"), rate(c("strict_pass"), c("available")).alias("asa_strict_rate"), rate(c("lower_pass"), c("ex_known")).alias("asa_lower_rate"), rate(c("false_pass"), c("inv_known")).alias("fper"), rate(c("inv_known"), c("ex_pass")).alias("evaluability"))


def confusion(df: DataFrame) -> DataFrame:
    """Verifier against truth over executable rows; anything but an explicit rejection accepts. Rates are null without a denominator."""
    rejected = F.col("answers_question").eqNullSafe(False)
    wrong = F.col("before_group") == B
    counted = df.where(F.col("before_group").isin(A, B)).agg(count_if(wrong & rejected).alias("tp"), count_if(~wrong & rejected).alias("fp"), count_if(wrong & ~rejected).alias("fn"), count_if(~wrong & ~rejected).alias("tn"))
    return counted.select("*", *precision_recall(F.col("tp"), F.col("fp"), F.col("fn")))


def precision_recall(tp: Column, fp: Column, fn: Column) -> list[Column]:
    return [rate(tp, tp + fp, None).alias("precision"), rate(tp, tp + fn, None).alias("recall"), rate(2 * tp, 2 * tp + fp + fn, None).alias("f1")]


def mode_stats(df: DataFrame) -> DataFrame:
    """Verifier quality of each probing mode."""
    said = F.col("answers_question")
    wrong = F.col("before_group") == B
    counted = df.where(F.col("before_group").isin(A, B)).groupBy("mode").agg(
        F.count("*").alias("rows"), count_if((said & ~wrong) | (~said & wrong)).alias("right"), count_if(said.isNull()).alias("undecided"),
        count_if(~said & wrong).alias("tp"), count_if(~said & ~wrong).alias("fp"), count_if(wrong & said.isNotNull() & said | wrong & said.isNull()).alias("fn"), F.avg("probes_used").alias("avg_probes"),
    )
    return counted.select("mode", "rows", "right", "undecided", "avg_probes", rate(F.col("right"), F.col("rows"), None).alias("accuracy"), *precision_recall(F.col("tp"), F.col("fp"), F.col("fn")))


def probe_gain(stats: DataFrame, baseline: str = "none") -> DataFrame:
    """Accuracy gained over the mode without probes, per further probe; null for the baseline itself."""
    base = stats.where(F.col("mode") == baseline).select(F.col("accuracy").alias("_a"), F.col("avg_probes").alias("_p"))
    joined = stats.crossJoin(F.broadcast(base))  # one row
    return joined.select("mode", (F.col("accuracy") - F.col("_a")).alias("gain"), F.when(F.col("mode") != baseline, F.try_divide(100 * (F.col("accuracy") - F.col("_a")), F.col("avg_probes") - F.col("_p"))).alias("gain_per_probe"))


FUNNEL = ("hard", "caught", "actionable", "attempted", "generated", "fixed", "preserved")


def funnel(df: DataFrame, steps: dict[str, Column]) -> DataFrame:
    """How many rows pass each step and all before it."""
    test, counts = F.lit(True), []
    for name, step in steps.items():
        test = test & F.coalesce(step, F.lit(False))
        counts.append(F.count_if(test).alias(name))
    return df.agg(*counts)


def bottleneck(steps: list[tuple[str, Column]], default: str) -> Column:
    """The first reason that holds."""
    out = None
    for name, test in steps:
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise(default)


def reward(valid: Column, was_right: Column, now_right: Column, asa: Column) -> Column:
    """Repair reward: -1 for a query that does not run, -0.25 for one that stays wrong, -2 for a corruption, 2 for a correction; 0.5 more where it matches and the accounting holds."""
    right, was, sound = (F.coalesce(x, F.lit(False)) for x in (now_right, was_right, asa))
    moved = F.when(was & ~right, -2.0).when(~was & right, 2.0).otherwise(0.0)
    return F.when(~F.coalesce(valid, F.lit(False)), -1.0).when(~was & ~right, -0.25).otherwise(moved + F.when(right & sound, 0.5).otherwise(0.0))
