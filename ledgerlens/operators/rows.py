"""Operators on single rows and on the lists that runs are made of: choices, projections, keys, joins and guards."""

from __future__ import annotations

import json
import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.scalars import filled, hash16
from ledgerlens.operators.dataflow import numbered
from ledgerlens.plans.execute import WORKERS, Engine, json_safe, outcomes
from ledgerlens.plans.verdicts import candidate
from ledgerlens.sources.ledger import A, B, C, D
from ledgerlens.sources.scratch import remove, written

# Choices


def subset(df: DataFrame, start: int, size: int, order: str | None = None) -> DataFrame:
    """``size`` rows from a place on, in an order or as they come; places are checked."""
    if start < 0 or size <= 0:
        raise ValueError("a subset begins at 0 or later and has rows")
    placed = numbered(df.orderBy(order) if order else df, "_at")
    return placed.where((F.col("_at") >= start) & (F.col("_at") < start + size)).orderBy("_at").select(*df.columns)


def head(df: DataFrame, most: int | None, order: str) -> DataFrame:
    """The first rows by an order; all without a number, which must be positive."""
    if most is not None and most <= 0:
        raise ValueError("a limit is positive")
    return df.orderBy(order) if most is None else df.orderBy(order).limit(most)


#: Rows up to which a shuffle can follow Python's generator, whose numbers the driver draws.
EXACT_ROWS = 1_000_000


def shuffled(df: DataFrame, key: str, seed: int, most: int | None = None, exact: bool = False) -> DataFrame:
    """Rows in an order that the seed sets: by a hash of the key, or (``exact``, rows in order of the key) as Python's generator would put them."""
    if not exact:
        out = df.orderBy(F.xxhash64(F.lit(seed), key), key)
        return out if most is None else out.limit(most)
    count = df.count()
    if count > EXACT_ROWS:
        raise ValueError(f"an exact shuffle of over {EXACT_ROWS} rows")
    places = list(range(count))
    random.Random(seed).shuffle(places)
    places = places if most is None else places[:most]
    order = df.sparkSession.createDataFrame([(p, n) for n, p in enumerate(places)], "_at long, _to long")
    return numbered(df.orderBy(key), "_at").join(F.broadcast(order), "_at").orderBy("_to").select(*df.columns)


def excluded(group: str = "evaluation_group", flag: str | None = "excluded_from_primary_metrics") -> Column:
    """Rows that primary metrics leave out: flagged, or of group D."""
    marked = F.coalesce(F.col(flag), F.lit(False)) if flag else F.lit(False)
    return marked | F.coalesce(F.col(group) == D, F.lit(False))


def few_shot(df: DataFrame, levels: tuple[str, ...] = ("easy", "medium", "hard"), order: str = "idx") -> DataFrame:
    """The first training record of each level, in the order of the levels; reading fails if one is missing."""
    level = F.lower(F.trim("level"))
    first = df.where((F.lower(F.trim("split")) == "train") & level.isin(*levels)).groupBy(level.alias("_l")).agg(F.min_by(F.struct(*df.columns), order).alias("_r"))
    asked = df.sparkSession.createDataFrame([(n, x) for n, x in enumerate(levels)], "_n int, _l string")
    found = asked.join(first, "_l", "left")
    checked = F.when(F.col("_r").isNotNull(), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("no training record of level "), "_l")).cast("boolean"))
    return found.where(checked).orderBy("_n").select("_r.*")


# Projections


def without_internal(df: DataFrame) -> DataFrame:
    """Without the columns that begin with an underscore."""
    return df.select(*[c for c in df.columns if not c.startswith("_")])


def preview(df: DataFrame, most: int = 100) -> dict:
    """How many rows a result has and the first of them."""
    rows = df.limit(most + 1).collect()
    count = len(rows) if len(rows) <= most else df.count()
    return {"row_count": count, "truncated": count > most, "rows": [[json_safe(v) for v in r] for r in rows[:most]]}


#: Columns of a row that people annotate, and those that they fill in.
ANNOTATED = (
    "question_id", "db_id", "generator", "prompt_setting", "split", "level", "question", "generated_sql", "gold_sql", "generated_result", "gold_result",
    "generated_execution_status", "gold_execution_status", "execution_match", "evaluation_group", "ambiguity_flags", "excluded_from_primary_metrics",
)
LABELS = ("primary_error_label", "secondary_error_label", "error_sublabel", "annotation_note")


def annotation_rows(df: DataFrame) -> DataFrame:
    """Rows for annotation: fixed columns (null where ``df`` has none), then empty labels."""
    held = [F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in ANNOTATED]
    return df.select(*held, *[F.lit(None).cast("string").alias(c) for c in LABELS])


def learning_examples(df: DataFrame, prompt: Column, split: str | None = None, target: str = "gold_sql") -> DataFrame:
    """Examples for learning repairs, and why other rows are none: skip_reason (null for examples) with prompt, completion (JSON), target_sql and is_corruption_probe."""
    kind, reason = candidate()
    skip = F.when(~F.col("split").eqNullSafe(split), "split_filtered") if split is not None else F.when(F.lit(False), "")
    skip = skip.when(reason.isNotNull(), reason).when(filled(F.col(target)).isNull(), f"missing_{target}")
    goal = F.trim(F.col(target))
    completion = F.to_json(F.struct(goal.alias("repaired_sql")))
    shown = {"skip_reason": skip, "repair_kind": kind, "prompt": prompt, "completion": completion, "target_sql": goal, "is_corruption_probe": F.col("evaluation_group") == A}
    out = df.withColumns(shown)
    for name in list(shown)[1:]:
        out = out.withColumn(name, F.when(F.col("skip_reason").isNull(), F.col(name)))
    return out


def coalesced_group(df: DataFrame) -> Column:
    """A row's group under whatever name it has."""
    names = [c for c in ("evaluation_group", "eval_group", "group") if c in df.columns]
    return filled(*map(F.col, names)) if names else F.lit(None).cast("string")


def execution_error(df: DataFrame) -> tuple[Column, Column]:
    """The first error of a row and where it stands: in its own columns, else a status that is no success."""
    names = [c for c in ("generated_error", "error_message", "error") if c in df.columns]
    texts = [F.when(F.col(n) != "", F.struct(F.col(n).alias("e"), F.lit(n).alias("s"))) for n in names]
    status = "generated_execution_status"
    if status in df.columns:
        texts.append(F.when((F.col(status) != "") & (F.lower(status) != "success"), F.struct(F.col(status).alias("e"), F.lit(status).alias("s"))))
    found = F.coalesce(*texts)
    return found["e"], found["s"]


def repair_error(df: DataFrame) -> Column:
    """The error that a repair is told: of the row, of its profile (JSON), else the first failed evidence."""
    own = [F.when(F.col(n) != "", F.col(n)) for n in ("generated_error", "error_message", "error", "route_reason") if n in df.columns]
    profile = [F.when(F.get_json_object("execution_profile", f"$.{k}") != "", F.get_json_object("execution_profile", f"$.{k}")) for k in ("execution_error", "error")] if "execution_profile" in df.columns else []
    evidence = [F.get(F.filter(F.col("verification")["stage2_failed_evidence"], lambda e: e != ""), 0)] if "verification" in df.columns else []
    return F.coalesce(*own, *profile, *evidence, F.lit(None).cast("string"))


# Keys

#: Run keys: what makes an answer of a run the same, by what the run does.
RUN_KEYS = {
    "generation": ("question_id", "generator", "prompt_setting"),
    "intent": ("question_id", "question_hash", "intent_mode", "model"),
    "route": ("question_id", "generator", "prompt_setting", "evaluation_group", "generated_sql_hash"),
    "refine": ("question_id", "generated_sql_hash", "repair_mode", "model", "context_hash"),
    "repair": ("question_id", "generated_sql_hash", "repair_mode", "model", "intent_mode", "context_hash"),
    "verify": ("question_id", "generator", "prompt_setting", "evaluation_group", "model", "profile_mode", "probing_mode", "intent_mode", "max_probes", "generated_sql_hash"),
}


def with_run_key(df: DataFrame, run: str) -> DataFrame:
    """``df`` with the columns of a run's key: hashes made, a missing setting unknown (-1 probes)."""
    defaults = {"repair_mode": "unknown", "profile_mode": "unknown", "probing_mode": "unknown", "intent_mode": "unknown"}
    made = {}
    for name in RUN_KEYS[run]:
        if name.endswith("_hash") and name not in df.columns:
            source = {"generated_sql_hash": "generated_sql", "question_hash": "question"}.get(name)
            made[name] = hash16(F.col(source)) if source in df.columns else F.lit(None).cast("string")
        elif name == "max_probes":
            made[name] = F.coalesce(F.col(name).cast("int"), F.lit(-1)) if name in df.columns else F.lit(-1)
        elif name in defaults:
            made[name] = F.coalesce(F.col(name), F.lit(defaults[name])) if name in df.columns else F.lit(defaults[name])
        elif name not in df.columns:
            made[name] = F.lit(None).cast("string")
    return df.withColumns(made) if made else df


def context_hash(*columns: str) -> Column:
    """A hash of what a call of a model depends on, nulls told apart from empty texts."""
    return F.substring(F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256), 1, 16)


# Lists


def ordered_unique(values: Column) -> Column:
    """Values in the order that they are first met, without nulls and empty texts."""
    return F.array_distinct(F.filter(values, lambda v: v.isNotNull() & (v != "")))


def sorted_set(values: Column) -> Column:
    return F.array_sort(F.array_distinct(F.array_compact(values)))


# Several frames


def dedupe(df: DataFrame, key: str, order: str, policy: str = "last") -> tuple[DataFrame, DataFrame]:
    """One row of each key and a one-row frame of rows, ids and repeats. Policies: first, last, error (reading fails on a repeat); a missing key always fails."""
    if policy not in ("first", "last", "error"):
        raise ValueError(f"no policy {policy!r}")
    pick = F.min_by if policy == "first" else F.max_by
    kept = df.groupBy(key).agg(pick(F.struct(*df.columns), order).alias("_r"), F.count("*").alias("_n"))
    lost = F.col(key).isNull() | (F.col(key).cast("string") == "")
    bad = F.when(lost, F.raise_error(F.lit(f"a row without {key}")).cast("boolean"))
    if policy == "error":
        bad = bad.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit(f"repeated {key}: "), F.col(key).cast("string"))).cast("boolean"))
    counts = kept.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"), F.count("*").alias("ids"), F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("repeats"))
    return kept.where(bad.otherwise(True)).select("_r.*"), counts


def joined_runs(before: DataFrame, after: DataFrame, verifier: DataFrame | None = None, repair: DataFrame | None = None, final: DataFrame | None = None, key: str = "question_id") -> DataFrame:
    """Questions that both sets have, with what the verifier, the repair and the last evaluation say of them, if anything. Clashing columns get the run's name before them."""
    named = lambda df, name: df.select(key, *[F.col(c).alias(f"{name}_{c}") for c in df.columns if c != key])
    out = named(before, "before").join(named(after, "after"), key)
    for name, df in (("verifier", verifier), ("repair", repair), ("final", final)):
        if df is not None:
            out = out.join(named(df, name), key, "left")
    return out.orderBy(key)


def zipped(left: DataFrame, right: DataFrame, name: str = "_row_index") -> DataFrame:
    """Rows of two frames side by side by their place (a column of both); reading fails where one has no partner."""
    both = left.withColumn("_l", F.lit(True)).join(right.withColumn("_r", F.lit(True)), name, "full")
    whole = F.when(F.col("_l") & F.col("_r"), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("a row without a partner at "), F.col(name).cast("string"))).cast("boolean"))
    return both.where(whole).drop("_l", "_r")


def complement(rows: DataFrame, ids: DataFrame, key: str = "question_id", expected: int | None = None, population: DataFrame | None = None) -> DataFrame:
    """Rows outside a frozen set of ids. The ids must be rows of the population, as many as expected; the population must have the rows' ids; and some rows must be left."""
    frozen = ids.select(key).distinct()
    everyone = (population if population is not None else rows).select(key)
    if expected is not None and frozen.count() != expected:
        raise ValueError(f"{expected} frozen ids expected")
    if not frozen.join(everyone, key, "left_anti").isEmpty():
        raise ValueError("frozen ids outside the population")
    if population is not None and not (everyone.exceptAll(rows.select(key)).isEmpty() and rows.select(key).exceptAll(everyone).isEmpty()):
        raise ValueError("rows and population differ in their ids")
    left = rows.join(frozen, key, "left_anti")
    if left.isEmpty():
        raise ValueError("no rows are left")
    return left


def one_split(df: DataFrame, split: str = "validation") -> DataFrame:
    """``df``; reading it fails if it is empty or holds rows of another split."""
    seen = df.agg(F.count("*").alias("n"), F.count_if(F.col("split").eqNullSafe(split)).alias("m"))
    fine = F.when((F.col("n") > 0) & (F.col("n") == F.col("m")), F.lit(True)).otherwise(F.raise_error(F.lit(f"not all rows are of {split}")).cast("boolean"))
    return df.crossJoin(F.broadcast(seen.select(fine.alias("_fine")))).where("_fine").drop("_fine")  # one row


def cache_faults(source: DataFrame, cached: DataFrame, key: str = "question_id", sql: str = "generated_sql") -> DataFrame:
    """Why cached results do not stand for their source: ids that one side lacks, and queries that changed, as (key, fault)."""
    a = source.select(key, F.sha2(F.coalesce(sql, F.lit("")), 256).alias("_a"))
    b = cached.select(key, F.sha2(F.coalesce(sql, F.lit("")), 256).alias("_b"))
    fault = F.when(F.col("_a").isNull(), "not in the source").when(F.col("_b").isNull(), "not cached").when(F.col("_a") != F.col("_b"), "another query")
    return a.join(b, key, "full").select(key, fault.alias("fault")).where("fault IS NOT NULL")


def sound_metrics(document: dict, most: int) -> None:
    """ValueError if cached accounting metrics cannot be those of ``most`` questions."""
    count = lambda k: isinstance(document.get(k), int) and document[k] >= 0
    if not count("joined_question_ids") or document["joined_question_ids"] > most:
        raise ValueError("joined_question_ids is out of bounds")
    if not count("group_d_filtered_question_ids"):
        raise ValueError("group_d_filtered_question_ids is no count")
    if not isinstance(document.get("sets"), list) or not document["sets"]:
        raise ValueError("no sets")


def routed(df: DataFrame, target: str, reason: str) -> DataFrame:
    """Rows of one route with what says so, under their run key."""
    own = with_run_key(df, "route")
    return own.withColumns({"pipeline_route": F.lit(target), "route_reason": F.lit(reason), "status": F.lit("routed"), "error": F.lit(None).cast("string")})


def test_routes(df: DataFrame, engine: Engine, workers: int = WORKERS) -> DataFrame:
    """Rows without a reference query by whether their query runs: group B and executable, or C and non_executable, with the error. Texts run as pairs do, in shared scans."""
    texts = df.select(F.coalesce("generated_sql", F.lit("")).alias("sql")).distinct()
    found, paths = outcomes(engine, texts.select(F.sha2("sql", 256).alias("h"), "sql"), workers)
    known = found.select(F.col("h").alias("_h"), F.col("error").alias("local_execution_error"))
    joined = df.withColumn("_h", F.sha2(F.coalesce("generated_sql", F.lit("")), 256)).join(known, "_h", "left").drop("_h")
    joined = written(joined, "routes")
    for path in paths:
        remove(df.sparkSession, path)
    runs = F.col("local_execution_error").isNull()
    return joined.withColumns({"evaluation_group": F.when(runs, B).otherwise(C), "inference_route": F.when(runs, "executable").otherwise("non_executable"), "generated_error": F.col("local_execution_error")})


def setup_faults(df: DataFrame, engine: Engine, most: int = 5) -> list[tuple[str, str]]:
    """Reference queries of the first records that do not run (a look at a new setup); records without a query are an error."""
    rows = df.limit(most).select("question_id", "gold_sql").collect()
    if any(not (r.gold_sql or "").strip() for r in rows):
        raise ValueError("a record without a reference query")
    return [(r.question_id, e) for r in rows if (e := engine.run(r.gold_sql)[0])]


def manifest(systems: list[dict]) -> str:
    """The list of a comparison's systems as JSON; each has a label, a kind and the places of its metrics."""
    for s in systems:
        if missing := {"label", "kind", "metrics_json"} - set(s):
            raise ValueError(f"a system without {sorted(missing)}")
    return json.dumps({"main_systems": [s for s in systems if s["kind"] != "ablation"], "ablations": [s for s in systems if s["kind"] == "ablation"]}, indent=2)
