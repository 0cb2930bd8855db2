"""Repairs of queries by a language model, step by step, each step checked before the next.

A strategy says where a mismatch goes, which gates a repaired query must pass and
whether it is verified again. The steps of a row are a talk of
``ledgerlens.plans.rounds``; the gates are those of ``ledgerlens.plans.gates``, for
one pair of queries at a time.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ledgerlens.functions.scalars import grouping_words
from ledgerlens.plans import verdicts as V
from ledgerlens.plans.facts import CLAUSES, facts_by_shape
from ledgerlens.plans.gates import ACCEPTED, ALLOWED, MODES, NOT_APPLICABLE, REJECTED, temporal
from ledgerlens.plans.notes import Notes
from ledgerlens.plans.rounds import Talk, Truncated, in_rounds
from ledgerlens.plans.verify import MOST_PROBES, execution_profile, unreadable, verification

MOST_REPAIRS = 3


def squeezed(text: str | None) -> str:
    return " ".join((text or "").split()).lower()


def sql_in(text: str | None) -> str | None:
    """The query in an answer's field: of a fence, else from SELECT or WITH to the first semicolon, else the text."""
    if not text:
        return None
    for pattern in (r"(?is)```sql\s*(.*?)```", r"(?s)```\s*(.*?)```", r"(?is)\b((?:select|with)\b[^;]*)"):
        if (m := re.search(pattern, text)) and m[1].strip():
            return m[1].strip()
    return text.strip() or None


# Gates for one pair


def scope_of(before: str, after: str, mode: str) -> dict:
    """``gates.scope_check`` of one repair."""
    was, now = facts_by_shape(before), facts_by_shape(after)
    verdict = lambda status, changed=(), violated=(), error=None: {"status": status, "changed": list(changed), "violated": list(violated), "error": error}
    if mode not in ALLOWED:
        return verdict(REJECTED, error=f"no policy for {mode}")
    for which, facts in (("the query before", was), ("the repaired query", now)):
        if facts["error"]:
            return verdict(REJECTED, error=f"{which} cannot be read: {facts['error']}")
    changed = [c for c in CLAUSES if squeezed(was["clauses"].get(c)) != squeezed(now["clauses"].get(c))]
    outside = [c for c in changed if c not in ALLOWED[mode]]
    if outside:
        return verdict(REJECTED, changed, outside, f"clauses that must stay: {', '.join(outside)}")
    of = lambda facts, key: {squeezed(f["expression"]) for f in facts["filters"]} if key == "filters" else {n.lower() for n in facts[key]}
    timeless = sorted(p for p in of(was, "filters") ^ of(now, "filters") if not temporal(p))
    if mode == "computation_logic_error" and "WHERE" in changed and timeless:
        return verdict(REJECTED, changed, ["WHERE"], f"predicates that speak of no time: {', '.join(timeless)}")
    orphans = sorted((of(was, "output_names") - of(now, "output_names")) & of(was, "order_names") & of(now, "order_names"))
    if "SELECT" in changed and "ORDER BY" not in changed and orphans:
        return verdict(REJECTED, changed, ["SELECT"], f"ORDER BY uses names that are gone: {', '.join(orphans)}")
    return verdict(ACCEPTED, changed)


def grouping_evidence_of(question: str | None, intent: dict | None) -> list[str]:
    """``gates.grouping_evidence`` of one question."""
    intent = intent or {}
    slots = intent.get("slots") if isinstance(intent.get("slots"), dict) else {}
    part = lambda name: intent[name] if isinstance(intent.get(name), dict) else slots.get(name) if isinstance(slots.get(name), dict) else {}
    time, operation = part("time"), part("operation")
    comparison = operation.get("comparison") if isinstance(operation.get("comparison"), dict) else {}
    listed = lambda key: isinstance(operation.get(key), list) and bool(operation[key])
    signals = {
        "time.requires_group_by_period": time.get("requires_group_by_period") is True, "operation.group_by": listed("group_by"), "operation.comparison.required": comparison.get("required") is True,
        "operation.order_by": listed("order_by"), "operation.limit": operation.get("limit") not in (None, "", "none", "null"),
    }
    words = [f"question token: {w}" if " " not in w else f"question phrase: {w.split()[0]} dimension" for w in grouping_words(question)]
    return list(dict.fromkeys([*(f"intent.slots.{k}" for k, on in signals.items() if on), *words]))


def grouping_of(before: str, after: str, mode: str, question: str | None, intent: dict | None) -> dict:
    """``gates.grouping_check`` of one repair."""
    if mode != "computation_logic_error":
        return {"status": None, "required": None, "evidence": [], "error": None}
    evidence = grouping_evidence_of(question, intent)
    verdict = lambda status, error=None: {"status": status, "required": bool(evidence), "evidence": evidence, "error": error}
    was, now = facts_by_shape(before), facts_by_shape(after)
    if was["error"] or now["error"]:
        return verdict(REJECTED, was["error"] or now["error"])
    a, b = (squeezed(f["clauses"].get("GROUP BY")) for f in (was, now))
    if not b or a == b:
        return verdict(NOT_APPLICABLE)
    return verdict(ACCEPTED) if evidence else verdict(REJECTED, "GROUP BY changed, and nothing asks for groups")


def route_mismatch(mismatch: str | None, tried: list[str]) -> tuple[str | None, str | None]:
    """The kind of repair for a mismatch, or why there is none: each kind is tried once."""
    kind = (mismatch or "").strip()
    if kind not in MODES:
        return None, "unsupported_mismatch_type"
    return (None, "same_error_persisted_after_repair") if kind in tried else (kind, None)


# Prompts

_RULES = "Use only tables and columns of the schema. Write one SQLite query, without EXTRACT, DATE_TRUNC, INTERVAL, ILIKE, BOOL_OR or BOOL_AND."
_ABOUT = {
    "financial_measure_error": "The query measures the wrong thing. Change what is selected, nothing else.",
    "financial_object_error": "The query is about the wrong objects. Change the conditions of WHERE, nothing else.",
    "computation_logic_error": "The query computes in the wrong way. Change grouping, order, limit, aggregation or dates; leave tables and joins.",
    None: "The query does not answer its question. Change what is needed.",
    V.NON_EXECUTABLE: "The query does not run. Mend the error and leave its meaning.",
}


def repair_prompt(kind: str | None, question: str, sql: str, schema: str | None, evidence: dict, intent: dict | None = None, scoped: bool = True) -> str:
    """The prompt for a repair; ``scoped`` names the clauses that may change, without it no clause is named."""
    form = {"repaired_sql": "the whole query", "edit_summary": "...", "confidence": " | ".join(V.CONFIDENCE)}
    clauses = f" Clauses that may change: {', '.join(ALLOWED[kind])}." if scoped and kind in ALLOWED else ""
    meant = f"\n\nAsked for:\n{json.dumps(intent, ensure_ascii=False)}" if intent else ""
    return f"{_ABOUT[kind if scoped or kind == V.NON_EXECUTABLE else None]}{clauses} {_RULES} Answer with one JSON object of this form:\n{json.dumps(form)}\n\nQuestion: {question}{meant}\n\nFound:\n{json.dumps(evidence, ensure_ascii=False)}\n\nSchema:\n{schema or 'not given'}\n\nQuery:\n{sql}"


def proposal(prompt: str) -> Talk:
    """A talk whose result is a repair: failed without a readable answer, abstained without a query, else success."""
    raw = None
    blank = {"repaired_sql": None, "edit_summary": None, "confidence": None}
    try:
        raw = yield prompt
    except Truncated as e:
        return {**blank, "status": "failed", "raw_output": None, "error": f"the answer ended at the model's limit: {e}"}
    except Exception as e:  # noqa: BLE001
        return {**blank, "status": "failed", "raw_output": None, "error": str(e)}
    parsed = V.json_object(raw)
    if parsed is None:
        return {**blank, "status": "failed", "raw_output": raw, "error": "no JSON object in the answer"}
    sql = sql_in(V.said(parsed.get("repaired_sql")))
    told = {"edit_summary": V.said(parsed.get("edit_summary")), "confidence": V.one_of(parsed.get("confidence"), V.CONFIDENCE, "medium"), "raw_output": raw}
    return {"status": "success" if sql else "abstained", "repaired_sql": sql, **told, "error": None if sql else "no repaired_sql in the answer"}


# Strategies


@dataclass(frozen=True)
class Strategy:
    """How a semantic repair goes on: by kind of mismatch and through gates, or freely; verified again, or taken at once."""

    name: str
    gated: bool = True
    checked: bool = True
    most: int = MOST_REPAIRS

    def route(self, mismatch: str | None, tried: list[str]) -> tuple[str | None, str | None]:
        if self.gated:
            return route_mismatch(mismatch, tried)
        kind = (mismatch or "").strip()
        if not kind:
            return None, "missing_mismatch_type_after_repair" if tried else "missing_mismatch_type"
        return (None, "same_error_persisted_after_repair") if kind in tried else (kind, None)


SPECIALIZED = Strategy("specialized_chain_repair")
FIRST_ONLY = Strategy("specialized_first_repair_no_reverification", checked=False, most=1)
GENERIC = Strategy("generic_chain_repair", gated=False)


@dataclass
class Context:
    """What all steps of a row share."""

    question: str
    intent: dict | None
    schema: str | None
    notes: Notes
    mode: str = "compact"
    probing: str = "probe"
    most_probes: int = MOST_PROBES

    def check(self, sql: str) -> Talk:
        """Profile and verification of a repaired query."""
        profile = execution_profile(sql, self.notes, self.mode)
        return profile, (yield from verification(self.question, self.intent or {}, profile, self.probing, self.most_probes, self.mode))


def semantic_chain(sql: str, verdict: dict, context: Context, strategy: Strategy = SPECIALIZED) -> Talk:
    """A talk that repairs a query that runs: final_sql (None if no repair was taken), source, stop_reason, attempts, and the last verification."""
    now, tried, attempts, found = sql, [], [], dict(verdict)

    def end(reason: str, taken: str | None = None) -> dict:
        return {"final_sql": taken, "source": strategy.name if taken else "original_generated_sql", "stop_reason": reason, "attempts": attempts, "tried": tried, "verification": found}

    while True:
        kind, reason = strategy.route(found.get("mismatch_type"), tried)
        if tried and len(tried) >= strategy.most:
            return end("all_error_classes_attempted" if strategy.gated else "all_mismatch_types_attempted")
        if kind is None:
            return end(reason)
        if not V.said(found.get("repair_hint")):
            return end("repair_not_attempted_missing_hint")
        evidence = {k: found.get(k) for k in ("mismatch_type", "mismatch_detail", "repair_hint", "stage2_failed_evidence")}
        made = yield from proposal(repair_prompt(kind if strategy.gated else None, context.question, now, context.schema, evidence, context.intent, strategy.gated))
        tried.append(kind)
        attempt = {"repair_mode": kind if strategy.gated else "generic_semantic_repair", "before_sql": now, "after_sql": made["repaired_sql"], "repair_status": made["status"], "repair_error": made["error"], "changed": [], "scope_status": None, "scope_error": None, "grouping_status": None, "grouping_evidence": [], "decision": None, "answers_question": None, "next_mismatch": None}
        attempts.append(attempt)
        if made["status"] != "success":
            attempt["decision"] = "repair_failed_to_generate_sql"
            return end(attempt["decision"])
        if strategy.gated:
            scope = scope_of(now, made["repaired_sql"], kind)
            attempt |= {"changed": scope["changed"], "scope_status": scope["status"], "scope_error": scope["error"]}
            if scope["status"] != ACCEPTED:
                attempts[-1] = attempt | {"decision": "repair_rejected_by_scope_check"}
                return end("repair_rejected_by_scope_check")
            grouping = grouping_of(now, made["repaired_sql"], kind, context.question, context.intent)
            attempt |= {"grouping_status": grouping["status"], "grouping_evidence": grouping["evidence"]}
            attempts[-1] = attempt
            if grouping["status"] == REJECTED:
                attempt["decision"] = "repair_rejected_by_scalar_group_by_gate"
                return end(attempt["decision"])
        now = made["repaired_sql"]
        if not strategy.checked:
            attempt["decision"] = "first_repair_accepted_without_reverification"
            return end(attempt["decision"], now)
        _, found = yield from context.check(now)
        attempt |= {"answers_question": found["answers_question"], "next_mismatch": found["mismatch_type"]}
        attempts[-1] = attempt
        if found["should_abstain"] or found["error"] or found["answers_question"] is None:
            return end("reverification_failed_or_abstained")
        if found["answers_question"]:
            attempt["decision"] = "verifier_accepts_after_repair"
            return end(attempt["decision"], now)
        if len(tried) < strategy.most and strategy.route(found["mismatch_type"], tried)[0]:
            attempt["decision"] = "new_error_detected_and_routed"


def execution_chain(sql: str, error: str | None, context: Context, follow: Strategy | None = SPECIALIZED) -> Talk:
    """A talk that repairs a query that does not run, then what it means; a query that runs stays as the fall-back. Without ``follow`` it is taken at once."""
    made = yield from proposal(repair_prompt(V.NON_EXECUTABLE, context.question, sql, context.schema, {"execution_error": error or "unknown"}))
    attempt = {"repair_mode": "non_executable", "before_sql": sql, "after_sql": made["repaired_sql"], "repair_status": made["status"], "repair_error": made["error"], "changed": [], "scope_status": None, "scope_error": None, "grouping_status": None, "grouping_evidence": [], "decision": None, "answers_question": None, "next_mismatch": None}
    attempts, found = [attempt], None

    def end(reason: str, source: str = "original_generated_sql", taken: str | None = None) -> dict:
        attempt["decision"] = attempt["decision"] or reason
        return {"final_sql": taken, "source": source, "stop_reason": reason, "attempts": attempts, "tried": [V.NON_EXECUTABLE], "verification": found}

    if made["status"] != "success":
        return end("non_executable_repair_failed")
    runs = made["repaired_sql"]
    profile = execution_profile(runs, context.notes, context.mode)
    if unreadable(profile) == "PARSE_ERROR":
        return end("non_executable_repair_still_non_executable")
    if follow is None:
        return end("execution_repair_accepted_without_reverification", "non_executable_repair_no_reverification", runs)
    _, found = yield from context.check(runs)
    attempt |= {"answers_question": found["answers_question"], "next_mismatch": found["mismatch_type"]}
    attempts[0] = attempt
    kept = lambda reason: end(reason, "non_executable_repair_fallback", runs)
    if found["should_abstain"] or found["error"] or found["answers_question"] is None:
        return kept("post_execution_reverification_failed_or_abstained_using_execution_repair_fallback")
    if found["answers_question"]:
        return end("verifier_accepts_after_execution_repair", "non_executable_repair", runs)
    kind, reason = follow.route(found["mismatch_type"], [])
    if kind is None or not follow.gated and not V.said(found["repair_hint"]):
        why = reason if follow.gated else f"{'missing_mismatch_type' if kind is None else 'missing_repair_hint'}_after_execution_repair"
        return kept(f"{why}_using_execution_repair_fallback")
    attempt["decision"] = "post_execution_repair_routed_to_semantic_chain" if follow.gated else "post_execution_repair_routed_to_generic_chain"
    chain = yield from semantic_chain(runs, found, context, follow)
    attempts += chain["attempts"]
    if chain["final_sql"]:
        return {**chain, "attempts": attempts, "tried": [V.NON_EXECUTABLE, *chain["tried"]], "stop_reason": "semantic_followup_accepts_after_repair"}
    return {**kept(f"semantic_followup_failed_using_execution_repair_fallback:{chain['stop_reason']}"), "tried": [V.NON_EXECUTABLE, *chain["tried"]]}


ATTEMPT = "repair_mode:string,before_sql:string,after_sql:string,repair_status:string,repair_error:string,changed:array<string>,scope_status:string,scope_error:string,grouping_status:string,grouping_evidence:array<string>,decision:string,answers_question:boolean,next_mismatch:string"
REPAIR = f"repaired_sql string, final_sql_source string, stop_reason string, num_repair_attempts int, attempted_error_classes array<string>, repair_attempt_sequence array<struct<{ATTEMPT}>>, repair_status string"


def repaired(df: DataFrame, answer: Callable[[list[str]], list], notes: Notes, schema: str | None = None, strategy: Strategy = SPECIALIZED, mode: str = "compact", probing: str = "probe", most_probes: int = MOST_PROBES, batch: int = 32) -> DataFrame:
    """``df`` with a repair of every row that has a candidate_kind (``semantic`` or ``non_executable``).

    Reads question, generated_sql, generated_error, intent_representation (JSON)
    and verification. Rows without a kind are skipped; their status says so.
    """
    def talk(row: dict) -> Talk:
        kind = row.get("candidate_kind")
        if kind is None:
            return {"repair_status": "skipped", "final_sql_source": "original_generated_sql", "num_repair_attempts": 0, "attempted_error_classes": [], "repair_attempt_sequence": []}
        intent = json.loads(row["intent_representation"]) if row.get("intent_representation") else None
        context = Context(row["question"] or "", intent, schema, notes, mode, probing, most_probes)
        if kind == "non_executable":
            done = yield from execution_chain(row["generated_sql"], row.get("generated_error"), context, strategy if strategy.checked else None)
        else:
            done = yield from semantic_chain(row["generated_sql"], row.get("verification") or {}, context, strategy)
        status = "success" if done["final_sql"] else done["attempts"][-1]["repair_status"] if done["attempts"] and done["attempts"][-1]["repair_status"] != "success" else "rejected"
        return {"repaired_sql": done["final_sql"], "final_sql_source": done["source"], "stop_reason": done["stop_reason"], "num_repair_attempts": len(done["attempts"]), "attempted_error_classes": done["tried"], "repair_attempt_sequence": done["attempts"], "repair_status": status}

    return in_rounds(df, talk, answer, REPAIR, batch)


# Refinement without a verifier


def feedback(row: dict) -> dict:
    """What the execution of a query says to its reviser."""
    error = row.get("generated_error") or row.get("error_message")
    fine = row.get("generated_execution_status") == "success" and not row.get("generated_error")
    summary = "the query runs; the preview and the question say whether it is right" if fine else "the query failed; the error may say why" if error else "nothing is known of the query's execution"
    return {"generated_execution_status": row.get("generated_execution_status") or "unknown", **{k: row.get(k) for k in ("generated_error", "error_message", "generated_result")}, "ambiguity_flags": row.get("ambiguity_flags") or [], "summary": summary}


def refine_prompt(question: str, sql: str, schema: str | None, told: dict | None) -> str:
    form = {"changed": "true | false", "revised_sql": "the whole query", "edit_summary": "...", "confidence": " | ".join(V.CONFIDENCE)}
    shown = f"\n\nExecution:\n{json.dumps(told, ensure_ascii=False, sort_keys=True)}" if told is not None else ""
    return f"Review a SQL query for its question; revise it if it is wrong or does not run, else leave it. {_RULES} Answer with one JSON object of this form:\n{json.dumps(form)}\n\nQuestion: {question}{shown}\n\nSchema:\n{schema or 'not given'}\n\nQuery:\n{sql}"


def refinement(row: dict, schema: str | None, guided: bool) -> Talk:
    """A talk whose result is a revised query; no change if the model says so, gives none, or gives the same."""
    sql = row.get("generated_sql") or row.get("pred_sql") or ""
    mode = "generic_execution_guided_refine" if guided else "generic_self_refine"
    out = {"repair_mode": mode, "repaired_sql": None, "revised_sql": None, "changed": None, "refine_decision": "failed", "edit_summary": None, "confidence": None, "status": "failed", "error": None, "final_sql_source": "original_generated_sql"}
    try:
        raw = yield refine_prompt(row.get("question") or "", sql, schema, feedback(row) if guided else None)
    except Exception as e:  # noqa: BLE001
        return out | {"error": str(e) or "no answer"}
    parsed = V.json_object(raw)
    if parsed is None:
        return out | {"error": "no JSON object in the answer"}
    changed, revised = V.yes_no(parsed.get("changed")), sql_in(V.said(parsed.get("revised_sql")))
    told = {"revised_sql": revised, "changed": changed, "edit_summary": V.said(parsed.get("edit_summary")), "confidence": V.one_of(parsed.get("confidence"), V.CONFIDENCE, "medium"), "status": "success", "refine_decision": "no_change"}
    same = squeezed(revised).rstrip(";").strip() == squeezed(sql).rstrip(";").strip()
    if changed is False or not revised or same:
        return out | told | ({"error": "no revised_sql in the answer"} if not revised and changed is not False else {})
    return out | told | {"repaired_sql": revised, "changed": True if changed is None else changed, "refine_decision": "changed", "final_sql_source": mode}


REFINED = "repair_mode string, repaired_sql string, revised_sql string, changed boolean, refine_decision string, edit_summary string, confidence string, status string, error string, final_sql_source string"


def refined(df: DataFrame, answer: Callable[[list[str]], list], schema: str | None = None, guided: bool = False, batch: int = 32) -> DataFrame:
    """``df`` with one revision of every query, with what its execution said (``guided``) or without."""
    return in_rounds(df, lambda row: refinement(row, schema, guided), answer, REFINED, batch)
