"""Whether a query answers its question, asked of a language model, and what the question means.

Each step is a talk of ``ledgerlens.plans.rounds``: it yields prompts and is sent
answers, so all rows of a batch are asked together.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame

from ledgerlens.plans import verdicts as V
from ledgerlens.plans.notes import Notes, guide_text, intent_guide
from ledgerlens.plans.profile import compact_profile, full_profile
from ledgerlens.plans.facts import facts_of
from ledgerlens.plans.rounds import Talk, Truncated, in_rounds

# Statuses of a profile that nothing can be said about, and the ways to ask further.
UNREADABLE = ("PARSE_ERROR", "UNSUPPORTED_LINEAGE", "AMBIGUOUS_SEMANTIC_MAPPING")
NEVER, IF_UNCLEAR, WHILE_ASKED = "none", "hybrid", "probe"
MOST_PROBES = 7
SLOTS = ("entity", "measure", "time", "operation")
# What a slot of an intent holds if the model does not say.
DEFAULTS = {
    "entity": {"entity_mentions": [], "ambiguities": [], "confidence": "medium"},
    "measure": {"answer_type": "unknown", "target_concept": "", "measure_kind": "unknown", "possible_posting_sides": ["unknown"], "possible_event_types": ["unknown"], "non_equivalent_measures": [], "ambiguities": [], "confidence": "medium"},
    "time": {"expression": None, "granularity": "none", "range_start": None, "range_end": None, "relative_time": None, "date_type": "none", "requires_group_by_period": False, "requires_latest": False, "requires_today": False, "ambiguities": [], "confidence": "medium"},
    "operation": {"aggregation": "none", "group_by": [], "order_by": [], "limit": None, "comparison": {"required": False, "type": "none", "left": None, "right": None, "evidence": ""}, "ambiguities": [], "confidence": "medium"},
}
_UNSAID = (None, "", [], {}, "none", "unknown", ["unknown"])


# Profiles as text


#: Profiles that a worker remembers.
REMEMBERED = 5_000


def execution_profile(sql: str | None, notes: Notes, mode: str = "compact") -> str:
    """What a verifier is shown of a query: its facts (``ast``), its full profile (``semantic``) or its compact one. The notes remember the last texts."""
    known, key = notes.remembered, (mode, sql)
    if key not in known:
        if len(known) >= REMEMBERED:
            known.clear()
        known[key] = _execution_profile(sql, notes, mode)
    return known[key]


def _execution_profile(sql: str | None, notes: Notes, mode: str) -> str:
    kinds = {"ast": "parsed_ast", "semantic": "semantic_profile", "compact": "compact_semantic_profile"}
    if mode == "ast":
        found = facts_of(sql)
        shown = {"parsed_sql": found} | ({"parse_error": found["error"]} if found.get("error") else {})
    else:
        shown = (full_profile if mode == "semantic" else compact_profile)(sql, notes)
        shown.pop("status", None)
    return json.dumps({"status": "OK", "profile_type": kinds[mode], **shown}, ensure_ascii=False, indent=2, sort_keys=True, default=str)


def error_profile(sql: str | None, error: str | None, source: str | None = None) -> str:
    """What a verifier is shown of a query that does not run."""
    shown = {"status": "EXECUTION_ERROR", "profile_type": "execution_error", "generated_sql": sql, "execution_error": error or "unknown", "error_source": source, "warnings": ["the query failed before its meaning could be read"]}
    return json.dumps(shown, ensure_ascii=False, indent=2, sort_keys=True)


def unreadable(profile: str | None) -> str | None:
    """The status for which a profile is not asked about."""
    try:
        parsed = json.loads(profile or "")
    except ValueError:
        return None
    if not isinstance(parsed, dict):
        return None
    inner = parsed.get("profile_extraction") if isinstance(parsed.get("profile_extraction"), dict) else {}
    found = [parsed.get("status"), "UNSUPPORTED_LINEAGE" if parsed.get("unsupported_lineage") is True else None, inner.get("status")]
    found.append("UNSUPPORTED_LINEAGE" if "unsupported_lineage" in (inner.get("unsupported_features") or []) else None)
    if parsed.get("parse_error"):
        found.append("PARSE_ERROR")
    return next((s for s in found if s in UNREADABLE), None)


# Results


def result(answers: bool | None = None, **more) -> dict:
    """A verification with every field; what is not named is unset."""
    blank = {
        "answers_question": answers, "mismatch_type": None, "mismatch_detail": None, "repair_hint": None, "ambiguous": answers is None, "should_abstain": answers is None, "abstain_reason": None,
        "confidence": None, "raw_output": None, "invalid_mismatch_type": None, "error": None, "stage2_answers_question": None, "stage2_ambiguous": None, "stage3_ran": False,
        "stage2_evidence_match": None, "stage2_primary_mismatch_type": None, "stage2_mismatch_detail": None, "stage2_failed_evidence": [], "stage2_diagnostic_dimensions": None, "probes_used": 0, "probe_trajectory": [],
    }
    return blank | more


VERIFICATION = (
    "answers_question boolean, mismatch_type string, mismatch_detail string, repair_hint string, ambiguous boolean, should_abstain boolean, abstain_reason string, confidence string, raw_output string, "
    "invalid_mismatch_type string, error string, stage2_answers_question boolean, stage2_ambiguous boolean, stage3_ran boolean, stage2_evidence_match string, stage2_primary_mismatch_type string, "
    "stage2_mismatch_detail string, stage2_failed_evidence array<string>, stage2_diagnostic_dimensions map<string,string>, probes_used int, probe_trajectory array<struct<probe_question:string,resolution:string,reasoning:string>>"
)


def not_executable(error: str | None) -> dict:
    """The verification of a query that does not run; no model is asked."""
    return result(
        False, mismatch_type=V.NON_EXECUTABLE, mismatch_detail="the query does not run, so its meaning cannot be compared", repair_hint="mend the error and leave the meaning as it is; the meaning is looked at once the query runs",
        confidence="high", stage2_answers_question=False, stage2_ambiguous=False, stage2_evidence_match="insufficient", stage2_primary_mismatch_type=V.NON_EXECUTABLE, stage2_mismatch_detail="the query does not run",
        stage2_failed_evidence=[f"Generated SQL execution error: {error or 'unknown'}"], stage2_diagnostic_dimensions=dict.fromkeys(V.DIMENSIONS, "weak"),
    )


# Prompts

_FORMS = {"compact": "compact profile", "semantic": "full profile", "ast": "structure"}


def compare_prompt(intent: dict, profile: str, mode: str = "compact", probes: bool = True) -> str:
    fields = {
        "evidence_match": "sufficient | insufficient | unclear", "primary_mismatch_type": " | ".join(V.MISMATCHES) + " | null", "mismatch_detail": "what differs or is open", "failed_evidence": ["..."],
        "diagnostic_dimensions": dict.fromkeys(V.DIMENSIONS, " | ".join(V.STANDINGS)), "ambiguous": "true | false", "confidence": " | ".join(V.CONFIDENCE),
    }
    if probes:
        fields["suggested_probe"] = "one question about the profile that would settle what is open, not one of probe_context | null"
    return (
        f"Compare what a question asks for with what a SQL query computes, as its {_FORMS[mode]} tells. Look at the objects it is about, the measure, and the logic of its computation. "
        f"Other words for the same thing are no difference. Answer with one JSON object of this form:\n{json.dumps(fields, indent=2)}\n\nAsked for:\n{json.dumps(intent, ensure_ascii=False, indent=2)}\n\nComputed:\n{profile}"
    )


def probe_prompt(question: str, intent: dict, profile: str, mode: str = "compact") -> str:
    form = {"probe_resolution": "supported | contradicted | unclear", "reasoning": "..."}
    return f"Answer a question about the {_FORMS[mode]} of a SQL query from the profile alone, with one JSON object of this form:\n{json.dumps(form)}\n\nQuestion: {question}\n\nAsked for:\n{json.dumps(intent, ensure_ascii=False)}\n\nProfile:\n{profile}"


def hint_prompt(question: str, intent: dict, profile: str, verdict: dict) -> str:
    shown = {k: verdict[k] for k in ("primary_mismatch_type", "mismatch_detail", "failed_evidence")}
    form = {"repair_hint": "the smallest change that mends the query, in one or two sentences", "confidence": " | ".join(V.CONFIDENCE)}
    return f"A SQL query does not answer its question. Say how to mend it, without naming another kind of error, with one JSON object of this form:\n{json.dumps(form)}\n\nQuestion: {question}\n\nAsked for:\n{json.dumps(intent, ensure_ascii=False)}\n\nFound:\n{json.dumps(shown, ensure_ascii=False)}\n\nComputed:\n{profile}"


def _read(answer: str) -> dict:
    found = V.json_object(answer)
    if found is None:
        raise ValueError("no JSON object in the answer")
    return found


def verification(question: str | None, intent: dict | None, profile: str, probing: str = IF_UNCLEAR, most: int = MOST_PROBES, mode: str = "compact") -> Talk:
    """A talk whose result is a verification. A query is refused only with a known mismatch, and then a hint is asked for."""
    status = unreadable(profile)
    if status:
        return result(abstain_reason=status)
    known = dict(intent) if intent is not None else {"question": question}
    raw: list[dict] = []
    probes: list[dict] = []

    def done(answers: bool | None, **more) -> dict:
        return result(answers, raw_output=json.dumps(raw, ensure_ascii=False), probes_used=len(probes), probe_trajectory=probes, **more)

    try:
        while True:
            said = yield compare_prompt(known, profile, mode, probing != NEVER)
            raw.append({"step": f"stage2_{len(probes)}", "raw": said})
            verdict = V.stage_two(_read(said))
            asked = verdict["suggested_probe"]
            settled = probing == NEVER or probing == IF_UNCLEAR and not verdict["ambiguous"] and verdict["evidence_match"] != "unclear"
            if settled or not asked or len(probes) >= most:
                break
            said = yield probe_prompt(asked, known, profile, mode)
            raw.append({"step": f"probe_{len(probes) + 1}", "raw": said})
            told = _read(said)
            probes.append({"probe_question": asked, "resolution": str(told.get("probe_resolution", "unclear")), "reasoning": str(told.get("reasoning", ""))})
            known = known | {"probe_context": [{"question": p["probe_question"], "answer": p["reasoning"], "resolution": p["resolution"]} for p in probes]}
    except Truncated:
        return done(None, abstain_reason="max_tokens_reached", error="the answer ended at the model's limit")
    except Exception as e:  # noqa: BLE001 - an answer that cannot be read is a verdict too
        return done(None, abstain_reason="invalid_verifier_output", error=str(e))
    evidence = {f"stage2_{k}": verdict[k] for k in ("evidence_match", "primary_mismatch_type", "mismatch_detail", "failed_evidence", "diagnostic_dimensions")}
    if verdict["answers_question"]:
        return done(True, confidence=verdict["confidence"], stage2_answers_question=True, stage2_ambiguous=False, **evidence)
    evidence |= {"stage2_answers_question": verdict["answers_question"], "stage2_ambiguous": verdict["ambiguous"]}
    if verdict["answers_question"] is None or verdict["ambiguous"]:
        reason = "invalid_mismatch_type" if verdict["evidence_match"] == "insufficient" else "marked_unclear"
        return done(None, abstain_reason=reason, confidence=verdict["confidence"], invalid_mismatch_type=verdict["invalid_mismatch_type"], **evidence)
    refused = {"mismatch_type": verdict["primary_mismatch_type"], "mismatch_detail": verdict["mismatch_detail"], "stage3_ran": True, **evidence}
    try:
        said = yield hint_prompt(question or "", known, profile, verdict)
        raw.append({"step": "stage3_repair", "raw": said})
        hint = _read(said)
    except Exception as e:  # noqa: BLE001
        return done(False, confidence=verdict["confidence"], error=f"no repair hint: {e}", **refused)
    return done(False, repair_hint=V.said(hint.get("repair_hint")), confidence=V.one_of(hint.get("confidence"), V.CONFIDENCE, "medium"), **refused)


def verified(df: DataFrame, answer: Callable[[list[str]], list], notes: Notes, probing: str = IF_UNCLEAR, most: int = MOST_PROBES, mode: str = "compact", batch: int = 32) -> DataFrame:
    """``df`` (question, generated_sql, generated_error; intent_representation as JSON if there is one) with execution_profile and verification.

    A row with a generated_error is not executable, and no model is asked.
    """
    def talk(row: dict) -> Talk:
        if row.get("generated_error"):
            return {"execution_profile": error_profile(row["generated_sql"], row["generated_error"]), "verification": not_executable(row["generated_error"])}
        profile = execution_profile(row["generated_sql"], notes, mode)
        intent = json.loads(row["intent_representation"]) if row.get("intent_representation") else None
        return {"execution_profile": profile, "verification": (yield from verification(row["question"], intent, profile, probing, most, mode))}

    return in_rounds(df, talk, answer, f"execution_profile string, verification struct<{VERIFICATION.replace(' ', ':').replace(',:', ',')}>", batch)


# Intents


def slot(name: str, parsed: dict) -> dict:
    """A slot with its defaults, lists and truths made what they are."""
    out = {"reasoning": "", **DEFAULTS[name], **parsed}
    out.pop("preferred_columns_or_vectors", None)
    for key, default in DEFAULTS[name].items():
        if isinstance(default, list):
            out[key] = out[key] if isinstance(out[key], list) else [] if out[key] in (None, "") else [out[key]]
        elif isinstance(default, bool):
            out[key] = bool(out[key])
        elif isinstance(default, dict):
            given = out[key] if isinstance(out[key], dict) else {}
            out[key] = {**default, **given}
            out[key]["required"] = bool(out[key]["required"])
    out["confidence"] = V.one_of(out["confidence"], V.CONFIDENCE, "medium")
    return out


def spoken(value):
    """Without what is empty, none or unknown, at any depth; false and zero stay."""
    if isinstance(value, dict):
        return {k: v for k, v in ((k, spoken(v)) for k, v in value.items()) if v not in _UNSAID or v is False}
    if isinstance(value, list):
        return [v for v in map(spoken, value) if v not in _UNSAID[:-1] or v is False]
    return value


def slot_prompt(name: str, question: str, guide: str = "") -> str:
    asked = {"entity": "the parties and objects that it is about", "measure": "what is measured", "time": "the time that it is about", "operation": "what is computed: aggregation, groups, order, limit, comparison"}[name]
    known = f"\n\nWhat is known of the business:\n{guide}" if guide else ""
    return f"Say of a question to a ledger {asked}. Do not guess columns. Answer with one JSON object of this form:\n{json.dumps({'reasoning': '...', **DEFAULTS[name]})}{known}\n\nQuestion: {question}"


def intention(question: str, guide: str | None, mode: str = "nl_only") -> Talk:
    """A talk whose result is the intent of a question: four slots, asked one after the other. Mode ``none`` asks nothing."""
    if mode == "none":
        return {"_stage": "intent_decomposition", "_decomposition_method": "none", "question": question, "raw_question": question, "slots": {}, "ambiguities": [], "slot_confidences": {}, "parse_errors": [], "overall_confidence": "medium"}
    slots, errors = {}, []
    for name in SLOTS:
        parsed: dict = {}
        try:
            said = yield slot_prompt(name, question, guide or "")
            found = V.json_object(said)
            parsed = found if found is not None else {"_parse_error": f"{name}: no JSON object in the answer", "confidence": "low"}
        except Exception as e:  # noqa: BLE001
            parsed = {"_parse_error": f"{name}: {e}", "confidence": "low"}
        if parsed.get("_parse_error"):
            errors.append(parsed["_parse_error"])
        slots[name] = slot(name, parsed) | {"_slot_name": name, "_intent_mode": mode}
    confidences = {n: s["confidence"] for n, s in slots.items()}
    overall = "low" if errors or "low" in confidences.values() else "medium" if "medium" in confidences.values() else "high"
    method = "question_only" if mode == "nl_only" else "metadata_guided"
    return spoken({"_stage": "intent_decomposition", "_decomposition_method": method, "question": question, "slots": slots, "ambiguities": [a for s in slots.values() for a in s["ambiguities"]], "slot_confidences": confidences, "parse_errors": errors, "overall_confidence": overall})


def with_intents(df: DataFrame, answer: Callable[[list[str]], list], mode: str = "nl_only", notes: Notes | None = None, batch: int = 32) -> DataFrame:
    """``df`` (question) with intent_representation, a JSON text."""
    if mode not in ("none", "nl_only", "metadata_guided"):
        raise ValueError(f"no intent mode {mode!r}")
    if mode == "metadata_guided" and notes is None:
        raise ValueError("metadata_guided needs notes of the schema")
    guide = guide_text(intent_guide(notes), names=False) if mode == "metadata_guided" else ""

    def talk(row: dict) -> Talk:
        found = yield from intention(row["question"] or "", guide, mode)
        return {"intent_representation": json.dumps(found, ensure_ascii=False, sort_keys=True)}

    return in_rounds(df, talk, answer, "intent_representation string", batch)
