"""What answers of a language model say: JSON in them, normalised fields, and what a row qualifies for."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.scalars import filled
from ledgerlens.sources.ledger import A, B, C

# Kinds of mismatch that a repair can take on, with the one that execution finds; and what evidence may come to.
MISMATCHES = ("financial_measure_error", "financial_object_error", "computation_logic_error")
NON_EXECUTABLE = "non_executable_error"
EVIDENCE, CONFIDENCE, DIMENSIONS, STANDINGS = ("sufficient", "insufficient", "unclear"), ("high", "medium", "low"), ("financial_object", "financial_measure", "computation_logic"), ("supported", "weak", "missing", "contradicted")
# Texts that stand for nothing, for yes and for no.
NOTHING, YES, NO = ("", "null", "none", "n/a"), ("true", "yes", "y", "1"), ("false", "no", "n", "0")


def generate(df: DataFrame, answer: Callable[[list[str]], list[str]], prompt: str, out: str = "answer", batch: int = 32) -> DataFrame:
    """Adds a callable's answer to each prompt, asked in batches on the executors; a null prompt has a null answer, a failed batch too."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            answers: list[str | None] = [None] * len(frame)
            asked = [k for k, p in enumerate(frame[prompt]) if p is not None]
            for s in range(0, len(asked), batch):
                part = asked[s : s + batch]
                try:
                    for k, a in zip(part, answer([frame[prompt].iloc[i] for i in part])):
                        answers[k] = a
                except Exception:  # noqa: BLE001 - the callable is foreign; its failure is a missing answer
                    continue
            yield frame.assign(**{out: pd.Series(answers, index=frame.index, dtype=object)})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInPandas(run, f"{fields}, `{out}` string")


_FENCE = re.compile(r"^```(?:json)?\s*(.*?)\s*```$", re.IGNORECASE | re.DOTALL)
_OVER_ESCAPED = re.compile(r'(:\s*)\\"([^"\\]*)\\"(?:\\"?)?(?=\s*[,}])')


def json_object(text: str | None) -> dict | None:
    """The first JSON object in an answer: of the text without a fence, with raw line breaks in texts allowed, or with quotes that are escaped too often mended."""
    text = (text or "").strip()
    if m := _FENCE.match(text):
        text = m[1]
    for decoder in (json.JSONDecoder(), json.JSONDecoder(strict=False)):
        for shown in (text, _OVER_ESCAPED.sub(r'\1"\2"', text)):
            at = shown.find("{")
            while at >= 0:
                try:
                    found, _ = decoder.raw_decode(shown, at)
                    if isinstance(found, dict):
                        return found
                except ValueError:
                    pass
                at = shown.find("{", at + 1)
    return None


def said(value) -> str | None:
    """A field's text, or None if it says nothing."""
    if value is None:
        return None
    text = str(value).strip()
    return None if not text or isinstance(value, str) and text.lower() in NOTHING else text


def one_of(value, known: tuple[str, ...], default: str | None = None) -> str | None:
    text = (said(value) or "").lower()
    return text if text in known else default


def yes_no(value) -> bool | None:
    if isinstance(value, (bool, int)):
        return bool(value) if value in (0, 1) else None
    text = value.strip().lower() if isinstance(value, str) else ""
    return True if text in YES else False if text in NO else None


def stage_two(parsed: dict) -> dict:
    """A verifier's answer, made consistent: the evidence decides, and insufficient evidence needs a known mismatch."""
    evidence = one_of(parsed.get("evidence_match"), EVIDENCE, "unclear")
    named = said(parsed.get("primary_mismatch_type"))
    mismatch = one_of(named, (*MISMATCHES, NON_EXECUTABLE))
    failed = parsed.get("failed_evidence")
    failed = [t for t in map(said, failed if isinstance(failed, list) else [failed]) if t]
    dimensions = parsed.get("diagnostic_dimensions")
    dimensions = dimensions if isinstance(dimensions, dict) else {}
    answers = True if evidence == "sufficient" else False if evidence == "insufficient" and mismatch else None
    return {
        "evidence_match": evidence, "answers_question": answers, "ambiguous": bool(yes_no(parsed.get("ambiguous"))) or answers is None,
        "primary_mismatch_type": mismatch if answers is False else None, "invalid_mismatch_type": named if named and not mismatch and answers is not True else None,
        "mismatch_detail": said(parsed.get("mismatch_detail")), "suggested_probe": said(parsed.get("suggested_probe")), "failed_evidence": failed,
        "diagnostic_dimensions": {d: one_of(dimensions.get(d), STANDINGS, "weak") for d in DIMENSIONS}, "confidence": one_of(parsed.get("confidence"), CONFIDENCE, "medium"),
    }


def truth(text: Column) -> Column:
    """Booleans as models write them; anything else is null."""
    plain = F.lower(F.trim(text))
    return F.when(plain.isin("true", "yes", "y", "1"), True).when(plain.isin("false", "no", "n", "0"), False)


def verdict(evidence: Column, mismatch: Column) -> Column:
    """Whether a query answers its question: sufficient evidence does; insufficient evidence of a known mismatch does not; else open (null)."""
    plain = F.lower(F.trim(evidence))
    return F.when(plain == "sufficient", True).when((plain == "insufficient") & mismatch.isin(*MISMATCHES), False)


def candidate() -> tuple[Column, Column]:
    """What a row is a repair candidate for (semantic or non_executable), and why it is none; the first reason holds.

    Columns: evaluation_group, status, question, generated_sql,
    execution_profile, intent_representation (JSON) and verification, a struct of
    answers_question, should_abstain, mismatch_type, stage2_failed_evidence and
    repair_hint.
    """
    c, v = F.col, F.col("verification")
    reasons = [
        (c("status").isNotNull() & (c("status") != "success"), "upstream_verification_failed"),
        (v.isNull(), "missing_verification"),
        (~v["answers_question"].eqNullSafe(False), "verification_not_rejected"),
        (v["should_abstain"].eqNullSafe(True), "verification_abstained"),
        (filled(v["mismatch_type"]).isNull(), "missing_mismatch_type"),
        (F.coalesce(F.size(v["stage2_failed_evidence"]), F.lit(0)) <= 0, "missing_failed_evidence"),
        (filled(v["repair_hint"]).isNull(), "missing_repair_hint"),
        (~F.coalesce(F.trim(c("intent_representation")).startswith("{"), F.lit(False)), "missing_intent_representation"),
        (F.coalesce(c("execution_profile"), F.lit("")) == "", "missing_execution_profile"),
    ]
    semantic = None
    for test, name in reasons:
        semantic = F.when(test, name) if semantic is None else semantic.when(test, name)
    broken = F.when(filled(c("generated_sql")).isNull(), "missing_generated_sql").when(filled(c("question")).isNull(), "missing_question")
    group = c("evaluation_group")
    reason = F.when(group.isin(A, B), semantic).when(group == C, broken).otherwise("unsupported_evaluation_group")
    kind = F.when(reason.isNull(), F.when(group == C, "non_executable").otherwise("semantic"))
    return kind, reason


def profile_status(text: Column) -> Column:
    """Status of an execution profile: of its JSON, of a profile nested in it, or of a ``[Status]`` line."""
    line = F.regexp_extract(text, r"\[Status\]\s*:?\s*(\w+)", 1)
    return F.upper(filled(F.get_json_object(text, "$.status"), F.get_json_object(text, "$.profile.status"), line))
