import json

import pytest
from pyspark.sql import functions as F

from ledgerlens.plans import repair, rounds, verdicts, verify
from ledgerlens.plans.notes import ledger_notes

NOTES = ledger_notes()
MEASURE, OBJECT, LOGIC = "financial_measure_error", "financial_object_error", "computation_logic_error"
SQL = "SELECT SUM(Credit) FROM master_txn_table WHERE Transaction_TYPE = 'invoice'"


def say(**fields):
    return json.dumps(fields)


def refuse(kind=MEASURE, **more):
    return say(evidence_match="insufficient", primary_mismatch_type=kind, failed_evidence=["x"], confidence="high", **more)


ACCEPT = say(evidence_match="sufficient", confidence="high")
HINT = say(repair_hint="use Debit", confidence="low")


def fix(sql, **more):
    return say(repaired_sql=sql, edit_summary="e", **more)


def play(talk, *answers):
    """The result of a talk and its prompts; answers are given in order, exceptions are raised in the talk."""
    prompts, left = [], list(answers)
    try:
        prompts.append(next(talk))
        while True:
            said = left.pop(0)
            prompts.append(talk.throw(said) if isinstance(said, Exception) else talk.send(said))
    except StopIteration as end:
        assert not left
        return end.value, prompts


def profile(sql=SQL, mode="compact"):
    return verify.execution_profile(sql, NOTES, mode)


def test_json_in_answers():
    assert verdicts.json_object('Sure: ```json\n{"a": {"b": 1}}\n``` {') == {"a": {"b": 1}}
    assert verdicts.json_object("{not json} {\"x\": [1]}") == {"x": [1]}
    assert verdicts.json_object(None) is None and verdicts.json_object("[1]") is None


def test_generate_in_batches(spark):
    def answer(prompts):
        if "bad" in prompts:
            raise RuntimeError
        return [p.upper() for p in prompts]

    frame = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "id int, p string").coalesce(1)
    assert [r.answer for r in verdicts.generate(frame, answer, "p").orderBy("id").collect()] == ["A", None, "B"]
    frame = spark.createDataFrame([(1, "a"), (2, "bad")], "id int, p string").coalesce(1)
    assert [r.answer for r in verdicts.generate(frame, answer, "p", batch=1).orderBy("id").collect()] == ["A", None]


def test_rounds_ask_together_and_fail_alone():
    asked = []

    def answer(prompts):
        asked.append(list(prompts))
        if "bad" in prompts:
            raise RuntimeError("no")
        return [p + "!" for p in prompts]

    def talk(first, more):
        said = []
        for p in [first] * more:
            try:
                said.append((yield p))
            except rounds.Failed as e:
                said.append(str(e))
        return said

    assert rounds.talk_all([talk("a", 2), talk("b", 0), talk("c", 1)], answer, 8) == [["a!", "a!"], [], ["c!"]] and asked == [["a", "c"], ["a"]]
    assert rounds.talk_all([talk("a", 1), talk("bad", 1)], answer, 8) == [["a!"], ["no"]]
    assert rounds.talk_all([talk("a", 1)], lambda p: [], 8)[0][0].startswith("0 answers")


def test_verdicts_are_made_consistent():
    assert verdicts.stage_two({"evidence_match": "insufficient", "primary_mismatch_type": "bad kind"})["invalid_mismatch_type"] == "bad kind"
    read = verdicts.stage_two({"evidence_match": "SUFFICIENT", "primary_mismatch_type": MEASURE, "failed_evidence": "one"})
    assert read["answers_question"] is True and read["primary_mismatch_type"] is None and read["failed_evidence"] == ["one"] and read["confidence"] == "medium"
    assert verdicts.stage_two({})["ambiguous"] is True


def test_verification():
    got, prompts = play(verify.verification("q", None, profile()), ACCEPT)
    assert got["answers_question"] is True and got["ambiguous"] is False and got["mismatch_type"] is None and got["probes_used"] == 0 and len(prompts) == 1
    got, prompts = play(verify.verification("q", {"a": 1}, profile()), refuse(), HINT)
    assert (got["answers_question"], got["mismatch_type"], got["repair_hint"], got["confidence"], got["stage3_ran"]) == (False, MEASURE, "use Debit", "low", True) and len(prompts) == 2
    got, _ = play(verify.verification("q", {}, profile()), refuse("guess"))
    assert got["answers_question"] is None and got["abstain_reason"] == "invalid_mismatch_type" and got["invalid_mismatch_type"] == "guess" and got["should_abstain"]
    got, _ = play(verify.verification("q", {}, profile()), "no json")
    assert got["abstain_reason"] == "invalid_verifier_output"
    got, _ = play(verify.verification("q", {}, profile()), rounds.Truncated())
    assert got["abstain_reason"] == "max_tokens_reached"
    got, _ = play(verify.verification("q", {}, profile()), refuse(), "no json")
    assert got["answers_question"] is False and got["repair_hint"] is None and got["error"]


def test_probes():
    unclear = say(evidence_match="unclear", suggested_probe="which side?")
    probe = say(probe_resolution="supported", reasoning="credit")
    got, prompts = play(verify.verification("q", {}, profile()), unclear, probe, ACCEPT)
    assert got["answers_question"] and got["probes_used"] == 1 and "which side?" in prompts[1] and "probe_context" in prompts[2]
    got, _ = play(verify.verification("q", {}, profile(), most=1), unclear, probe, unclear)
    assert got["abstain_reason"] == "marked_unclear" and got["probes_used"] == 1
    got, prompts = play(verify.verification("q", {}, profile(), verify.NEVER), unclear)
    assert got["answers_question"] is None and "suggested_probe" not in prompts[0]
    got, _ = play(verify.verification("q", {}, profile(), verify.WHILE_ASKED), say(evidence_match="sufficient", suggested_probe="sure?"), probe, ACCEPT)
    assert got["answers_question"] and got["probes_used"] == 1


@pytest.mark.parametrize("mode, kind", [("ast", "parsed_ast"), ("semantic", "semantic_profile"), ("compact", "compact_semantic_profile")])
def test_profiles_that_are_shown(mode, kind):
    assert json.loads(profile(mode=mode))["profile_type"] == kind
    assert play(verify.verification("q", {}, verify.execution_profile("SELECT (", NOTES, mode)))[0]["abstain_reason"] == "PARSE_ERROR"


def test_unreadable_profiles():
    assert verify.unreadable('{"unsupported_lineage": true}') == "UNSUPPORTED_LINEAGE" and verify.unreadable('{"parse_error": "x"}') == "PARSE_ERROR"
    assert verify.unreadable('{"status": "AMBIGUOUS_SEMANTIC_MAPPING"}') and verify.unreadable("nothing") is None and verify.unreadable("[1]") is None and verify.unreadable(None) is None


def test_intents():
    answers = [say(entity_mentions="Acme", confidence="HIGH"), say(answer_type="scalar", target_concept="sales"), "no json", say(aggregation="sum", group_by="month", limit=3)]
    got, prompts = play(verify.intention("sales to Acme", ""), *answers)
    assert len(prompts) == 4 and got["overall_confidence"] == "low" and len(got["parse_errors"]) == 1
    assert got["slots"]["entity"]["entity_mentions"] == ["Acme"] and got["slots"]["operation"] | {} and got["slots"]["operation"]["group_by"] == ["month"] and got["slots"]["operation"]["limit"] == 3
    got, prompts = play(verify.intention("q", None, "none"))
    assert prompts == [] and got["slots"] == {}
    with pytest.raises(ValueError):
        verify.with_intents(None, None, "other")
    with pytest.raises(ValueError):
        verify.with_intents(None, None, "metadata_guided")


def context(question="total of sales", **more):
    return repair.Context(question, None, "schema", NOTES, **more)


def refused(kind=MEASURE, hint="use Debit"):
    return {"mismatch_type": kind, "repair_hint": hint}


DEBIT = SQL.replace("Credit", "Debit")


def test_chains_of_repairs():
    done, _ = play(repair.semantic_chain(SQL, refused(), context()), fix(DEBIT), ACCEPT)
    assert (done["final_sql"], done["source"], done["stop_reason"]) == (DEBIT, "specialized_chain_repair", "verifier_accepts_after_repair") and done["attempts"][0]["scope_status"] == "accepted"
    other = DEBIT.replace("'invoice'", "'bill'")
    done, _ = play(repair.semantic_chain(SQL, refused(), context()), fix(DEBIT), refuse(OBJECT), HINT, fix(other), ACCEPT)
    assert done["final_sql"] == other and done["tried"] == [MEASURE, OBJECT] and done["attempts"][0]["decision"] == "new_error_detected_and_routed"
    done, _ = play(repair.semantic_chain(SQL, refused(), context()), fix(DEBIT), refuse(MEASURE), HINT)
    assert done["final_sql"] is None and done["source"] == "original_generated_sql" and done["stop_reason"] == "same_error_persisted_after_repair"
    done, _ = play(repair.semantic_chain(SQL, refused(), context()), fix(SQL + " LIMIT 3"))
    assert done["stop_reason"] == "repair_rejected_by_scope_check" and done["attempts"][0]["changed"]
    done, _ = play(repair.semantic_chain(SQL, refused(LOGIC), context("what is the total")), fix(SQL + " GROUP BY Customers"))
    assert done["stop_reason"] == "repair_rejected_by_scalar_group_by_gate"
    for said in ("no json", say(repaired_sql=""), rounds.Failed("x"), rounds.Truncated()):
        done, _ = play(repair.semantic_chain(SQL, refused(), context()), said)
        assert done["final_sql"] is None and done["stop_reason"] == "repair_failed_to_generate_sql"
    assert play(repair.semantic_chain(SQL, refused(hint=None), context()))[0]["stop_reason"] == "repair_not_attempted_missing_hint"
    assert play(repair.semantic_chain(SQL, refused(kind=None), context()))[0]["final_sql"] is None
    done, _ = play(repair.semantic_chain(SQL, refused(), context()), fix(DEBIT), "no json")
    assert done["stop_reason"] == "reverification_failed_or_abstained" and done["final_sql"] is None


def test_other_strategies():
    done, _ = play(repair.semantic_chain(SQL, refused(), context(), repair.FIRST_ONLY), fix(DEBIT))
    assert done["final_sql"] == DEBIT and done["stop_reason"] == "first_repair_accepted_without_reverification"
    free = SQL + " LIMIT 3"
    done, prompts = play(repair.semantic_chain(SQL, refused("odd kind"), context(), repair.GENERIC), fix(free), ACCEPT)
    assert done["final_sql"] == free and done["source"] == "generic_chain_repair" and "Clauses that may change" not in prompts[0]


def test_repairs_of_queries_that_do_not_run():
    done, _ = play(repair.execution_chain("SELEC", "syntax", context()), fix(SQL), ACCEPT)
    assert done["final_sql"] == SQL and done["source"] == "non_executable_repair"
    done, _ = play(repair.execution_chain("SELEC", "syntax", context()), fix(SQL), refuse(), HINT, fix(DEBIT), ACCEPT)
    assert done["final_sql"] == DEBIT and len(done["attempts"]) == 2 and done["stop_reason"] == "semantic_followup_accepts_after_repair"
    done, _ = play(repair.execution_chain("SELEC", "syntax", context()), fix(SQL), refuse(), HINT, "no json")
    assert done["final_sql"] == SQL and done["source"] == "non_executable_repair_fallback"
    done, _ = play(repair.execution_chain("SELEC", "syntax", context()), fix(SQL), "no json")
    assert done["final_sql"] == SQL and done["source"] == "non_executable_repair_fallback"
    assert play(repair.execution_chain("SELEC", "syntax", context()), fix("SELEC again"))[0]["final_sql"] is None
    assert play(repair.execution_chain("SELEC", "syntax", context()), "no json")[0]["stop_reason"] == "non_executable_repair_failed"
    assert play(repair.execution_chain("SELEC", "syntax", context(), None), fix(SQL))[0]["final_sql"] == SQL


def test_talks_over_rows(spark):
    mend, hint, accept, deny, wrong = fix(DEBIT), HINT, ACCEPT, refuse(), profile(SQL)

    def answer(prompts):
        return [mend if '"repaired_sql"' in p else hint if '"repair_hint"' in p else deny if wrong in p else accept for p in prompts]

    rows = [(1, "q", SQL, None), (2, "q", "SELEC", "syntax"), (3, None, DEBIT, None)]
    frame = spark.createDataFrame(rows, "idx int, question string, generated_sql string, generated_error string").repartition(2)
    seen = verify.verified(frame, answer, NOTES)
    got = {r.idx: r for r in seen.collect()}
    assert got[1].verification.mismatch_type == MEASURE and got[2].verification.mismatch_type == "non_executable_error" and got[3].verification.answers_question
    kind = F.when(F.col("verification.mismatch_type") == MEASURE, "semantic").when(F.col("verification.mismatch_type") == "non_executable_error", "non_executable")
    got = {r.idx: r for r in repair.repaired(seen.withColumn("candidate_kind", kind), answer, NOTES, "schema").collect()}
    assert [got[k].repair_status for k in (1, 2, 3)] == ["success", "success", "skipped"] and got[1].repaired_sql == got[2].repaired_sql == DEBIT and got[3].num_repair_attempts == 0
    assert verify.verified(frame.limit(0), answer, NOTES).collect() == []
