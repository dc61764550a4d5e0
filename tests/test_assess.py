from __future__ import annotations

import json

from pyspark.sql import functions as F

from quorate.plans import bindings as b
from quorate.operators.events import emit_trace, tokens_of
from quorate.plans.assess import assess
from quorate.schemas import CASES
from quorate.sources import tables as src

ENDO = {"specialty": "Endocrinologist", "findings": "Sugar ran high all spring.",
        "recommendation": "Step the insulin up.", "evidence_quotes": ["last HbA1c was 8.7%"],
        "confidence": 0.9}
NEPHRO = {"specialty": "Nephrologist", "findings": "Filtration fell within a week.",
          "recommendation": "Halve the doses cleared by the kidney.",
          "evidence_quotes": ["AKI since Monday"], "confidence": 0.85}


def cases(spark):
    return spark.createDataFrame([
        (1, "Which doses have to change?",
         ["Diabetes known for years; last HbA1c was 8.7%.", "AKI since Monday, eGFR 52."]),
        (2, "Anything to follow up?", ["The weather was fine."]),
        (3, "?", ["Too short a question."]),
    ], CASES)


def scripted(answers):
    # Nested, so that workers need no test module.
    def reviewer(batch):
        return [answers.get(s, "I cannot help with that.") for s in batch["specialty"]]
    return reviewer


def test_reviewed_cases(spark):
    reviewer = scripted({o["specialty"]: json.dumps(o) for o in (ENDO, NEPHRO)})
    done = assess(cases(spark), src.default_indicator_map(spark), reviewer)
    assert [r.problems for r in done.rejected.collect()] == [["question_short"]]
    first, second = done.assessments.orderBy("case_id").collect()

    assert [s.name for s in first.supervisor.specialties] == ["Endocrinologist", "Nephrologist"]
    assert first.lead_specialist == "Endocrinologist"
    assert {o.specialty for o in first.specialist_opinions} == {"Endocrinologist", "Nephrologist"}
    assert (first.consensus.participating, first.consensus.mean_confidence) == (2, 0.875)
    assert (first.consensus.level, first.consensus.outliers) == ("strong", [])
    assert first.consensus.per_specialty == {"Endocrinologist": 0.9, "Nephrologist": 0.85}
    assert len(first.judge_report.consolidated_recommendations) == 2
    assert first.safety_report.is_safe and first.safety_report.flagged_issues == []

    # Nobody matched: the fallback is asked, the reported triage stays empty.
    assert second.supervisor is None and second.asked == ["Internal Medicine"]
    assert (second.consensus.participating, second.consensus.abstained) == (0, 1)
    assert second.consensus.per_specialty == {"Internal Medicine": 0.0}
    assert [(r.case_id, r.pos, r.status, r.error) for r in done.failures.collect()] == [
        (2, 0, "unparsed", None)]


def test_a_failing_first_seat_keeps_the_others_in_their_places(spark):
    def reviewer(batch):
        if (batch["specialty"] == "Endocrinologist").any():
            if len(batch) > 1:
                raise ValueError("one at a time")
            raise RuntimeError("Rate limit reached")
        return ['["no object"]' if s == "Internal Medicine" else nephro
                for s in batch["specialty"]]

    nephro = json.dumps(NEPHRO)
    done = assess(cases(spark), src.default_indicator_map(spark), reviewer)
    failed = {(r.case_id, r.pos): r for r in done.failures.collect()}
    assert failed.keys() == {(1, 0), (2, 0)}
    assert failed[1, 0].agent_name == "specialist_endocrinologist"
    assert (failed[1, 0].status, failed[1, 0]["class"]) == ("error", "rate_limit")
    assert failed[1, 0].error == "RuntimeError: Rate limit reached"
    assert (failed[2, 0].status, failed[2, 0].raw) == ("failed", '["no object"]')
    first, second = done.assessments.orderBy("case_id").collect()
    assert first.consensus.per_specialty == {"Endocrinologist": 0.0, "Nephrologist": 0.85}
    assert (second.seats, second.specialist_opinions) == ([], [])

    # A seat without a usable answer is announced and starts, but is never done.
    lost = done.assessments.where("case_id = 1").withColumn(
        "specialist_opinions", F.slice("specialist_opinions", 2, 1)).withColumn(
        "seats", F.slice("seats", 2, 1))
    trace = [(r.type, r.agent_name, json.loads(r.data)) for r in emit_trace(lost).orderBy("seq").collect()]
    spawned = next(d for t, _, d in trace if t == "specialists_spawned")
    assert spawned["count"] == 2
    assert [a for t, a, _ in trace if t == "specialist_thinking"] == [
        "specialist_endocrinologist", "specialist_nephrologist"]
    assert [(a, d["specialty"]) for t, a, d in trace if t == "specialist_done"] == [
        ("specialist_nephrologist", "Nephrologist")]


def test_extractive_cases_and_their_trace(spark, tmp_path):
    done = assess(cases(spark), src.default_indicator_map(spark))
    path = str(tmp_path / "assessments")
    src.write_assessments(done.assessments, path)
    stored = spark.read.parquet(path)
    first = stored.orderBy("case_id").first()
    assert first.safety_report.is_safe
    trace = emit_trace(stored).where("case_id = 1").orderBy("seq").collect()
    assert [r.seq for r in trace] == list(range(len(trace)))
    assert [r.type for r in trace] == [
        "triage_thinking", "triage_done", "specialists_spawned", "specialist_thinking",
        "specialist_thinking", "specialist_done", "specialist_done", "consensus_done",
        "discussion_summary", "judge_thinking", "judge_done", "safety_thinking", "safety_done",
        "pipeline_complete"]
    assert json.loads(trace[2].data) == {
        "specialties": ["Endocrinologist", "Nephrologist"],
        "lead_specialist": "Endocrinologist", "count": 2}
    assert json.loads(trace[3].data)["message"] == (
        "Analyzing from Endocrinologist (Lead) perspective...")


def test_json_text_sink(spark, tmp_path):
    df = spark.createDataFrame([(1, "x", 0.5)], "case_id BIGINT, part STRING, score DOUBLE")
    path = str(tmp_path / "out")
    src.write_assessments(df, path, "json_text", ("part",))
    row = spark.read.parquet(path).first()
    assert (row.case_id, row.part, json.loads(row.assessment)) == (1, "x", {"score": 0.5})


def test_bucketed_cases_are_not_shuffled(spark, tmp_path):
    import re
    import uuid

    from quorate.operators.grounding import classify_verdicts
    name = f"cases_{uuid.uuid4().hex}"
    bucketed = src.write_bucketed(cases(spark), name, 4, str(tmp_path / "cases"))
    claims = spark.range(50).select(
        (F.col("id") % 3 + 1).alias("case_id"), F.col("id").alias("claim_no"),
        F.lit("S").alias("specialist"), F.lit("weather").alias("claim"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        verdicts = classify_verdicts(claims, bucketed)
        plan = verdicts._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall("Exchange hashpartitioning", plan)) == 1
        assert verdicts.where("verdict = 'SAFE'").count() == 17
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        spark.sql(f"DROP TABLE {name}")


def test_readers_use_declared_schemas(spark, tmp_path):
    path = str(tmp_path / "in")
    cases(spark).write.json(path)
    assert src.read_cases(spark, path).count() == 3
    responses = str(tmp_path / "responses")
    spark.range(2).select(
        F.col("id").alias("case_id"), F.lit(0).alias("pos"), F.lit("a").alias("agent_name"),
        F.lit("[not json").alias("raw")).write.json(responses)
    assert [r.raw for r in src.read_responses(spark, responses).collect()] == ["[not json"] * 2


def test_scripted_stages_end_to_end(spark):
    triage_answer = json.dumps({
        "specialties": [{"name": "Endocrinologist", "reason": "sugar"},
                        {"name": "Nephrologist", "reason": "kidney"}],
        "rationale": "both organs"})
    opinions = {o["specialty"]: json.dumps(o) for o in (ENDO, NEPHRO)}
    judge_answer = json.dumps({"final_summary": "Both agree.",
                               "consolidated_recommendations": ["Step the insulin up."]})
    safety_answer = json.dumps({
        "verified_findings": ["last HbA1c was 8.7%"], "flagged_issues": [
            {"specialist": "Endocrinologist", "claim": "Eyes are affected", "issue": "not found"}],
        "final_summary": "One claim is not covered.", "overall_confidence": 0.6, "is_safe": False})

    def one(answer, *needed):
        def fn(batch):
            # What a stage has to be told, or it refuses.
            return [answer if all(n in text for n in needed) else "missing input"
                    for text in batch["input"]]
        return fn

    done = assess(
        cases(spark).where("case_id = 1"), src.default_indicator_map(spark), scripted(opinions),
        triager=one(triage_answer, "## Question", "Which doses", "AKI since Monday"),
        judge=one(judge_answer, "Filtration fell", "## Lead Specialist\nEndocrinologist",
                  "agreement_score", "AKI since Monday"),
        safety=one(safety_answer, "Both agree.", "AKI since Monday"))
    assert done.failures.count() == 0
    row = done.assessments.first()
    # The answer names no lead: the first specialty leads.
    assert row.lead_specialist == row.supervisor.lead_specialist == "Endocrinologist"
    assert row.supervisor.rationale == "both organs"
    assert (row.consensus.mean_confidence, row.consensus.level) == (0.875, "strong")
    assert row.judge_report.final_summary == "Both agree."
    assert row.judge_report.key_findings_by_specialty is None
    assert row.safety_report.is_safe is False and row.safety_report.overall_confidence == 0.6
    assert row.safety_report.flagged_issues[0].claim == "Eyes are affected"


def test_failing_stages_leave_their_part_empty(spark):
    def broken(batch):
        raise ConnectionError("Connection error.")

    done = assess(cases(spark).where("case_id = 1"), src.default_indicator_map(spark),
                  triager=broken, judge=lambda batch: ["no report"] * len(batch), safety=broken)
    row = done.assessments.first()
    assert (row.supervisor, row.judge_report, row.safety_report) == (None, None, None)
    assert row.asked == ["Internal Medicine"]
    assert {(r.agent_name, r.status, r["class"]) for r in done.failures.collect()} == {
        ("supervisor_agent", "error", "connectivity"), ("judge_agent", "unparsed", "other"),
        ("safety_agent", "error", "connectivity")}


def test_streamed_tokens_of_a_trace_join_to_the_answers(spark):
    done = assess(cases(spark), src.default_indicator_map(spark))
    trace = emit_trace(done.assessments, streamed=True).where(
        "agent_name <> 'orchestrator' AND agent_name <> ''").orderBy("case_id", "seq").collect()
    spoken, answers = {}, {}
    for r in trace:
        if r.type == "agent_stream":
            spoken.setdefault((r.case_id, r.agent_name), []).append(json.loads(r.data)["token"])
        elif r.type.endswith("_done") and r.data:
            answers[r.case_id, r.agent_name] = r.data
            assert "".join(spoken[r.case_id, r.agent_name]) == r.data
    assert answers and answers.keys() == spoken.keys()
    assert any(len(tokens) > 3 for tokens in spoken.values())
    plain = emit_trace(done.assessments).drop("seq").collect()
    whole = emit_trace(done.assessments, streamed=True)
    assert sorted(map(str, plain)) == sorted(
        map(str, whole.where("type <> 'agent_stream'").drop("seq").collect()))


def test_tokens_get_their_json_outside_the_list(spark):
    """In the list it would be written for tokens that a reader filters out, too."""
    done = assess(cases(spark), src.default_indicator_map(spark))
    trace = emit_trace(done.assessments, streamed=True).where("type <> 'agent_stream'")
    plan = trace._jdf.queryExecution().optimizedPlan().toString()
    (log,) = [line for line in plan.splitlines() if "Generate" in line and "agent_stream" in line]
    assert "token," not in log


def test_a_text_is_cut_into_tokens_without_loss(spark):
    texts = ["", "  a  b", "one", "a\nb \t c ", " \n ", None, "é 中 x"]
    df = spark.createDataFrame([(t,) for t in texts], "t STRING")
    got = df.select("t", tokens_of(F.col("t")).alias("k")).collect()
    assert all("".join(r.k) == (r.t or "") for r in got)


def test_seats_are_numbered_before_answers_are_written_out(spark):
    plan = b.seats(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Window", 1)
    assert "No JSON from" in above and "No JSON from" not in below
