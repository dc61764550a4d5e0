"""One query per operator over the given tables.

Arrays and maps are returned as joined text, whole numbers as BIGINT.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quorate.functions.scale import computed_once
from quorate.operators import agreement as ag
from quorate.operators import consolidate as co
from quorate.operators import contracts as ct
from quorate.operators import events as ev
from quorate.operators import grounding as gr
from quorate.operators import prepare as pr
from quorate.operators import review as rv
from quorate.operators import triage as tr
from quorate.plans import bindings as b
from quorate.plans.assess import assess, concluded
from quorate.session import configure, scratch_path, stored
from quorate.sources import tables as src
from quorate.streaming import folds
from quorate.streaming.sources import on_batch, stream_events

Query = Callable[[SparkSession, str], DataFrame]

STALL_SECONDS = 86_400
# Specialists a spawn announces at most in the queries on large panels.
LARGE_PANEL = 15


def _plain(df: DataFrame) -> DataFrame:
    """Whole numbers as BIGINT, so both engines report one type."""
    small = (T.IntegerType, T.ShortType, T.ByteType)
    return df.select(*[
        F.col(f.name).cast("bigint").alias(f.name) if isinstance(f.dataType, small)
        else F.col(f.name) for f in df.schema.fields
    ])


def _line_pos(df: DataFrame) -> DataFrame:
    return df.select("*", "pos.l_linenumber", "pos.l_suppkey", "pos.l_partkey").drop("pos")


def role_map(spark: SparkSession) -> DataFrame:
    return src.indicator_map_from_text(spark, b.ROLE_WORDS)


# --- A: sources and sinks ------------------------------------------------------

def a1_read_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "cases")
    b.document_cases(spark, sf_dir).write.json(path)
    cases = src.read_cases(spark, path, "json")
    return cases.select(
        "case_id", "question", F.size("documents").alias("n_documents"),
        F.md5(pr.combined(F.col("documents"))).alias("documents_md5"),
    )


def a2_indicator_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "map")
    b.map_lines(spark, sf_dir).write.text(path)
    return src.read_indicator_map(spark, path)


def a3_read_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "responses")
    rows = b.seats(spark, sf_dir).drop("asked")
    rows.withColumn("agent_name", F.concat(F.lit("specialist_"), "pos")).write.json(
        path, compression="gzip")
    return src.read_responses(spark, path)


def _replayed(spark: SparkSession, log: DataFrame, drain: Callable[[str], None],
              slices: int = 3) -> None:
    """Let a log arrive in slices of ``seq``, draining the stream after each.

    Every drain is a new query that goes on from the checkpoint of the last.
    """
    path = scratch_path(spark, "arriving")
    low, high = log.agg(F.min("seq"), F.max("seq")).first()
    width = (high - low) // slices + 1
    for i in range(slices):
        start = low + i * width
        arrived = log.where((F.col("seq") >= start) & (F.col("seq") < start + width))
        arrived.write.mode("append").parquet(path)
        drain(path)


def _drained(spark: SparkSession, log: DataFrame,
             stream_of: Callable[[str], DataFrame]) -> DataFrame:
    """The rows an append stream has written once the whole log has arrived."""
    out, checkpoint = scratch_path(spark, "stream-out"), scratch_path(spark, "checkpoint")
    schema = []

    def drain(path: str) -> None:
        stream = stream_of(path)
        schema.append(stream.schema)
        (stream.writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start(out).awaitTermination())

    _replayed(spark, log, drain)
    return spark.read.schema(schema[-1]).parquet(out)


def a4_stream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = _drained(spark, b.events(spark, sf_dir),
                     lambda path: stream_events(spark, path, "parquet")[0])
    return known.groupBy("type").agg(
        F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"),
        F.max("seq").alias("last_seq"),
    )


def a5_write_assessments(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "assessments")
    checked = pr.case_problems(b.document_cases(spark, sf_dir))
    nested = checked.select(
        "case_id", F.when(F.size("problems") == 0, "ok").otherwise("rejected").alias("state"),
        F.struct("question", "problems").alias("request"),
    )
    src.write_assessments(nested, path, "json_text", ("state",))
    return spark.read.parquet(path).select("case_id", "state", "assessment")


# --- B: case preparation -------------------------------------------------------

def b1_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = b.case_docs(spark, sf_dir)
    return pr.case_problems_long(b.questions(docs), docs).select(
        "case_id", "documents", "total_chars", F.array_join("problems", "|").alias("problems")
    )


def b1_validate_lax(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid, rejected = pr.validate_cases(b.document_cases(spark, sf_dir), strict=False)
    return valid.select("case_id", F.lit("").alias("problems")).unionByName(
        rejected.select("case_id", F.array_join("problems", "|").alias("problems"))
    )


def b2_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = b.texts(spark, sf_dir)
    return pr.split_documents(docs, r"\n+")


def b3_combine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pr.combine_documents(b.case_docs(spark, sf_dir))


# --- C: triage -----------------------------------------------------------------

def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.match_indicators(b.case_docs(spark, sf_dir), role_map(spark))


def c1_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir)


def c2_team(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.select_team(_hits(spark, sf_dir))


def c2_sized_team(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.select_sized_team(_hits(spark, sf_dir))


def c3_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Both branches go by the hits, so the texts are matched once.
    hits = stored(_hits(spark, sf_dir), "hits")
    return tr.require_support_roles(tr.select_team(hits, 2), hits)


def c3_support_one_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.choose_team(_hits(spark, sf_dir), 2)


def _led(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.designate_lead(tr.choose_team(_hits(spark, sf_dir)), role_map(spark))


def c4_lead(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _led(spark, sf_dir).select("case_id", "pos", "specialty", "is_lead")


def c5_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = b.texts(spark, sf_dir).select(
        F.col("doc_id").alias("case_id"), F.lit(0).alias("pos"), "text")
    roles = role_map(spark)
    team = tr.designate_lead(tr.select_team(tr.match_indicators(docs, roles)), roles)
    return tr.apply_fallback_team(docs, team).select("case_id", "pos", "specialty", "is_lead")


def c6_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.panels(spark, sf_dir).select("case_id", "pos", "specialty")


def _worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.build_worklist(b.document_cases(spark, sf_dir), _led(spark, sf_dir))


def c7_worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _worklist(spark, sf_dir).select(
        "case_id", "pos", "specialty", "is_lead", "agent_name", "role_label",
        F.length("input").alias("input_chars"), F.md5("input").alias("input_md5"),
    )


# --- D: reviewing and contracts ------------------------------------------------

def count_reviewer(batch: pd.DataFrame) -> list[str]:
    """A stand-in reviewer: reports input sizes, knows no pharmacists."""
    if (batch["specialty"] == "Pharmacist").any():
        raise ValueError("no reviewer for Pharmacist")
    return [f'{{"specialty": "{s}", "chars": {len(t)}}}'
            for s, t in zip(batch["specialty"], batch["input"])]


def d1_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rv.review_with(_worklist(spark, sf_dir), count_reviewer, max_retries=1)


def d2_extractive(spark: SparkSession, sf_dir: str) -> DataFrame:
    opinions = rv.extractive_review(
        b.document_cases(spark, sf_dir), _led(spark, sf_dir), role_map(spark))
    return opinions.select(
        "case_id", "pos", "specialty", F.md5("findings").alias("findings_md5"),
        "recommendation", F.size("evidence_quotes").alias("quotes"),
        F.md5(F.array_join("evidence_quotes", "|")).alias("quotes_md5"), "confidence",
    )


def d3_opinions(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = ct.parse_responses(b.answers(spark, sf_dir), "opinion")
    return _line_pos(parsed.select(
        "case_id", "pos", "status", "valid", "specialty", "findings", "recommendation",
        F.array_join("evidence_quotes", "|").alias("quotes"), "confidence",
    ))


def d3_judge(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = ct.parse_responses(b.judge_answers(spark, sf_dir), "judge")
    by_name = F.transform(
        F.map_entries("key_findings_by_specialty"),
        lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], ",")))
    return parsed.select(
        "case_id", "status", "valid", "final_summary",
        F.array_join("consolidated_recommendations", "|").alias("recommendations"),
        F.array_join(F.sort_array(by_name), "|").alias("findings"),
    )


def d3_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = ct.parse_responses(b.safety_answers(spark, sf_dir), "safety")
    issues = F.transform(
        "flagged_issues", lambda i: F.concat_ws("/", i["specialist"], i["claim"], i["issue"]))
    return parsed.select(
        "case_id", "pos.l_linenumber", "pos.l_suppkey", "pos.l_partkey", "status", "valid",
        F.array_join("verified_findings", "|").alias("verified"),
        F.array_join(issues, "|").alias("flagged"),
        "final_summary", "overall_confidence", "is_safe",
    )


def d4_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = ct.parse_responses(b.triage_answers(spark, sf_dir), "triage")
    return ct.backfill_lead(parsed).select(
        "case_id", "status", "lead_specialist", "rationale",
        F.array_join(F.transform("specialties", lambda s: s["name"]), "|").alias("names"),
    )


def d5_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _line_pos(ct.answered_opinions(b.answers(spark, sf_dir)).select(
        "case_id", "pos", "status", "confidence"))


# --- E: agreement --------------------------------------------------------------

def e1_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ag.panel_agreement(b.opinions(spark, sf_dir), b.order_cases(spark, sf_dir)).drop("level")


def e1_agreement_of_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ag.panel_agreement(ct.answered_opinions(b.answers(spark, sf_dir)))


def e2_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = ag.panel_agreement(b.opinions(spark, sf_dir), b.order_cases(spark, sf_dir))
    return scored.select("case_id", "level")


def e2_level_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e2_levels(spark, sf_dir).groupBy("level").agg(F.count(F.lit(1)).alias("panels"))


def e3_by_specialty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ag.confidence_by_specialty(b.opinions(spark, sf_dir))


def e4_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _line_pos(ag.flag_outliers(b.opinions(spark, sf_dir)))


def e5_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ag.panel_breakdown(b.opinions(spark, sf_dir))


# --- F: consolidation ----------------------------------------------------------

def _answered(seated: DataFrame) -> DataFrame:
    """Every usable answer of the seats that were asked."""
    return ct.answered_opinions(seated.select("case_id", "pos", "raw"))


def f1_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = co.key_findings_by_specialty(_answered(b.seats(spark, sf_dir)))
    return found.select(
        "case_id", F.explode("key_findings_by_specialty").alias("specialty", "findings")
    ).withColumn("findings", F.array_join("findings", "|"))


def f2_recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    seated = b.seats(spark, sf_dir)
    return co.consolidate_recommendations(_answered(seated), b.asked_team(seated)).withColumn(
        "supporters", F.array_join("supporters", ","))


def f3_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = b.case_docs(spark, sf_dir).select(
        "case_id", "pos", F.concat(F.lit("D"), "pos").alias("specialty"),
        F.col("text").alias("findings"))
    return co.find_overlaps(panel, 0.05)


def f4_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = stored(b.panel_facts(spark, sf_dir), "facts")
    # More pairs than an order has lines for: every pair is written out.
    return co.find_conflicts(facts, b.panel_leads(facts), most=10_000)


def f4_conflicting_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = stored(b.panel_facts(spark, sf_dir), "facts")
    leads = stored(b.panel_leads(b.panels(spark, sf_dir)), "leads")
    return co.conflicting_values(facts, leads)


def f5_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = b.opinions(spark, sf_dir)
    return co.divergence_notes(ag.panel_agreement(panel), ag.flag_outliers(panel))


# --- G: grounding --------------------------------------------------------------

def g1_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = gr.quotes_as_claims(b.line_quotes(spark, sf_dir))
    return gr.ground_quotes(claims, b.single_cases(spark, sf_dir)).drop("claim")


def g2_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = b.table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("claim_id"), F.col("text").alias("claim"))
    docs = b.texts(spark, sf_dir)
    return gr.ground_claims_corpus(claims, docs)


def g3_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = b.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("entity"), F.lit("total").alias("attribute"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("value"))
    line = b.table(spark, sf_dir, "lineitem")
    price = F.col("l_extendedprice").cast("decimal(12,2)")
    off = F.lit(1).cast("decimal(3,2)") - F.col("l_discount").cast("decimal(3,2)")
    tax = F.lit(1).cast("decimal(3,2)") + F.col("l_tax").cast("decimal(3,2)")
    evidence = line.groupBy(F.col("l_orderkey").alias("entity")).agg(
        F.sum(price * off * tax).alias("value")
    ).select("entity", F.lit("total").alias("attribute"), "value")
    return gr.check_values(claims, evidence).select("entity", "attribute", "verdict")


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.classify_verdicts(b.line_claims(spark, sf_dir), b.single_cases(spark, sf_dir))


def g4_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verdicts(spark, sf_dir).drop("claim")


def g5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.safety_report(_verdicts(spark, sf_dir)).select(
        "case_id", F.md5(F.array_join("verified_findings", "|")).alias("verified_md5"),
        F.array_join(F.transform("flagged_issues", lambda i: F.concat_ws(
            ":", i["specialist"], i["issue"])), "|").alias("flagged"),
        "overall_confidence", "is_safe",
    )


def g5_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.safety_summary(_verdicts(spark, sf_dir))


# --- H: events -----------------------------------------------------------------

def _panel_assessments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assessments of order panels: triage, answers, agreement, consolidation."""
    answers = stored(ct.parse_responses(b.seats(spark, sf_dir), "opinion"), "answers")
    panel = ct.clean_confidence(answers.where(F.col("status") != "failed"))
    parts = b.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("n"),
        F.concat(F.lit("part "), "l_partkey").alias("text"))
    documents = parts.groupBy("case_id").agg(
        F.sort_array(F.collect_list(F.struct("n", "text"))).alias("parts")
    ).select("case_id", F.col("parts.text").alias("documents"))
    cases = b.order_cases(spark, sf_dir).join(documents, "case_id", "left")
    team = b.asked_team(answers)
    return concluded(stored(cases, "cases"), team, team, panel)


def _trace_fields(events: DataFrame) -> DataFrame:
    """Four fields of every payload, by one reading of it."""
    told = "lead_specialist STRING, message STRING, count STRING, findings STRING"
    return computed_once(events, _told=F.from_json("data", told)).select(
        "case_id", "seq", "type", "agent_name",
        F.col("_told.lead_specialist").alias("lead"), "_told.message", "_told.count",
        "_told.findings",
    )


def h1_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trace_fields(ev.emit_trace(stored(_panel_assessments(spark, sf_dir), "assessments")))


def _trace(spark: SparkSession, sf_dir: str, tokens: bool = True) -> DataFrame:
    """The log of the order panels, with the tokens of every answer for those who read them.

    Every reader passes over it once, so neither it nor the assessments are stored: what
    a reader leaves out is never written, and what it groups by case stands together
    already, by the joins of the assessments, and is not shuffled again.
    """
    return ev.emit_trace(_panel_assessments(spark, sf_dir), streamed=True, tokens=tokens)


def h2_stages_of_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.stage_status(_trace(spark, sf_dir, tokens=False)).where(F.col("specialty").isNotNull()).select(
        "case_id", "stage", "specialty", "status",
        F.get_json_object("data", "$.findings").alias("findings"),
    )


def h2_cases_of_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.case_status(_trace(spark, sf_dir, tokens=False)).select(
        "case_id", "lead_specialist", "spawned", "complete", "error",
        F.get_json_object("consensus", "$.level").alias("level"),
        F.get_json_object("safety_report", "$.is_safe").alias("is_safe"),
    )


def h3_drafts_of_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the specialists' drafts say, put together from their tokens."""
    drafts = ev.assemble_drafts(ev.draft_tokens(_trace(spark, sf_dir)))
    said = F.regexp_extract_all("draft", F.lit('"findings":"([^"]*)"'), F.lit(1))
    return drafts.where(F.col("agent_name").startswith("specialist_")).select(
        "case_id", "agent_name", F.array_join(said, "|").alias("findings"))


def h2_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.stage_status(b.events(spark, sf_dir))


def h2_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.case_status(b.events(spark, sf_dir))


def h2_stages_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, checkpoint = scratch_path(spark, "registers"), scratch_path(spark, "checkpoint")

    def drain(path: str) -> None:
        known, _ = stream_events(spark, path, "parquet")
        folds.fold_registers(known, out, checkpoint).awaitTermination()

    _replayed(spark, b.events(spark, sf_dir), drain)
    return ev.stages_from_registers(folds.stored_registers(spark, out))


def h3_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.assemble_drafts(b.tokens(spark, sf_dir))


def h3_drafts_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = b.tokens(spark, sf_dir)
    out, checkpoint = scratch_path(spark, "drafts"), scratch_path(spark, "checkpoint")

    def drain(path: str) -> None:
        stream = spark.readStream.schema(tokens.schema).parquet(path)
        folds.fold_drafts(stream, out, checkpoint).awaitTermination()

    _replayed(spark, tokens, drain)
    return folds.stored_drafts(spark, out)


def h4_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.orphan_events(b.events(spark, sf_dir), b.EVENT_BLOCK).select(
        "case_id", "seq", "type", "agent_name")


def h5_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.stage_latency(b.events(spark, sf_dir), block=b.EVENT_BLOCK)


def h6_barrier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.barrier_agreement(b.events(spark, sf_dir))


def h6_barrier_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.barrier_agreement(b.events(spark, sf_dir, LARGE_PANEL))


def h6_barrier_large_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = b.events(spark, sf_dir, LARGE_PANEL)
    return _drained(spark, log, lambda path: folds.stream_panel_agreement(
        stream_events(spark, path, "parquet")[0]))


def h6_barrier_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drained(spark, b.events(spark, sf_dir), lambda path: folds.stream_panel_agreement(
        stream_events(spark, path, "parquet")[0]))


def h7_stalled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.stalled_agents(b.events(spark, sf_dir), STALL_SECONDS, b.EVENT_BLOCK).select(
        "case_id", "stage", "agent_name", "seq")


def h7_stalled_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    stalled = _drained(spark, b.events(spark, sf_dir), lambda path: folds.stream_stalled_agents(
        stream_events(spark, path, "parquet")[0], STALL_SECONDS, "1 hour"))
    return stalled.select("case_id", "stage", "agent_name", "seq")


def h8_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.classify_failures(b.failures(spark, sf_dir))


# --- I: assembly ---------------------------------------------------------------

def i1_assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _panel_assessments(spark, sf_dir)
    by_name = F.transform(
        F.map_entries("consensus.per_specialty"),
        lambda e: F.concat_ws("=", e["key"], F.bround(e["value"], 1).cast("string")))
    return rows.select(
        "case_id", "lead_specialist",
        F.array_join(F.transform("supervisor.specialties", lambda s: s["name"]), ",")
        .alias("specialties"), "supervisor.rationale",
        F.array_join(F.transform("specialist_opinions", lambda o: F.coalesce(
            o["findings"], F.lit("-"))), "|").alias("findings"),
        "consensus.agreement_score", "consensus.level", "consensus.participating",
        "consensus.abstained",
        F.array_join(by_name, ",").alias("per_specialty"),
        F.array_join("consensus.outliers", ",").alias("outliers"),
        F.col("judge_report.final_summary").alias("note"),
        F.array_join("judge_report.consolidated_recommendations", "|").alias("recommendations"),
        F.size("safety_report.verified_findings").alias("verified"),
        F.size("safety_report.flagged_issues").alias("flagged"),
        "safety_report.is_safe",
    )


def i1_assess_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole chain from documents to assessments."""
    docs = b.case_docs(spark, sf_dir)
    cases = stored(pr.nest_accepted(b.questions(docs), docs), "cases")
    rows = assess(cases, role_map(spark)).assessments
    return rows.select(
        "case_id", "lead_specialist", F.size("specialist_opinions").alias("panel"),
        "consensus.agreement_score", "consensus.level",
        F.size("safety_report.verified_findings").alias("verified"),
        F.size("safety_report.flagged_issues").alias("flagged"), "safety_report.is_safe",
    )


def i1_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reviewer that knows no pharmacists could not answer."""
    done = assess(b.document_cases(spark, sf_dir), role_map(spark), count_reviewer)
    return done.failures.select("case_id", "pos", "agent_name", "status", "error", "class")


def i2_callback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A callback that keeps the per-type counts of every micro-batch."""
    out, checkpoint = scratch_path(spark, "callback"), scratch_path(spark, "checkpoint")

    def keep(rows: DataFrame, batch_id: int) -> None:
        rows.groupBy("type").count().write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    def drain(path: str) -> None:
        known, _ = stream_events(spark, path, "parquet")
        on_batch(known, keep, checkpoint).awaitTermination()

    _replayed(spark, b.events(spark, sf_dir), drain)
    return spark.read.parquet(out).groupBy("type").agg(F.sum("count").alias("n"))


QUERIES: dict[str, Query] = {
    f.__name__: f for f in (
        a1_read_cases, a2_indicator_map, a3_read_responses, a4_stream_events, a5_write_assessments,
        b1_validate, b1_validate_lax, b2_split, b3_combine,
        c1_hits, c2_team, c2_sized_team, c3_support, c3_support_one_pass, c4_lead, c5_fallback,
        c6_cap, c7_worklist,
        d1_review, d2_extractive, d3_opinions, d3_judge, d3_safety, d4_backfill, d5_clean,
        e1_agreement, e1_agreement_of_answers, e2_levels, e2_level_counts,
        e3_by_specialty, e4_outliers, e5_breakdown,
        f1_findings, f2_recommendations, f3_overlaps, f4_conflicts, f4_conflicting_values,
        f5_divergence,
        g1_quotes, g2_corpus, g3_values, g4_verdicts, g5_report, g5_summary,
        h1_trace, h2_stages, h2_cases, h2_stages_streamed, h2_stages_of_trace, h2_cases_of_trace,
        h3_drafts, h3_drafts_streamed, h3_drafts_of_trace,
        h4_orphans, h5_latency, h6_barrier, h6_barrier_streamed, h6_barrier_large,
        h6_barrier_large_streamed, h7_stalled,
        h7_stalled_streamed, h8_failures,
        i1_assemble, i1_assess_documents, i1_failures, i2_callback,
    )
}


def registered() -> dict[str, Query]:
    def wrap(query: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return _plain(query(configure(spark), sf_dir.rstrip("/")))
        run.__name__ = query.__name__
        return run

    return {name: wrap(query) for name, query in QUERIES.items()}
