"""Declared schemas of every table, as DDL text."""

CASES = "case_id BIGINT, question STRING, documents ARRAY<STRING>"

RESPONSES = "case_id BIGINT, pos INT, agent_name STRING, raw STRING"

EVENTS = (
    "case_id BIGINT, seq BIGINT, ts TIMESTAMP, type STRING, "
    "agent_name STRING, data STRING"
)

TRIAGE = (
    "STRUCT<specialties: ARRAY<STRUCT<name: STRING, reason: STRING>>, "
    "lead_specialist: STRING, rationale: STRING>"
)

OPINION = (
    "STRUCT<specialty: STRING, findings: STRING, recommendation: STRING, "
    "evidence_quotes: ARRAY<STRING>, confidence: DOUBLE>"
)

CONSENSUS = (
    "STRUCT<agreement_score: DOUBLE, level: STRING, mean_confidence: DOUBLE, "
    "confidence_spread: DOUBLE, participating: BIGINT, abstained: BIGINT, "
    "per_specialty: MAP<STRING, DOUBLE>, outliers: ARRAY<STRING>>"
)

JUDGE = (
    "STRUCT<final_summary: STRING, "
    "key_findings_by_specialty: MAP<STRING, ARRAY<STRING>>, "
    "consolidated_recommendations: ARRAY<STRING>>"
)

SAFETY = (
    "STRUCT<verified_findings: ARRAY<STRING>, "
    "flagged_issues: ARRAY<STRUCT<specialist: STRING, claim: STRING, issue: STRING>>, "
    "final_summary: STRING, overall_confidence: DOUBLE, is_safe: BOOLEAN>"
)

# What the folds read out of an event's open JSON payload.
EVENT_PAYLOAD = (
    "message STRING, token STRING, lead_specialist STRING, "
    "specialties ARRAY<STRING>, count INT, confidence STRING"
)
