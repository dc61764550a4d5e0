"""One case holding a third of all rows: same results, and no plan that gathers it."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from quorate.operators import agreement as ag
from quorate.operators import consolidate as co
from quorate.operators import events as ev
from quorate.operators import grounding as gr
from quorate.operators import triage as tr
from quorate.sources import tables as src

ROWS = 30_000


@pytest.fixture(scope="module")
def opinions(spark):
    hot = F.col("id") % 3 == 0
    return spark.range(ROWS).select(
        F.when(hot, -1).otherwise(F.col("id") % 5000).alias("case_id"), F.col("id").alias("pos"),
        F.concat(F.lit("S"), F.col("id") % 7).alias("specialty"),
        ((F.col("id") * 7919) % 11 / 10).alias("confidence"),
    ).cache()


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def windows_by_case(df) -> list[str]:
    return [line for line in plan_of(df).splitlines()
            if re.search(r"\bWindow \[", line) and "case_id" in line]


def test_moments_combine_before_the_shuffle(opinions):
    plan = plan_of(ag.panel_agreement(opinions))
    assert plan.index("partial_") > plan.index("Exchange")
    assert windows_by_case(ag.flag_outliers(opinions)) == []


def test_hot_panel_results(opinions):
    import numpy as np
    pdf = opinions.toPandas()
    scored = {r.case_id: r for r in ag.panel_agreement(opinions).collect()}
    flagged = {r.case_id: r["count"] for r in
               ag.flag_outliers(opinions).groupBy("case_id").count().collect()}
    for case, rows in pdf.groupby("case_id"):
        u = np.round(rows.confidence.to_numpy() * 1e6).astype(object)
        u = u[u > 0]
        assert scored[case].participating == len(u)
        if not len(u):
            continue
        n, s1, s2 = len(u), int(sum(u)), int(sum(x * x for x in u))
        v = n * s2 - s1 * s1
        expected = sum((n * x - s1) ** 2 > v and abs(n * x - s1) > n * 150_000 for x in u)
        assert flagged.get(case, 0) == expected
    names = ag.confidence_by_specialty(opinions)
    last = pdf.sort_values("pos").groupby(["case_id", "specialty"]).confidence.last()
    assert {(r.case_id, r.specialty): r.confidence for r in names.collect()} == last.to_dict()


def test_hot_conflicts_stay_linear(spark, opinions):
    facts = opinions.select("case_id", "pos", "specialty", F.lit("x").alias("attribute"),
                            (F.col("pos") % 2).cast("string").alias("value"))
    team = spark.createDataFrame([(-1, "S1", True)], "case_id BIGINT, specialty STRING, is_lead BOOLEAN")
    hot = co.conflicting_values(facts, team).where("case_id = -1").orderBy("value").collect()
    assert [(r.value, r.stated, r.preferred) for r in hot] == [
        ("0", ROWS // 6, True), ("1", ROWS // 6, True)]


def test_hot_event_log_is_cut_into_blocks(spark):
    log = spark.range(ROWS).select(
        F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 500).alias("case_id"),
        F.col("id").alias("seq"), F.timestamp_seconds("id").alias("ts"),
        F.when(F.col("id") % 10 < 2, "specialists_spawned").otherwise("specialist_done").alias("type"),
        F.concat(F.lit("specialist_a"), F.col("id") % 4).alias("agent_name"),
        F.concat(F.lit('{"specialties": ["A'), F.col("id") % 4, F.lit('"]}')).alias("data"),
    )
    blocked = ev.orphan_events(log, block=500)
    whole = ev.orphan_events(log, block=ROWS + 1)
    assert blocked.count() == whole.count()
    assert blocked.exceptAll(whole).count() == 0
    # Rows are only ever sorted inside a block; across blocks a window sees block rows.
    for line in windows_by_case(blocked):
        assert "_block" in line


def test_copies_of_a_claim_are_checked_once(spark):
    docs = spark.createDataFrame([(i, "one two three four five") for i in range(50)],
                                 "doc_id BIGINT, text STRING")
    claims = spark.range(3000).select(
        F.col("id").alias("claim_id"),
        F.when(F.col("id") % 3 == 0, "Two three four").otherwise(
            F.concat(F.lit("own text "), "id")).alias("claim"))
    assert gr.corpus_matches(claims, docs, n=2).count() == 50
    found = gr.ground_claims_corpus(claims, docs, n=2)
    assert found.where("grounded").agg(F.count("*"), F.min("n_docs")).first() == (1000, 50)


def test_hot_case_of_documents_is_counted_not_gathered(spark):
    docs = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("case_id"),
        F.col("id").cast("int").alias("pos"), F.lit("ecg and more ecg").alias("text"))
    roles = src.default_indicator_map(spark)
    hits = tr.match_indicators(docs, roles)
    assert hits.where("case_id = -1").first().hits == 2000
    plan = plan_of(hits)
    assert "partial_count" in plan and "collect_list" not in plan
