from __future__ import annotations

import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quorate.functions.text import ngrams, words
from quorate.operators import prepare as pr
from quorate.operators import review as rv
from quorate.operators import triage as tr
from quorate.schemas import CASES
from quorate.sources import tables as src

ROLES = """\
| Specialty | Key Indicators | Lead Potential |
| :--- | :--- | :--- |
| **Cardio** | ECG, heart failure, SOB (shortness of breath). | High |
| **Nephro** | creatinine, AKI. | Medium |
| **Pharmacist** | dosing, drug interactions. | Low |
"""


def problems(spark, question, documents, strict=True):
    df = spark.createDataFrame([(1, question, documents)], CASES)
    return pr.case_problems(df, strict).first().problems


@pytest.mark.parametrize("question, documents, expected", [
    ("why", ["d"], []),
    ("wh", ["d"], ["question_short"]),
    (None, ["d"], ["question_short"]),
    ("w" * 1000, ["d"], []),
    ("w" * 1001, ["d"], ["question_long"]),
    ("why", [], ["no_documents"]),
    ("why", None, ["no_documents"]),
    ("why", ["d"] * 10, []),
    ("why", ["d"] * 11, ["too_many_documents"]),
    ("why", ["d", ""], ["document_empty"]),
    ("why", ["d" * 20_000], []),
    ("why", ["d" * 20_001], ["document_long"]),
    ("why", ["d" * 20_000, "d" * 20_000, "d" * 10_000], []),
    ("why", ["d" * 20_000, "d" * 20_000, "d" * 10_001], ["total_long"]),
])
def test_request_rules(spark, question, documents, expected):
    assert problems(spark, question, documents) == expected


def test_lax_rules_ask_for_presence_only(spark):
    assert problems(spark, "w", ["d" * 99_999], strict=False) == []
    assert problems(spark, "", [], strict=False) == ["question_short", "no_documents"]


def test_long_form_gives_the_same_problems(spark):
    cases = spark.createDataFrame(
        [(1, "why", ["a", ""]), (2, "why", ["d"] * 11), (3, "w", ["x" * 20_001]), (4, "why", None)],
        CASES)
    docs = cases.select("case_id", F.posexplode("documents").alias("pos", "text"))
    long = pr.case_problems_long(cases.select("case_id", "question"), docs)
    pick = ("case_id", "problems")
    assert sorted(long.select(*pick).collect()) == sorted(
        pr.case_problems(cases).select(*pick).collect())


def test_oversized_cases_are_turned_away_before_nesting(spark):
    questions = spark.createDataFrame([(1, "why"), (2, "why")], "case_id BIGINT, question STRING")
    docs = spark.createDataFrame([(1, 1, "b"), (1, 0, "a")] + [(2, i, "x") for i in range(11)],
                                 "case_id BIGINT, pos INT, text STRING")
    rows = pr.nest_accepted(questions, docs).collect()
    assert [(r.case_id, r.documents) for r in rows] == [(1, ["a", "b"])]


def test_split_documents(spark):
    text = "\n\n one \nstill one\n\n\n two\t\n\n \n\nthree"
    rows = pr.split_documents(spark.createDataFrame([(7, text)], "id INT, text STRING"))
    assert [(r.pos, r.text) for r in rows.collect()] == [
        (0, "one \nstill one"), (1, "two"), (2, "three")]


def test_combine_in_order(spark):
    docs = spark.createDataFrame([(1, 1, "b"), (1, 0, "a"), (2, 0, "c")],
                                 "case_id BIGINT, pos INT, text STRING")
    got = {r.case_id: r.combined for r in pr.combine_documents(docs).collect()}
    assert got == {1: "a\n\n---\n\nb", 2: "c"}


def test_indicator_map_file(spark, tmp_path):
    path = tmp_path / "map.md"
    path.write_text("# Title\n\ntext | with a bar\n\n" + ROLES)
    rows = [tuple(r) for r in src.read_indicator_map(spark, str(path)).collect()]
    assert rows[:4] == [("Cardio", "ECG", "High"), ("Cardio", "heart failure", "High"),
                        ("Cardio", "SOB", "High"), ("Cardio", "shortness of breath", "High")]
    assert ("Pharmacist", "drug interactions", "Low") in rows and len(rows) == 8


def test_default_map_has_every_specialty(spark):
    rows = src.default_indicator_map(spark)
    assert rows.select("specialty").distinct().count() == 11
    assert rows.where("specialty = 'Pulmonologist' AND indicator = 'shortness of breath'").count()


def case_docs(spark, *texts):
    return spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)],
                                 "case_id BIGINT, pos INT, text STRING")


def roles(spark):
    return src.indicator_map_from_text(spark, ROLES)


def test_hits_are_whole_words(spark):
    docs = case_docs(spark, "Heart-failure? ECG, ecg. Not ecgs; heart and failure.")
    hits = {(r.specialty, r.indicator): r.hits
            for r in tr.match_indicators(docs, roles(spark)).collect()}
    assert hits == {("Cardio", "ECG"): 2, ("Cardio", "heart failure"): 1}


def test_matching_joins_by_broadcast_without_nested_loops(spark):
    plan = tr.match_indicators(case_docs(spark, "ecg"), roles(spark))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in text
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_team_support_lead_and_fallback(spark):
    docs = case_docs(
        spark, "creatinine AKI ecg dosing dosing drug interactions", "nothing here", "AKI ecg")
    hits = tr.match_indicators(docs, roles(spark))
    top = tr.select_team(hits, 1)
    team = tr.require_support_roles(top, hits)
    one_pass = tr.choose_team(hits, 1)
    pick = ("case_id", "pos", "specialty", "reason", "score", "hits")
    assert sorted(team.select(*pick).collect()) == sorted(one_pass.select(*pick).collect())
    listed = [(r.case_id, r.pos, r.specialty) for r in team.orderBy("case_id", "pos").collect()]
    assert listed == [(0, 0, "Pharmacist"), (2, 0, "Cardio")]
    led = tr.apply_fallback_team(docs, tr.designate_lead(tr.select_team(hits), roles(spark)))
    leads = {r.case_id: r.specialty for r in led.where("is_lead").collect()}
    assert leads == {0: "Cardio", 1: "Internal Medicine", 2: "Cardio"}


def test_support_is_appended_after_the_team(spark):
    rows = [(1, "A", "x", 9), (1, "A", "y", 9), (1, "A", "z", 1), (1, "Radiologist", "i", 1),
            (1, "Radiologist", "j", 1), (1, "Pharmacist", "d", 1), (1, "Pharmacist", "e", 1)]
    hits = spark.createDataFrame(rows, "case_id BIGINT, specialty STRING, indicator STRING, hits BIGINT")
    for team in (tr.require_support_roles(tr.select_team(hits, 1), hits), tr.choose_team(hits, 1)):
        got = [r.specialty for r in team.orderBy("pos").collect()]
        assert got == ["A", "Pharmacist", "Radiologist"]


def worklist(spark):
    cases = spark.createDataFrame([(1, "why", ["a", "b"])], CASES)
    team = spark.createDataFrame(
        [(1, 0, "Infectious Disease", True), (1, 1, "Nephro", False)],
        "case_id BIGINT, pos INT, specialty STRING, is_lead BOOLEAN")
    return tr.build_worklist(cases, team)


def test_worklist(spark):
    lead, other = worklist(spark).orderBy("pos").collect()
    assert lead.agent_name == "specialist_infectious_disease"
    assert (lead.role_label, other.role_label) == ("Infectious Disease (Lead)", "Nephro")
    assert lead.input == "## Clinical Question\nwhy\n\n## Patient Documents\na\n\n---\n\nb"


def test_a_failing_row_does_not_lose_the_others(spark):
    def reviewer(batch: pd.DataFrame) -> list[str]:
        if (batch["specialty"] == "Nephro").any():
            raise RuntimeError("Rate limit reached")
        return ["{}"] * len(batch)

    rows = rv.review_with(worklist(spark), reviewer, max_retries=1, max_concurrency=1)
    good, bad = rows.orderBy("pos").collect()
    assert (good.raw, good.error) == ("{}", None)
    assert (bad.raw, bad.error) == (None, "RuntimeError: Rate limit reached")


def test_retries_are_bounded_and_can_succeed(spark):
    def flaky(batch: pd.DataFrame) -> list[str]:
        flaky_state["calls"] = flaky_state.get("calls", 0) + 1
        if flaky_state["calls"] < 3:
            raise TimeoutError("timeout")
        return [str(flaky_state["calls"])] * len(batch)

    flaky_state: dict[str, int] = {}
    assert rv._answers(pd.DataFrame({"a": [1]}), flaky, 3, None) == ["3"]
    flaky_state.clear()
    lost = rv._answers(pd.DataFrame({"a": [1]}), flaky, 1, None)
    assert [str(e) for e in lost] == ["timeout"] and flaky_state["calls"] == 2


def test_only_failed_rows_are_asked_again():
    calls = []

    def picky(batch: pd.DataFrame) -> list:
        calls.append(list(batch["a"]))
        return [ValueError("seven") if a == 7 else str(a) for a in batch["a"]]

    got = rv._answers(pd.DataFrame({"a": range(20)}), picky, 3, None)
    assert [str(g) for g in got] == [*map(str, range(7)), "seven", *map(str, range(8, 20))]
    assert calls == [list(range(20)), [7], [7], [7]]


def test_calls_are_bounded_in_rows_characters_and_time():
    batch = pd.DataFrame({"input": ["x" * n for n in (5, 5, 50, 1, 1, 1, 1)]})
    assert [len(b) for b in rv._cut(batch, 3, 12)] == [2, 1, 3, 1]
    assert list(rv._cut(batch.iloc[:0], 3, 12)) == []

    def slow(batch: pd.DataFrame) -> list[str]:
        time.sleep(0.5)
        return ["late"] * len(batch)

    assert isinstance(rv._answers(batch.iloc[:1], slow, 0, 0.05)[0], TimeoutError)


def test_extractive_review(spark):
    cases = spark.createDataFrame(
        [(1, "why", ["ECG is normal. Weather fine.\nHeart failure, no AKI", "creatinine 2.4"])],
        CASES)
    team = spark.createDataFrame(
        [(1, 0, "Cardio"), (1, 1, "Nephro"), (1, 2, "Pharmacist"), (1, 3, "Unlisted")],
        "case_id BIGINT, pos INT, specialty STRING")
    rows = rv.extractive_review(cases, team, roles(spark)).orderBy("pos").collect()
    assert rows[0].evidence_quotes == ["ECG is normal", "Heart failure, no AKI"]
    assert rows[0].recommendation == "Follow up on ECG, heart failure"
    assert [r.confidence for r in rows] == [0.5, 0.5, 0.0, 0.0]
    assert rows[2].findings == rows[3].findings == "No relevant information found"


def test_team_size_follows_the_systems_involved(spark):
    rows = [(1, name, f"{name}{i}", 1) for name in "ABCDEF" for i in range(2)]
    rows += [(2, name, f"{name}{i}", 1) for name in "AB" for i in range(3)]
    rows += [(2, name, "x", 5) for name in "CDE"] + [(3, "A", "a", 1)]
    hits = spark.createDataFrame(
        rows, "case_id BIGINT, specialty STRING, indicator STRING, hits BIGINT")
    team = {}
    for r in tr.select_sized_team(hits).orderBy("case_id", "pos").collect():
        team.setdefault((r.case_id, r.systems), []).append(r.specialty)
    assert team == {(1, 6): list("ABCDE"), (2, 2): list("AB"), (3, 0): ["A"]}
    assert tr.select_sized_team(hits.limit(0)).collect() == []


@pytest.mark.parametrize("few", [0, 1_000])
def test_hits_are_every_run_of_words_with_a_map_of_any_size(spark, monkeypatch, few):
    monkeypatch.setattr(tr, "FEW_TERMS", few)
    text = "A a a b. b a; c? A A b b c c c, a"
    rows = [("S", "a", "High"), ("S", "a a", "High"), ("S", "A-b", "High"), ("T", "c c c", "Low"),
            ("T", "a b b c", "Low"), ("T", "c a", "Low"), ("T", "a z", "Low"), ("T", "b", "Low")]
    roles = spark.createDataFrame(rows, "specialty STRING, indicator STRING, lead_potential STRING")
    docs = spark.createDataFrame(
        [(1, 0, text), (2, 0, "a"), (3, 0, ""), (4, 0, None)], "case_id BIGINT, pos INT, text STRING")
    tokens = {1: "a a a b b a c a a b b c c c a".split(), 2: ["a"]}
    expected = {}
    for case_id, said in tokens.items():
        for specialty, indicator, _ in rows:
            term = indicator.lower().replace("-", " ").split()
            hits = sum(said[i:i + len(term)] == term for i in range(len(said)))
            if hits:
                expected[(case_id, specialty, indicator)] = hits
    found = tr.match_indicators(docs, roles)
    assert {(r.case_id, r.specialty, r.indicator): r.hits for r in found.collect()} == expected


def test_word_runs_are_not_cut_by_copies_of_the_whole_text(spark):
    docs = spark.createDataFrame([(1, 0, "a b c")], "case_id BIGINT, pos INT, text STRING")
    found = tr.match_indicators(docs, roles(spark))
    assert "slice(" not in found._jdf.queryExecution().optimizedPlan().toString()
    runs = docs.select(ngrams(words(F.col("text")), 2).alias("runs"))
    assert "slice(" not in runs._jdf.queryExecution().optimizedPlan().toString()
    assert runs.first().runs == ["a b", "b c"]
