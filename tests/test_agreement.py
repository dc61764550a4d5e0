from __future__ import annotations

import random
import statistics
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from quorate.operators import agreement as ag
from quorate.operators.contracts import answered_opinions, clean_confidence

SCHEMA = "case_id BIGINT, pos INT, specialty STRING, confidence DOUBLE"


def panel(spark, *members, case_id=1):
    rows = [(case_id, i, name, c) for i, (name, c) in enumerate(members)]
    return spark.createDataFrame(rows, SCHEMA)


def report(spark, *members):
    return ag.panel_agreement(panel(spark, *members)).first()


def outliers(spark, *members):
    return [r.specialty for r in ag.flag_outliers(panel(spark, *members)).orderBy("pos").collect()]


def test_close_high_confidences_agree(spark):
    r = report(spark, ("Cardiology", 0.9), ("Nephrology", 0.85))
    assert (r.participating, r.mean_confidence, r.level) == (2, 0.875, "strong")
    assert r.agreement_score > 0.8


def test_split_panel_scores_low(spark):
    r = report(spark, ("Cardiology", 0.1), ("Neurology", 0.9))
    assert (r.mean_confidence, r.confidence_spread, r.agreement_score) == (0.5, 0.4, 0.1)
    assert r.level == "none"
    same_mean = report(spark, ("Cardiology", 0.5), ("Neurology", 0.5))
    assert (same_mean.agreement_score, same_mean.level) == (0.5, "moderate")


def test_single_member_scores_its_confidence(spark):
    r = report(spark, ("Cardiology", 0.7))
    assert (r.confidence_spread, r.agreement_score, r.level) == (0.0, 0.7, "moderate")


def test_zero_is_an_abstention(spark):
    members = [("Cardiology", 0.8), ("Dermatology", 0.0)]
    r = report(spark, *members)
    assert (r.participating, r.abstained, r.mean_confidence) == (1, 1, 0.8)
    by_name = dict(ag.confidence_by_specialty(panel(spark, *members))
                   .select("specialty", "confidence").collect())
    assert by_name["Dermatology"] == 0.0


def test_everybody_abstains(spark):
    r = report(spark, ("Cardiology", 0.0), ("Dermatology", 0.0))
    assert (r.participating, r.abstained, r.agreement_score, r.level) == (0, 2, 0.0, "none")


def test_malformed_confidence_counts_zero(spark):
    rows = [(1, 0, "Cardiology", None), (1, 1, "Neurology", "not a number"),
            (1, 2, "Nephrology", "0.6")]
    df = spark.createDataFrame(rows, SCHEMA.replace("DOUBLE", "STRING"))
    r = ag.panel_agreement(clean_confidence(df)).first()
    assert (r.abstained, r.mean_confidence) == (2, 0.6)


def test_confidence_is_clamped(spark):
    members = [("Cardiology", 1.5), ("Nephrology", 1.0)]
    r = report(spark, *members)
    assert (r.mean_confidence, r.agreement_score) == (1.0, 1.0)
    by_name = dict(ag.confidence_by_specialty(panel(spark, *members))
                   .select("specialty", "confidence").collect())
    assert by_name["Cardiology"] == 1.0


def test_outlier_is_named(spark):
    assert outliers(spark, ("Cardiology", 0.9), ("Nephrology", 0.85), ("Neurology", 0.2)) == [
        "Neurology"]


def test_tight_panel_has_no_outliers(spark):
    members = [("Nephrology", 0.95), ("Pharmacy", 0.85), ("Endocrinology", 0.85)]
    assert outliers(spark, *members) == []
    assert report(spark, *members).level == "strong"


def test_case_without_opinions(spark):
    none = panel(spark).where("false")
    r = ag.panel_agreement(none, spark.range(1).withColumnRenamed("id", "case_id")).first()
    assert (r.participating, r.abstained, r.agreement_score, r.level) == (0, 0, 0.0, "none")


@pytest.mark.parametrize("values, score, level", [
    ((0.5, 0.5), 0.5, "moderate"), ((0.1, 0.9), 0.1, "none"),
    ((0.9, 0.85), 0.831, "strong"), ((0.7,), 0.7, "moderate"),
])
def test_worked_table(spark, values, score, level):
    r = report(spark, *[(f"S{i}", v) for i, v in enumerate(values)])
    assert (r.agreement_score, r.level) == (score, level)


def test_level_is_taken_before_rounding(spark):
    r = report(spark, ("A", 0.25), ("B", 0.8), ("C", 1.0))
    assert (r.agreement_score, r.level) == (0.25, "none")


def test_random_panels_against_exact_arithmetic(spark):
    rng = random.Random(7)
    panels = {i: [rng.randrange(0, 21) / 20 for _ in range(rng.randrange(1, 9))]
              for i in range(400)}
    rows = [(i, p, f"S{p}", c) for i, values in panels.items() for p, c in enumerate(values)]
    df = spark.createDataFrame(rows, SCHEMA)
    scored = {r.case_id: r for r in ag.panel_agreement(df.repartition(7)).collect()}
    flagged: dict[int, set] = {}
    for r in ag.flag_outliers(df.repartition(3)).collect():
        flagged.setdefault(r.case_id, set()).add(r.pos)
    for i, values in panels.items():
        r = scored[i]
        active = [v for v in values if v > 0]
        assert r.participating + r.abstained == len(values)
        assert 0 <= r.agreement_score <= r.mean_confidence <= 1
        if not active:
            continue
        mean = statistics.fmean(active)
        spread = statistics.pstdev(active)
        assert r.mean_confidence == pytest.approx(mean, abs=6e-4)
        assert r.agreement_score == pytest.approx(mean * (1 - min(spread / 0.5, 1)), abs=6e-4)
        exact = [Fraction(round(v * 20), 20) for v in values]
        m = sum(e for e in exact if e > 0) / len(active)
        variance = sum((e - m) ** 2 for e in exact if e > 0) / len(active)
        expected = {p for p, e in enumerate(exact)
                    if e > 0 and (e - m) ** 2 > variance and abs(e - m) > Fraction(3, 20)}
        assert flagged.get(i, set()) == expected
        if len(active) == 2:
            assert not expected


def test_huge_panel_uses_wide_arithmetic(spark):
    n = 20_000
    df = spark.range(n).select(
        F.lit(1).cast("bigint").alias("case_id"), F.col("id").alias("pos"),
        F.concat(F.lit("S"), F.col("id") % 3).alias("specialty"),
        F.when(F.col("id") < 10, 0.1).otherwise(0.9).alias("confidence"))
    r = ag.panel_agreement(df).first()
    values = [0.1] * 10 + [0.9] * (n - 10)
    assert r.mean_confidence == round(statistics.fmean(values), 3)
    assert r.confidence_spread == round(statistics.pstdev(values), 3)
    assert ag.flag_outliers(df).count() == 10


def test_repeated_names_last_one_counts(spark):
    members = [("A", 0.9), ("A", 0.2), (None, 0.4)]
    by_name = dict(ag.confidence_by_specialty(panel(spark, *members))
                   .select("specialty", "confidence").collect())
    assert by_name == {"A": 0.2, "Unknown": 0.4}


def test_breakdown_ranks_by_confidence_then_position(spark):
    members = [("B", 0.5), ("A", 0.5), ("C", 0.9), ("D", 0.0), ("E", 0.02)]
    rows = ag.panel_breakdown(panel(spark, *members)).orderBy("rank").collect()
    assert [r.specialty for r in rows] == ["C", "B", "A", "E", "D"]
    assert [r.abstained for r in rows] == [False] * 4 + [True]
    assert [r.specialty for r in rows if r.outlier] == ["C", "E"]


def test_cap_keeps_listed_order(spark):
    capped = ag.cap_panel(panel(spark, *[(s, 0.5) for s in "ABCD"]), 2)
    assert [(r.pos, r.specialty) for r in capped.orderBy("pos").collect()] == [(0, "A"), (1, "B")]


def test_cap_limits_groups_before_the_shuffle(spark):
    plan = ag.cap_panel(panel(spark, ("A", 0.1)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_unparsed_answer_still_votes_as_abstention(spark):
    rows = [(1, 0, "not json"), (1, 1, '{"specialty": "A", "confidence": 0.8}')]
    df = spark.createDataFrame(rows, "case_id BIGINT, pos INT, raw STRING")
    r = ag.panel_agreement(answered_opinions(df)).first()
    assert (r.participating, r.abstained) == (1, 1)
