"""How far a panel agrees: score, level, per-specialty values, outliers.

Input is one row per opinion: ``case_id, pos, specialty, confidence``, where
``pos`` is any orderable value, unique within the case.

Confidences are summed as whole millionths, so every result is independent of
row order and partitioning, partial sums merge, and the strict outlier test is
decided in integers. A hot case is pre-aggregated on the map side everywhere;
no operator here sorts or collects the rows of a case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorate import fixed_values as fixed
from quorate.functions.confidence import SMALL_PANEL, clamp, micro, wide

_MILLION = 1_000_000


def moments_of(confidence: Column) -> list[Column]:
    """Aggregates of clamped confidences: counts and exact moments of participants."""
    votes = confidence > 0
    u = F.when(votes, micro(confidence))
    square = u * u
    return [
        F.count_if(votes).alias("participating"),
        F.count_if(~votes).alias("abstained"),
        F.coalesce(F.sum(u), F.lit(0)).alias("s1"),
        # The square sum is kept in two halves so it cannot overflow a BIGINT.
        F.coalesce(F.sum(F.floor(square / _MILLION)), F.lit(0)).alias("s2_high"),
        F.coalesce(F.sum(square % _MILLION), F.lit(0)).alias("s2_low"),
    ]


def panel_moments(opinions: DataFrame) -> DataFrame:
    """Per case: counts and the exact first and second moment of participants."""
    voted = opinions.select("case_id", clamp(F.col("confidence")).alias("c"))
    return voted.groupBy("case_id").agg(*moments_of(F.col("c")))


def _scaled_variance(big: bool) -> Column:
    """n * sum(u^2) - sum(u)^2 of the moments, as BIGINT or as DECIMAL."""
    n, s1 = F.col("participating"), F.col("s1")
    high, low = F.col("s2_high"), F.col("s2_low")
    if not big:
        return n * (high * _MILLION + low) - s1 * s1
    return wide(n) * (wide(high) * wide(F.lit(_MILLION)) + wide(low)) - wide(s1) * wide(s1)


def level_of(score: Column) -> Column:
    """The name of the band an unrounded score falls into."""
    (first, least), *rest = fixed.LEVELS
    chain = F.when(score >= least, first)
    for name, least in rest:
        chain = chain.when(score >= least, name)
    return chain.otherwise(fixed.NO_LEVEL)


def score_moments(moments: DataFrame) -> DataFrame:
    """Mean, spread and unrounded agreement score from panel moments."""
    n = F.col("participating")
    variance = F.when(
        n <= SMALL_PANEL, _scaled_variance(big=False).cast("double")
    ).otherwise(_scaled_variance(big=True).cast("double"))
    empty = n == 0
    return (
        moments
        .withColumn("mean", F.when(empty, 0.0).otherwise(F.col("s1") / n / 1e6))
        .withColumn("spread", F.when(empty, 0.0).otherwise(F.sqrt(variance) / n / 1e6))
        .withColumn(
            "score",
            F.col("mean")
            * (F.lit(1.0) - F.least(F.col("spread") / fixed.LARGEST_SPREAD, F.lit(1.0))),
        )
        .drop("s1", "s2_high", "s2_low")
    )


def agreement_level(scored: DataFrame) -> DataFrame:
    """Add ``level`` from the unrounded ``score``."""
    return scored.withColumn("level", level_of(F.col("score")))


def panel_agreement(opinions: DataFrame, cases: DataFrame | None = None) -> DataFrame:
    """Agreement of each panel, rounded to three digits.

    With ``cases`` (a ``case_id`` column) every case is reported, those without
    any opinion with zeros.
    """
    moments = panel_moments(opinions)
    if cases is not None:
        moments = cases.select("case_id").join(moments, "case_id", "left").na.fill(0)
    scored = agreement_level(score_moments(moments))
    return scored.select("case_id", "participating", "abstained", *score_columns(), "level")


def score_columns() -> list[Column]:
    return [
        F.bround("mean", 3).alias("mean_confidence"),
        F.bround("spread", 3).alias("confidence_spread"),
        F.bround("score", 3).alias("agreement_score"),
    ]


def _named() -> Column:
    return F.coalesce(F.col("specialty"), F.lit(fixed.UNKNOWN_SPECIALTY))


def confidence_by_specialty(opinions: DataFrame) -> DataFrame:
    """One row per case and specialty; of repeated names the last one counts."""
    return (
        opinions
        .select("case_id", "pos", _named().alias("specialty"),
                clamp(F.col("confidence")).alias("confidence"))
        .groupBy("case_id", "specialty")
        .agg(F.max_by("confidence", "pos").alias("confidence"))
    )


def stands_apart(confidence: Column) -> Column:
    """Whether a clamped confidence is an outlier of the moments beside it."""
    n, s1 = F.col("participating"), F.col("s1")
    apart = n * micro(confidence) - s1
    gap = int(fixed.SMALLEST_OUTLIER_GAP * _MILLION)
    beyond_spread = F.when(
        n <= SMALL_PANEL, apart * apart > _scaled_variance(big=False)
    ).otherwise(wide(apart) * wide(apart) > _scaled_variance(big=True))
    return (confidence > 0) & (F.abs(apart) > n * gap) & beyond_spread


def mark_outliers(opinions: DataFrame) -> DataFrame:
    """Every opinion with ``is_outlier``.

    An opinion stands apart when its distance from the mean is larger than the
    spread and larger than the fixed gap, both strictly. The moments come from
    a grouped aggregate that is joined back, so a hot case is split by the
    skew join instead of sitting in one window partition.
    """
    rows = opinions.withColumn("specialty", _named()).withColumn(
        "confidence", clamp(F.col("confidence"))
    )
    return (
        rows.join(panel_moments(opinions), "case_id")
        .withColumn("is_outlier", stands_apart(F.col("confidence")))
        .drop("participating", "abstained", "s1", "s2_high", "s2_low")
    )


def flag_outliers(opinions: DataFrame) -> DataFrame:
    """Only the opinions that stand apart; order them by ``pos`` within a case."""
    return mark_outliers(opinions).where("is_outlier").drop("is_outlier")


def panel_breakdown(opinions: DataFrame) -> DataFrame:
    """Specialties of a case ranked by confidence, tagged outlier / abstained.

    Ranks run over one row per distinct specialty, never over opinions.
    """
    per_name = (
        mark_outliers(opinions)
        .groupBy("case_id", "specialty")
        .agg(
            F.max_by("confidence", "pos").alias("confidence"),
            F.min("pos").alias("first_pos"),
            F.bool_or("is_outlier").alias("outlier"),
        )
    )
    order = Window.partitionBy("case_id").orderBy(F.col("confidence").desc(), "first_pos")
    return per_name.select(
        "case_id", F.row_number().over(order).alias("rank"), "specialty", "confidence",
        "outlier", (F.col("confidence") == 0).alias("abstained"),
    )


def numbered(rows: DataFrame) -> DataFrame:
    """The rows of each case numbered from 0 in listed order; none is left out."""
    listed = Window.partitionBy("case_id").orderBy("pos")
    return rows.withColumn("pos", F.row_number().over(listed) - 1)


def cap_panel(team: DataFrame, max_specialists: int = fixed.MAX_SPECIALISTS) -> DataFrame:
    """The first N rows of each case in listed order, renumbered from 0.

    The row-number filter becomes a per-partition group limit below the
    shuffle, so a hot case sends at most N rows per map task.
    """
    listed = Window.partitionBy("case_id").orderBy("pos")
    return (
        team.withColumn("_rank", F.row_number().over(listed))
        .where(F.col("_rank") <= max_specialists)
        .withColumn("pos", F.col("_rank") - 1)
        .drop("_rank")
    )
