"""Mixing to target weights: raking of token counts, then calibrated sampling.

Documents fall into cells of source, language and topic. Iterative proportional
fitting scales the cells' tokens to the target shares of each of the three in turn,
never above what a cell has; a cell's fitted tokens over its tokens is then the
probability with which its documents are kept. DataFrame functions only: documents
are aggregated once, and the fitting works on the cells, spread by their categories.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorate.functions.scale import broadcast_if_small
from quorate.llm.common import whole_text, with_row
from quorate.session import stored

DIMENSIONS = ("source", "lang", "topic")
NONE = "(none)"
# Share of a category: as given, or its observed share to a power below 1, which
# flattens the mixture. Shares are scaled to add up to 1 over what is there.
TARGETS: Mapping[str, float | Mapping[str, float]] = {
    "source": 0.7,
    "lang": 0.8,
    "topic": {"prose": 0.94, "tables": 0.02, "shouting": 0.02, "symbols": 0.02},
}
# Part of all tokens the sample should have.
BUDGET = 0.8
# Rounds of fitting, and how many of them one job makes.
ROUNDS, ROUNDS_PER_JOB = 10, 5
# A mark in at least one of so many words decides the topic.
WORDS_PER_MARK = 20
# Decimals of a probability.
DIGITS = 6
SYMBOLS = ("***", "%%%", "###", "$$$", "&&&")


def n_words(text: Column) -> Column:
    return F.size(F.array_remove(F.split(text, r"[\x09-\x0D ]+"), "")).cast("bigint")


def _count(text: Column, mark: str) -> Column:
    without = F.replace(text, F.lit(mark), F.lit(""))
    return F.floor((F.length(text) - F.length(without)) / len(mark))


def topic_of(text: Column, words: Column) -> Column:
    """The kind of a text by its marks: tables, shouting, symbols, prose or empty."""
    symbols = sum((_count(text, mark) for mark in SYMBOLS), F.lit(0))
    return (
        F.when(words == 0, "empty")
        .when(_count(text, "|") * WORDS_PER_MARK >= words, "tables")
        .when(_count(text, "!!") * WORDS_PER_MARK >= words, "shouting")
        .when(symbols * WORDS_PER_MARK >= words, "symbols")
        .otherwise("prose")
    )


def chance(doc_id: Column) -> Column:
    """A number in [0, 1) drawn from the id, the same at every run."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":mix")))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / float(1 << 48)


def described(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The kept columns with the cell and the words of each document."""
    words = n_words(whole_text())
    return docs.select(
        *keep, *[F.coalesce(F.col(c), F.lit(NONE)).alias(f"_{c}") for c in ("source", "lang")],
        words.alias("_words"), topic_of(whole_text(), words).alias("_topic"),
    )


def _goal(dimension: str, target: float | Mapping[str, float]) -> Column:
    """Share a category should have, before scaling; constant within the category."""
    tokens = F.sum("tokens").over(Window.partitionBy(dimension))
    share = tokens / F.col("total")
    if not isinstance(target, Mapping):
        return F.pow(share, F.lit(float(target)))
    if not target:
        return share
    given = F.create_map(*[F.lit(part) for pair in sorted(target.items()) for part in pair])
    return F.coalesce(F.try_element_at(given, F.col(dimension)), share)


def fitted_cells(cells: DataFrame, targets: Mapping[str, float | Mapping[str, float]],
                 budget: float, rounds: int = ROUNDS) -> DataFrame:
    """(source, lang, topic, tokens, probability) from (source, lang, topic, tokens).

    In each round the tokens of every category are scaled to its goal, one dimension
    after the other, and then bounded by what the cells have. Rounds are written to
    the shared folder a few at a time, so the plan stays short.
    """
    full = cells.where("tokens > 0")
    total = full.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n")).first().n
    now = full.withColumn("tokens", F.col("tokens").cast("double")).withColumn(
        "total", F.lit(float(total))
    )
    for dimension in DIMENSIONS:
        # A category's goal counts once, on as many cells as it has.
        per_cell = F.count(F.lit(1)).over(Window.partitionBy(dimension))
        now = now.withColumn(f"raw_{dimension}", _goal(dimension, targets.get(dimension, {})))
        now = now.withColumn(f"part_{dimension}", F.col(f"raw_{dimension}") / per_cell)
    now = stored(now, "goals")
    sums = now.agg(*[F.sum(f"part_{d}").alias(d) for d in DIMENSIONS]).first()
    now = now.select(
        *DIMENSIONS, "tokens", (F.col("tokens") * budget).alias("w"),
        *[(F.col(f"raw_{d}") / F.lit(sums[d] or 1.0) * F.lit(total * budget)).alias(f"goal_{d}")
          for d in DIMENSIONS],
    )
    for k in range(rounds):
        for d in DIMENSIONS:
            now = now.withColumn(
                "w", F.col("w") * F.col(f"goal_{d}") / F.sum("w").over(Window.partitionBy(d))
            )
        now = now.withColumn("w", F.least("w", "tokens"))
        if (k + 1) % ROUNDS_PER_JOB == 0:
            now = stored(now, "fitted")
    fitted = now.select(
        *DIMENSIONS, F.col("tokens").cast("bigint").alias("tokens"),
        F.round(F.col("w") / F.col("tokens"), DIGITS).alias("probability"),
    )
    return fitted.unionByName(cells.where("tokens = 0").select(
        *DIMENSIONS, "tokens", F.lit(1.0).alias("probability")
    ))


def mixture(docs: DataFrame, targets: Mapping[str, float | Mapping[str, float]] = TARGETS,
            budget: float = BUDGET) -> DataFrame:
    """(source, lang, topic, tokens, probability) of every cell of the documents."""
    cells = described(docs, []).groupBy(
        F.col("_source").alias("source"), F.col("_lang").alias("lang"),
        F.col("_topic").alias("topic"),
    ).agg(F.sum("_words").alias("tokens"))
    return stored(fitted_cells(stored(cells, "cells"), targets, budget), "mixture")


def _with_chances(docs: DataFrame, cells: DataFrame, keep: list[str]) -> DataFrame:
    """Documents with ``_p``, the probability of their cell. Joined on the map side
    while the cells are few; else by shuffle, where Spark splits a hot cell."""
    chances = cells.select(
        *[F.col(d).alias(f"_{d}") for d in DIMENSIONS], F.col("probability").alias("_p")
    )
    return described(docs, keep).join(
        broadcast_if_small(chances), [f"_{d}" for d in DIMENSIONS], "left"
    ).withColumn("_kept", chance(F.col("doc_id")) < F.col("_p"))


def mixed(docs: DataFrame, targets: Mapping[str, float | Mapping[str, float]] = TARGETS,
          budget: float = BUDGET) -> DataFrame:
    """Which documents a sample with the target weights keeps.

    Needs ``doc_id``, ``text``, ``source`` and ``lang``; other columns are ignored. A
    null source or language is the category "(none)"; null and empty texts have no
    tokens, take no part in the fitting and are kept. Repeated rows are drawn alike,
    as the draw depends on the id only (a null id draws like any other). An empty
    table gives an empty result.

    Returns doc_id, source, lang, topic, n_tokens (words), probability, kept.
    """
    return _with_chances(docs, mixture(docs, targets, budget), ["doc_id"]).select(
        "doc_id", F.col("_source").alias("source"), F.col("_lang").alias("lang"),
        F.col("_topic").alias("topic"), F.col("_words").alias("n_tokens"),
        F.col("_p").alias("probability"), F.col("_kept").alias("kept"),
    )


def sampled(docs: DataFrame, targets: Mapping[str, float | Mapping[str, float]] = TARGETS,
            budget: float = BUDGET) -> DataFrame:
    """The documents the sample keeps, with all their columns."""
    cells = mixture(docs, targets, budget)
    rows = with_row(docs, "doc_id", "text", "source", "lang")
    return _with_chances(rows, cells, ["doc_id", "_doc"]).where("_kept").select("_doc.*")
