"""Bounded, repeatable samples of labelled documents for training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorate.llm.common import whole_text


def fold(modulus: int) -> Column:
    """The remainder of crc32(doc_id as text); null ids fall in no fold."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, in_training: Column,
                    per_class: int) -> DataFrame:
    """(doc_id, text, label) of at most ``per_class`` labelled documents of each class.

    Rows are picked in the order of a hash of their id, the same at every run. Labels
    other than 0 and 1, null ids and labels without a document are left out; an id
    labelled twice counts as 1 if any of its labels is 1. Of documents that repeat an
    id, the one with the smallest text counts, so the bound is one of rows.
    """
    usable = (
        labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & in_training)
        .groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    )
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = usable.where("label = 0").orderBy(*order).limit(per_class).unionByName(
        usable.where("label = 1").orderBy(*order).limit(per_class)
    )
    # 2 x per_class rows of two numbers at most.
    return (
        docs.select("doc_id", whole_text().alias("text")).join(F.broadcast(picked), "doc_id")
        .groupBy("doc_id", "label").agg(F.min("text").alias("text"))
        .select("doc_id", "text", "label")
    )


def share_of_ones(labels: DataFrame, label: str, in_training: Column) -> float:
    """The share of label 1 among all labelled training rows (0.5 without any)."""
    row = (
        labels.where(F.col(label).isin(0, 1) & in_training)
        .agg(F.avg(F.col(label).cast("double")).alias("share")).first()
    )
    return 0.5 if row.share is None else float(row.share)
