"""Connected components of a link table, on Spark alone."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorate.session import stored


def star_links(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The components of some links as (member, smallest member) pairs.

    Same components with one pair per member, so what a task has found stays
    linear in the members however many links join them.
    """
    members, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = place[: len(a)], place[len(a):]
    label = np.arange(len(members))
    while True:
        lu, lv = label[u], label[v]
        if np.array_equal(lu, lv):
            break
        low = np.minimum(lu, lv)
        np.minimum.at(label, lu, low)
        np.minimum.at(label, lv, low)
        while not np.array_equal(label, label[label]):
            label = label[label]
    own = label != np.arange(len(members))
    return members[own], members[label[own]]


def _star(links: DataFrame, small: bool) -> DataFrame:
    """One star step: hang neighbours below the smallest node next to each node.

    Large: every larger neighbour of a node; small: the node and its smaller ones.
    The minima are stored, so the join shuffles both sides itself and Spark can
    split a hub; the other side has one row per node.
    """
    both = links if small else links.unionByName(
        links.select(F.col("v").alias("u"), F.col("u").alias("v"))
    )
    least = stored(both.groupBy("u").agg(F.min("v").alias("low")), "minima")
    joined = both.join(least, "u").withColumn("low", F.least("u", "low"))
    if small:
        moved = joined.select(F.col("v").alias("a"), F.col("low").alias("b")).unionByName(
            least.select(F.col("u").alias("a"), F.col("low").alias("b"))
        )
    else:
        moved = joined.where("v > u").select(F.col("v").alias("a"), F.col("low").alias("b"))
    return moved.where("a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    ).distinct()


def components(links: DataFrame) -> DataFrame:
    """(u, v) links to (u, root): every node that is not the smallest of its component.

    Alternates large and small star steps until nothing changes, a number of rounds
    that grows with the logarithm of the longest path. Each round is written to the
    shared folder, so no lineage grows and a lost executor costs one step.
    """
    now = stored(
        links.where("u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
        "links",
    )
    before = None
    while True:
        found = now.agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum"),
        ).first()
        if found == before or found.n == 0:
            return now.select("u", F.col("v").alias("root"))
        before = found
        now = stored(_star(stored(_star(now, small=False), "links"), small=True), "links")
