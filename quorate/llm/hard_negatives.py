"""Hard negatives of anchors, mined with cover trees.

Candidates are dealt into blocks of bounded size, each with a cover tree; anchors into
chunks of bounded size. A task streams the trees of one group of blocks past one chunk
and keeps the best of each window, so what it has found prunes the trees that follow. The
partial results of a chunk's groups are merged by Spark. Groups per chunk fall as chunks
grow in number, so partial results grow with the anchors only.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorate.llm.cover_tree import NONE_YET, Queries, build
from quorate.session import stored

# Rows of a tree, and anchors searched together.
BLOCK, CHUNK = 2048, 1024
# Tasks of a search, as long as the anchors fill fewer chunks.
TASKS = 256
# Components beyond this could leave 64 bits in a score.
LARGEST = 1 << 27


def integer_vectors(df: DataFrame, vector: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, label, vector): rows that take part, components floored to integers.

    Rows with a null id, label, vector or component, with a component that is not
    finite, or beyond 2^27 after scaling, take no part. Of rows that repeat an id and
    a label, the one with the smallest vector stands for all.
    """
    scaled = F.transform(vector, lambda x: x.cast("double") * scale)
    usable = F.forall(scaled, lambda x: F.coalesce(F.abs(x) <= LARGEST, F.lit(False)))
    return (
        df.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable)
        .select(F.col("vec_id").cast("bigint").alias("vec_id"),
                F.col("label").cast("bigint").alias("label"),
                F.transform(scaled, lambda x: F.floor(x).cast("int")).alias("vector"))
        .groupBy("vec_id", "label").agg(F.min("vector").alias("vector"))
    )


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    """Vectors as rows; shorter ones are filled up with zeros."""
    out = np.zeros((len(vectors), width), np.int64)
    for row, vector in zip(out, vectors, strict=True):
        row[:len(vector)] = vector
    return out


def _trees(rows: DataFrame, blocks: int, width: int) -> DataFrame:
    """(part, payload): a cover tree for each block of candidates."""
    def built(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["vec_id", "label"])
        tree = build(frame["vec_id"].to_numpy(), frame["label"].to_numpy(),
                     _matrix(frame["vector"], width))
        return pd.DataFrame({"part": [frame["part"].iloc[0]], "payload": [pickle.dumps(tree)]})

    return _dealt(rows, blocks).groupBy("part").applyInPandas(built, "part int, payload binary")


def _chunks(anchors: DataFrame, chunks: int, width: int) -> DataFrame:
    """(part, payload): anchors packed together, with their positives' ids and scores."""
    def packed(frame: pd.DataFrame) -> pd.DataFrame:
        content = (
            frame["vec_id"].to_numpy(), frame["label"].to_numpy(),
            _matrix(frame["vector"], width),
            [[(int(p["score"]), int(p["id"])) for p in row] for row in frame["positives"]],
        )
        return pd.DataFrame({"part": [frame["part"].iloc[0]], "payload": [pickle.dumps(content)]})

    return _dealt(anchors, chunks).groupBy("part").applyInPandas(packed, "part int, payload binary")


def _dealt(rows: DataFrame, parts: int) -> DataFrame:
    return rows.withColumn(
        "part", F.pmod(F.xxhash64("vec_id", "label"), F.lit(parts)).cast("int")
    )


FOUND = ("anchor_id bigint, label bigint, positive_id bigint, positive_score bigint,"
         " best array<struct<score:bigint,id:bigint>>")


def _searched(trees: DataFrame, chunks: DataFrame, n_blocks: int, n_chunks: int, k: int,
              window: tuple[int, int] | None) -> DataFrame:
    """The best ``k`` of every anchor (and positive) in each group of trees.

    Without ``window`` these are points of the anchor's label; with it points of other
    labels whose score is between the two percentages of a positive's score.
    """
    groups = max(1, min(n_blocks, ceil(TASKS / n_chunks)))
    numbers = F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1))).alias("chunk")
    shares = F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("share")
    together = (
        chunks.select(F.col("part").alias("chunk"), shares, F.lit(-1).alias("part"), "payload")
        .unionByName(trees.select(
            numbers, F.pmod("part", F.lit(groups)).alias("share"), "part", "payload"))
        .repartition(n_chunks * groups, "chunk", "share")
        .sortWithinPartitions("chunk", "share", "part")
        .select("chunk", "share", "part", "payload")
    )

    def begun(payload: bytes) -> tuple[Queries, list]:
        ids, labels, vectors, positives = pickle.loads(payload)
        if window is None:
            low = np.full((len(ids), 1), NONE_YET + 1, np.int64)
            return Queries(ids, labels, vectors, low, -low, k, same_label=True), positives
        width = max(map(len, positives))
        low, high = np.ones((len(ids), width), np.int64), np.zeros((len(ids), width), np.int64)
        for at, row in enumerate(positives):
            for w, (score, _) in enumerate(row):
                low[at, w], high[at, w] = -(-window[0] * score // 100), window[1] * score // 100
        return Queries(ids, labels, vectors, low, high, k, same_label=False), positives

    def result(queries: Queries, positives: list) -> pa.RecordBatch:
        rows = []
        for at, (name, label) in enumerate(zip(queries.ids.tolist(), queries.labels.tolist(),
                                               strict=True)):
            for w, (score, other) in enumerate(positives[at] if window else [(None, None)]):
                best = [
                    {"score": s, "id": i}
                    for s, i in zip(queries.scores[at, w].tolist(), queries.found[at, w].tolist(),
                                    strict=True) if s > NONE_YET
                ]
                if best:
                    rows.append({"anchor_id": name, "label": label, "positive_id": other,
                                 "positive_score": score, "best": best})
        pair = pa.struct([("score", pa.int64()), ("id", pa.int64())])
        return pa.RecordBatch.from_pylist(rows, schema=pa.schema([
            *[(name, pa.int64()) for name in
              ("anchor_id", "label", "positive_id", "positive_score")],
            ("best", pa.list_(pair)),
        ]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = positives = at = None
        for batch in batches:
            for chunk, share, part, payload in zip(*batch.columns, strict=True):
                if part.as_py() < 0:
                    if queries is not None:
                        yield result(queries, positives)
                    at = chunk.as_py(), share.as_py()
                    queries, positives = begun(payload.as_py())
                elif at == (chunk.as_py(), share.as_py()):  # else a chunk without anchors
                    queries.search(pickle.loads(payload.as_py()))
        if queries is not None:
            yield result(queries, positives)

    return together.mapInArrow(run, FOUND)


def _merged(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The best ``k`` of the groups' bests; at most ``TASKS`` lists of ``k`` meet."""
    ordered = F.sort_array(F.transform(
        F.flatten(F.collect_list("best")),
        lambda p: F.struct((-p.score).alias("back"), p.id.alias("id")),
    ))
    first = F.transform(F.slice(ordered, 1, k),
                        lambda p: F.struct((-p.back).alias("score"), p.id.alias("id")))
    return found.groupBy(*keys).agg(first.alias("best"))


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10,
                   window: tuple[int, int] = (30, 90)) -> DataFrame:
    """For every anchor and each of its positives, the hardest rows of other labels.

    ``rows`` are those of ``integer_vectors``; the score of a row is its inner product with
    the anchor. Positives of an anchor are its best rows of the same label, itself left
    out; negatives are the best of another label whose score lies between the two
    percentages of the positive's score. Ties go to the smaller vec_id. All rows are
    searched exactly. Vectors shorter than others count as filled up with zeros. Anchors
    without a positive, and positives without a negative in the window, give no row, and
    an empty table gives an empty result. An id with several labels is a row under each.

    Returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score.
    """
    rows = stored(rows, "vectors")
    n, anchors, width = rows.agg(
        F.count(F.lit(1)), F.count_if(is_anchor), F.coalesce(F.max(F.size("vector")), F.lit(0))
    ).first()
    n_blocks, n_chunks = max(1, ceil(n / BLOCK)), max(1, ceil(anchors / CHUNK))
    trees = stored(_trees(rows, n_blocks, width), "trees")
    asked = rows.where(is_anchor)
    nothing = F.array().cast("array<struct<score:bigint,id:bigint>>")
    near = _searched(
        trees, _chunks(asked.withColumn("positives", nothing), n_chunks, width),
        n_blocks, n_chunks, positives, None,
    )
    known = _merged(near, ["anchor_id", "label"], positives).select(
        F.col("anchor_id").alias("vec_id"), "label", F.col("best").alias("positives")
    )
    mined = _searched(
        trees, _chunks(asked.join(known, ["vec_id", "label"]), n_chunks, width),
        n_blocks, n_chunks, negatives, window,
    )
    keys = ["anchor_id", "label", "positive_id", "positive_score"]
    return _merged(mined, keys, negatives).select(
        "anchor_id", "positive_id", "positive_score", F.posexplode("best").alias("at", "hit")
    ).select(
        "anchor_id", "positive_id", (F.col("at") + 1).alias("rank"),
        F.col("hit.id").alias("negative_id"), "positive_score",
        F.col("hit.score").alias("negative_score"),
    )
