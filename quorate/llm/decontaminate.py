"""Benchmark passages in documents, found by spaced seeds. DataFrame functions only.

A seed is the hash of the tokens at the fixed positions of a mask; the positions in
between are ignored, so a substitution there does not hide a passage. A document is
contaminated by an item if, on one alignment of the two, some window of 13 tokens of
the item (all of it, if shorter) has at most a fifth of its tokens changed.

The masks hit every such window wherever its changed tokens are: 13 tokens with 2
changed for MASKS, and 5 tokens with 1 changed for SHORT_MASKS, which any window of
5 to 12 tokens with a fifth changed contains. Items of one to four tokens, which may
not change at all, have one seed of all their tokens. So seeds lose nothing, and what they
find is verified exactly. Documents are read in one map-only pass; only verified
pairs of ids are shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorate.functions.scale import broadcast_if_small, computed_once
from quorate.llm.common import whole_text
from quorate.session import stored

WINDOW, SHORT = 13, 5
MASKS = ("11101011", "110100111")
SHORT_MASKS = ("1101", "1011")
# Benchmark tokens looked up in one pass over the documents: about two seeds each,
# so what is broadcast stays under 64 MB. A larger benchmark takes more passes.
BLOCK_TOKENS = 500_000


def tokens(text: Column) -> Column:
    """Hashes of the lower-case words (letters and digits) of a text."""
    words = F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")
    return F.transform(words, lambda word: F.xxhash64(word))


def allowed(window: Column) -> Column:
    """Changed tokens a window may have: a fifth, rounded down."""
    return F.floor(window / 5).cast("int")


def _seeds(rows: DataFrame, masks: tuple[str, ...], keep: list[str], at: str) -> DataFrame:
    """One row per mask and position of ``_tokens``: the kept columns, ``at``, ``_seed``."""
    offsets = sorted({i for mask in masks for i, c in enumerate(mask) if c == "1"})
    shifted = [
        F.col("_tokens") if i == 0
        else F.slice("_tokens", i + 1, F.greatest(F.size("_tokens") - i, F.lit(0)))
        for i in offsets
    ]
    zipped = F.arrays_zip(*[s.alias(f"t{i}") for i, s in zip(offsets, shifted, strict=True)])
    named = zipped.cast("array<struct<" + ",".join(f"t{i}:bigint" for i in offsets) + ">>")
    placed = rows.select(*keep, F.posexplode(named).alias(at, "_at"))
    seeds = [
        F.when(
            F.col(f"_at.t{len(mask) - 1}").isNotNull(),
            F.xxhash64(F.lit(k), *[f"_at.t{i}" for i, c in enumerate(mask) if c == "1"]),
        )
        for k, mask in enumerate(masks)
    ]
    return placed.select(*keep, at, F.explode(F.array(*seeds)).alias("_seed")).where(
        F.col("_seed").isNotNull()
    )


def _hits(docs: DataFrame, items: DataFrame, masks: tuple[str, ...]) -> DataFrame:
    """Verified alignments: (doc_id, item_id, item_tokens, matched_tokens)."""
    # Both sides of the benchmark are bounded by BLOCK_TOKENS.
    seeds = F.broadcast(
        _seeds(items.select("_item", "_tokens"), masks, ["_item"], "_ipos")
    )
    texts = F.broadcast(items.select("_item", "item_id", F.col("_tokens").alias("_wanted")))
    found = (
        _seeds(docs, masks, ["doc_id", "_tokens"], "_pos")
        .join(seeds, "_seed").join(texts, "_item")
        .withColumn("_n", F.size("_wanted"))
        .withColumn("_w", F.least(F.lit(WINDOW), "_n"))
        .withColumn("_shift", F.col("_pos") - F.col("_ipos"))
    )

    def equal(j: Column) -> Column:
        place = F.col("_shift") + j
        return (place >= 0) & F.coalesce(
            F.get("_tokens", place) == F.get("_wanted", j), F.lit(False)
        )

    # Windows of the item that hold the hit's first token.
    first = F.greatest(F.lit(0), F.col("_ipos") - F.col("_w") + 1)
    starts = F.sequence(first, F.least(F.col("_ipos"), F.col("_n") - F.col("_w")))
    close = F.exists(
        starts,
        lambda s: F.size(F.filter(F.sequence(s, s + F.col("_w") - 1), equal))
        >= F.col("_w") - allowed(F.col("_w")),
    )
    matched = F.size(F.filter(F.sequence(F.lit(0), F.col("_n") - 1), equal))
    return found.where(close).select(
        "doc_id", "item_id", F.col("_n").cast("bigint").alias("item_tokens"),
        matched.cast("bigint").alias("matched_tokens"),
    )


def benchmark_overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Which documents hold a passage of which benchmark item.

    Documents need ``doc_id`` and ``text``, the benchmark ``item_id`` and ``text``;
    other columns are ignored. Null texts count as empty. Items of fewer than five
    tokens are found verbatim, items without any are not. Repeated rows and ties give one row per pair of ids
    (null ids too), with the most matching tokens of any alignment; an empty table on
    either side gives an empty result.

    Returns doc_id, item_id, item_tokens, matched_tokens of contaminated pairs only.
    """
    read = computed_once(docs.select("doc_id", whole_text().alias("_text")),
                         _tokens=tokens(F.col("_text"))).drop("_text")
    items = stored(
        benchmark.select(
            "item_id", tokens(whole_text()).alias("_tokens"),
            F.monotonically_increasing_id().alias("_item"),
        ).where(F.size("_tokens") > 0),
        "benchmark",
    )
    size = F.size("_tokens")
    kind = F.when(size < SHORT, size).when(size < WINDOW, SHORT).otherwise(WINDOW)
    # At most six rows: one for each length below five, one for each set of masks.
    sizes = dict(items.groupBy(kind.alias("kind")).agg(F.sum(size).alias("n")).collect())
    masks_of = {WINDOW: MASKS, SHORT: SHORT_MASKS, **{n: ("1" * n,) for n in range(1, SHORT)}}
    passes = [(masks_of[found], kind == found) for found in sorted(sizes)] or [
        (MASKS, F.lit(False))]
    n = sum(sizes.values())
    blocks = max(1, -(-n // BLOCK_TOKENS))
    found = [
        _hits(read, items.where(length & (F.pmod(F.xxhash64("_item"), F.lit(blocks)) == block)),
              masks)
        for masks, length in passes for block in range(blocks)
    ]
    return reduce(DataFrame.unionByName, found).groupBy("doc_id", "item_id").agg(
        F.max("item_tokens").alias("item_tokens"), F.max("matched_tokens").alias("matched_tokens")
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark passage, with all their columns.

    Every row is judged by its own text, named by a 128-bit digest: null and repeated
    ids make no difference, and equal texts stay or go together.
    """
    digest = F.md5(whole_text())
    texts = docs.select(digest.alias("doc_id"), "text")
    gone = broadcast_if_small(
        stored(benchmark_overlaps(texts, benchmark).select("doc_id").distinct(), "contaminated")
    )
    return docs.join(gone, digest == gone["doc_id"], "left_anti")
