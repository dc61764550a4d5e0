"""Exact duplicates by two passes over a Bloom filter, in DataFrame functions only.

The first pass counts the cells that text hashes fall into and keeps, as bitmaps,
the cells hit at least twice. The second pass tests every row against them: a row
with a cell of its own cannot have a twin and passes straight through, only the
others are shuffled and grouped by their full hash. Texts are read once and never
move; what is shuffled are small integers first, then ids and hashes of candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorate.llm.common import whole_text
from quorate.session import stored

# Bits of one block: what bitmap_construct_agg holds in 4,096 bytes.
BLOCK_BITS = 32_768
# The filter takes this many bits a row, and 16,384 blocks (64 MB) at most. Beyond
# that it fills up: more rows count as candidates, the result stays the same.
BITS_PER_ROW, MAX_BLOCKS = 16, 16_384


def _bit_set(bitmap: str, bit: str) -> Column:
    """Whether a bit of a 4,096-byte bitmap is set; a missing bitmap has none."""
    byte = f"cast(conv(hex(substring({bitmap}, {bit} div 8 + 1, 1)), 16, 10) as int)"
    return F.expr(f"coalesce(shiftright({byte}, {bit} % 8) & 1, 0) = 1")


def possibly_repeated(hashes: DataFrame, blocks: int) -> DataFrame:
    """Bitmaps of the cells hit at least twice: one row of 4 KB per block."""
    cells = hashes.select("_block", F.explode(F.array("_bit1", "_bit2")).alias("_bit"))
    return (
        cells.groupBy("_block", "_bit").agg(F.count(F.lit(1)).alias("_n"))
        .where("_n >= 2")
        .groupBy("_block").agg(F.expr("bitmap_construct_agg(_bit)").alias("_bitmap"))
    )


def exact_dedup(docs: DataFrame, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """Which rows have equal texts, and which row of each group stays.

    Input needs ``doc_id`` and ``text``; other columns are ignored. A null text
    equals the empty text. Of equal texts the row with the largest doc_id stays (a
    null id is the smallest); of rows that also share the id exactly one stays.
    An empty table gives an empty result.

    Returns doc_id, keep_id, group_size, kept, text_sha256 for every row.
    """
    rows = stored(
        docs.select("doc_id", "text").select(
            "doc_id", F.unhex(F.sha2(whole_text(), 256)).alias("_sha"),
            F.monotonically_increasing_id().alias("_row"),
        ),
        "hashes",
    )
    blocks = max(1, min(max_blocks, -(-rows.count() * BITS_PER_ROW // BLOCK_BITS)))
    hashed = rows.select(
        "*",
        F.pmod(F.xxhash64("_sha"), F.lit(blocks)).alias("_block"),
        F.pmod(F.xxhash64("_sha", F.lit(1)), F.lit(BLOCK_BITS)).alias("_bit1"),
        F.pmod(F.xxhash64("_sha", F.lit(2)), F.lit(BLOCK_BITS)).alias("_bit2"),
    )
    # At most max_blocks bitmaps of 4 KB, whatever the input.
    seen_twice = F.broadcast(possibly_repeated(hashed, blocks))
    tested = stored(
        hashed.join(seen_twice, "_block", "left").select(
            "doc_id", "_sha", "_row",
            (_bit_set("_bitmap", "_bit1") & _bit_set("_bitmap", "_bit2")).alias("_candidate"),
        ),
        "tested",
    )
    candidates = tested.where("_candidate")
    # Stored, so that the join below shuffles both sides itself and the skew join
    # can split the side with the hot text; the other side has one row per text.
    groups = stored(
        candidates.groupBy("_sha").agg(
            F.max(F.struct("doc_id", "_row")).alias("_keep"), F.count(F.lit(1)).alias("_size")
        ),
        "groups",
    )
    sha = F.lower(F.hex("_sha")).alias("text_sha256")
    alone = tested.where("not _candidate").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"),
        F.lit(True).alias("kept"), sha,
    )
    grouped = candidates.join(groups, "_sha").select(
        "doc_id", F.col("_keep.doc_id").alias("keep_id"), F.col("_size").alias("group_size"),
        (F.col("_row") == F.col("_keep._row")).alias("kept"), sha,
    )
    return alone.unionByName(grouped)
