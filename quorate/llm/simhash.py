"""SimHash near-duplicates by anchor points of a covering code.

A fingerprint of 64 bits is cut into three blocks. Two fingerprints that differ in
at most four bits differ in at most one bit of some block. In every block, anchors
are the words of a covering code: the Hamming code of length 15 on the block's low
bits and every value of the 6 or 7 bits above. Each block is within distance 1 of
its home anchor (covering radius 1), so the partner's block is within 1 + 1 of that
anchor: each fingerprint is replicated to all anchors within distance 2 (about 44
rows) and compared, per anchor, with those at home there.

Equal fingerprints are merged first, so groups of copies never meet an anchor. A
task sends on the components it has found, not its links. Anchors with many
fingerprints at home are cut into slices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorate.functions.scale import broadcast_if_small
from quorate.llm.common import whole_text
from quorate.llm.components import components, star_links
from quorate.session import stored

SEED = 42
SHINGLE = 4
THRESHOLD = 4
# Lowest bit and width of each block; the low CODED bits of a block carry the code.
BLOCKS = ((0, 21), (21, 21), (42, 22))
CODED = 15
# Home fingerprints of an anchor that one slice of its probes is compared with.
SLICE = 20_000
# Pairs compared at once in a task, and bytes of a text cut into words at once.
PAIRS, CHUNK = 1 << 21, 1 << 22
WHITE = b" \t\n\x0b\x0c\r"


# --- fingerprints ----------------------------------------------------------------

def word_chunks(raw: bytes) -> Iterator[list[bytes]]:
    """The words of a text, a bounded stretch of it at a time."""
    start = 0
    while start < len(raw):
        end = min(len(raw), start + CHUNK)
        while end < len(raw) and raw[end] not in WHITE:
            end += 1
        yield raw[start:end].split()
        start = end


def fingerprint(text: str, size: int = SHINGLE) -> int:
    """The SimHash of a whole text as a signed 64-bit number; 0 without words."""
    votes, n, kept = np.zeros(64, dtype=np.int64), 0, []
    for words in word_chunks(text.encode().lower()):
        words = kept + words
        if len(words) >= size:
            joined = b" ".join(words)
            ends = np.cumsum([len(word) + 1 for word in words]) - 1
            starts = [0, *(ends[: len(words) - size] + 1).tolist()]
            digests = [
                xxhash.xxh64_digest(joined[a:b], SEED)
                for a, b in zip(starts, ends[size - 1:].tolist(), strict=True)
            ]
            bits = np.unpackbits(np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 8), axis=1)
            votes += bits.sum(axis=0, dtype=np.int64)
            n += len(digests)
            words = words[len(words) - size + 1:]
        kept = words
    if n == 0:
        if not kept:
            return 0
        return int.from_bytes(xxhash.xxh64_digest(b" ".join(kept), SEED), "big", signed=True)
    return int.from_bytes(np.packbits(votes * 2 > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every row."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([fingerprint(t) for t in batch.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), found], names=["doc_id", "fp"])

    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(
        hashed, "doc_id bigint, fp bigint"
    )


# --- anchors ---------------------------------------------------------------------

def hamming_tables() -> tuple[np.ndarray, np.ndarray]:
    """For each 15-bit value its nearest code word, and all within distance 2 (-1: none).

    A value is a code word if the XOR of the (1-based) places of its set bits is 0;
    otherwise that XOR names the bit to flip.
    """
    values = np.arange(1 << CODED)
    syndrome = np.zeros(len(values), dtype=np.int64)
    for bit in range(CODED):
        syndrome ^= np.where(values >> bit & 1, bit + 1, 0)
    home = np.where(syndrome > 0, values ^ (1 << np.maximum(syndrome - 1, 0)), values)
    near = [home]
    for a in range(CODED):
        for b in range(a + 1, CODED):
            hit = (syndrome > 0) & (((a + 1) ^ (b + 1)) == syndrome)
            near.append(np.where(hit, values ^ (1 << a | 1 << b), -1))
    table = -np.sort(-np.stack(near, axis=1), axis=1)
    return home, table[:, : int((table >= 0).sum(axis=1).max())]


def placements(fps: np.ndarray, home: np.ndarray, near: np.ndarray,
               home_only: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of unsigned fingerprints: (index of the fingerprint, anchor, at home)."""
    rows, anchors, at_home = [], [], []

    def put(index: np.ndarray, block: int, upper: np.ndarray, code: np.ndarray,
            is_home: np.ndarray) -> None:
        rows.append(index)
        anchors.append((block << 22) | (upper << CODED) | code)
        at_home.append(is_home)

    everyone = np.arange(len(fps))
    for block, (low, width) in enumerate(BLOCKS):
        value = (fps >> np.uint64(low) & np.uint64((1 << width) - 1)).astype(np.int64)
        upper, coded = value >> CODED, value & ((1 << CODED) - 1)
        own = home[coded]
        if home_only:
            put(everyone, block, upper, own, np.ones(len(fps), bool))
            continue
        for column in near[coded].T:
            some = np.flatnonzero(column >= 0)
            put(some, block, upper[some], column[some], column[some] == own[some])
        free = range(width - CODED)
        for j in free:
            put(everyone, block, upper ^ (1 << j), own, np.zeros(len(fps), bool))
        exact = np.flatnonzero(own == coded)
        for j in free:
            for k in range(j + 1, len(free)):
                put(exact, block, upper[exact] ^ (1 << j | 1 << k), own[exact],
                    np.zeros(len(exact), bool))
    return np.concatenate(rows), np.concatenate(anchors), np.concatenate(at_home)


def anchored(distinct: DataFrame, home_only: bool = False) -> DataFrame:
    """(anchor, fp, home) of every fingerprint at every anchor it is replicated to."""

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home, near = hamming_tables()
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            index, anchor, at_home = placements(fps.view(np.uint64), home, near, home_only)
            for a in range(0, len(index), 100_000):
                part = slice(a, a + 100_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor[part].astype(np.int32)), pa.array(fps[index[part]]),
                     pa.array(at_home[part])],
                    names=["anchor", "fp", "home"],
                )

    return distinct.select("fp").mapInArrow(placed, "anchor int, fp bigint, home boolean")


# --- comparing per anchor ----------------------------------------------------------

def close_pairs(group: np.ndarray, fps: np.ndarray, base: np.ndarray,
                threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (base, row) of the same group that differ in 1 to ``threshold`` bits.

    Rows come sorted by group, bases first. Bounded by PAIRS at a time.
    """
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    sizes = np.diff(np.append(starts, len(group)))
    bases = np.add.reduceat(base.astype(np.int64), starts)

    def close(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bits = np.bitwise_count(a ^ b)
        hit = (bits > 0) & (bits <= threshold)
        return a[hit], b[hit]

    pairs = bases * sizes
    large = pairs > PAIRS // 16
    for s, n, k in zip(starts[large], sizes[large], bases[large], strict=True):
        rows = fps[s : s + n]
        step = max(1, PAIRS // n)
        for i in range(0, k, step):
            some = rows[i : min(i + step, k)]
            yield close(np.repeat(some, n), np.tile(rows, len(some)))
    small = np.flatnonzero(~large & (pairs > 0) & (sizes > 1))
    cuts = np.cumsum(pairs[small]) // PAIRS
    for part in np.split(small, np.flatnonzero(np.diff(cuts)) + 1):
        if len(part) == 0:
            continue
        count = pairs[part]
        within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        start, n = np.repeat(starts[part], count), np.repeat(sizes[part], count)
        yield close(fps[start + within // n], fps[start + within % n])


def compared(placed: DataFrame, threshold: int) -> DataFrame:
    """(u, v) links that join the same fingerprints as all pairs within the threshold."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        held = 0

        def links(rows: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
            u, v = np.empty(0, np.int64), np.empty(0, np.int64)
            for a, b in close_pairs(*rows, threshold):
                if len(a):
                    u, v = star_links(np.concatenate([u, a.view(np.int64)]),
                                      np.concatenate([v, b.view(np.int64)]))
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        for batch in batches:
            anchor, part, fp, base = (batch.column(i).to_numpy(zero_copy_only=False)
                                      for i in range(4))
            kept.append((anchor.astype(np.int64) << 32 | part, fp.view(np.uint64), base))
            held += len(anchor)
            if held < 200_000:
                continue
            group, fps, bases = (np.concatenate(column) for column in zip(*kept, strict=True))
            # The last group may go on in the next batch.
            end = int(np.searchsorted(group, group[-1]))
            kept, held = [(group[end:], fps[end:], bases[end:])], len(group) - end
            if end:
                yield from links((group[:end], fps[:end], bases[:end]))
        if held:
            yield from links(tuple(np.concatenate(c) for c in zip(*kept, strict=True)))

    return (
        placed.repartition("anchor", "part")
        .sortWithinPartitions("anchor", "part", F.desc("base"))
        .select("anchor", "part", "fp", "base")
        .mapInArrow(compare, "u bigint, v bigint")
    )


def sliced(placed: DataFrame, homes: DataFrame) -> DataFrame:
    """Give each row its part of the anchor, so no part has too many probes.

    A fingerprint probes in one part; where it is at home it is a base in all of
    them. Ordinary anchors have one part and one row serves both purposes.
    """
    hot = stored(
        homes.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SLICE)
        .select("anchor", F.ceil(F.col("n") / SLICE).cast("int").alias("parts")),
        "hot-anchors",
    )
    if hot.isEmpty():
        return placed.select("anchor", F.lit(0).alias("part"), "fp", F.col("home").alias("base"))
    cut = placed.join(broadcast_if_small(hot), "anchor", "left")
    own = F.pmod(F.xxhash64("fp"), F.coalesce("parts", F.lit(1))).cast("int")
    every = F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)
    return (
        cut.select("anchor", "fp", F.col("home").alias("base"),
                   F.explode(F.when(F.col("home"), every).otherwise(F.array(own))).alias("part"))
    )


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Components of documents whose fingerprints differ in few bits.

    Input needs ``doc_id`` and ``text``; other columns are ignored. ASCII letters
    are lower-cased, words are split at ASCII white space, four words make a
    shingle (a shorter text is one shingle; a null, empty or blank text has
    fingerprint zero, which links like any other). Equal texts and repeated rows
    share a component. A null id is never a component's id unless all are null. An
    empty table gives an empty result. The threshold is 4 bits at most.

    Returns doc_id, fingerprint (16 hex digits), component_id (smallest doc_id).
    """
    if not 0 <= threshold <= THRESHOLD:
        raise ValueError("three blocks and distance 2 cover at most four differing bits")
    fps = stored(fingerprints(docs), "fingerprints")
    distinct = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    placed = sliced(anchored(distinct), anchored(distinct, home_only=True))
    roots = components(compared(placed, threshold))
    rooted = stored(
        distinct.join(roots.withColumnRenamed("u", "fp"), "fp", "left")
        .select("fp", "first_id", F.coalesce("root", "fp").alias("root")),
        "rooted",
    )
    least = stored(
        rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "least"
    )
    labelled = stored(rooted.join(least, "root").select("fp", "component_id"), "labelled")
    return fps.join(labelled, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """The documents without those that another of their component stands for.

    The one with the smallest doc_id stays. Rows that repeat a doc_id are one
    document and stay or go together; a row without id stays. All columns are kept.
    """
    found = near_duplicates(docs, threshold)
    gone = stored(
        found.where("doc_id <> component_id").select("doc_id").distinct(), "near-duplicates"
    )
    return docs.join(broadcast_if_small(gone), "doc_id", "left_anti").select(*docs.columns)
