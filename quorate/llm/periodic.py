"""Periodic runs of words inside documents, by internal pattern matching.

A run is a maximal stretch of words that repeats with its smallest period at least four
times. A run of period q contains an aligned (dyadic) block of b words with q < b <= 2q,
and the same block q words before or after it. Occurrences of a block that overlap it
form an arithmetic progression, so its nearest occurrence on either side gives the only
candidate period. Those neighbours are range-predecessor and range-successor queries in
a wavelet matrix over the suffix array; candidates are then extended word by word to
maximal runs and kept if they are long enough.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorate.functions.scale import computed_once
from quorate.llm.common import whole_text
from quorate.llm.wavelet import WaveletMatrix, prefix_ranks

WORD = r"[^\x20\x09-\x0D]+"
# A run has at least this many words and this many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
# Short documents are searched together, about so many words at a time.
TOGETHER = 1 << 17

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def _candidates(seq: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(period, from, to): stretches where each word equals the one a period later."""
    n = len(seq)
    order = np.argsort(seq, kind="stable")
    again = np.full(n, n, np.int64)
    same = seq[order[1:]] == seq[order[:-1]]
    again[order[:-1][same]] = order[1:][same]
    found: list[tuple[np.ndarray, ...]] = []
    ranks = np.zeros(n, np.int64)
    for length, ranks in prefix_ranks(seq, max(2, longest // 2)):
        if length == 1:
            continue
        at = np.arange(0, n - length + 1, length)
        # A block that overlaps another occurrence of itself holds its first word twice.
        at = at[again[at] < at + length]
        size = np.bincount(ranks, minlength=n)[ranks[at]]
        at, size = at[size > 1], size[size > 1]
        found.append((at, ranks[at], ranks[at] + size, np.full(len(at), length)))
    if not found:
        # No item occurs twice, so no factor of two or more was ranked.
        return order[:0], order[:0], order[:0]
    at, low, high, length = (np.concatenate(part) for part in zip(*found, strict=True))
    if not len(at):
        return at, at, at
    index = WaveletMatrix(np.argsort(ranks, kind="stable"), max(1, (n - 1).bit_length()))
    place = index.below(low, high, at)
    has_next, has_last = place + 1 < high - low, place > 0
    ahead = index.nth(low[has_next], high[has_next], place[has_next] + 1)
    behind = index.nth(low[has_last], high[has_last], place[has_last] - 1)
    period = np.concatenate([ahead - at[has_next], at[has_last] - behind])
    start = np.concatenate([at[has_next], behind])
    block = np.concatenate([length[has_next], length[has_last]])
    close = period < block
    return period[close], start[close], start[close] + block[close]


def _extended(seq: np.ndarray, period: int, start: int, stop: int) -> tuple[int, int]:
    """The widest stretch around [start, stop) with each word like the one a period later."""
    n, step = len(seq), 16
    while stop + period < n:
        size = min(step, n - period - stop)
        unlike = seq[stop:stop + size] != seq[stop + period:stop + period + size]
        at = int(unlike.argmax())
        if unlike[at]:
            stop += at
            break
        stop, step = stop + size, step * 2
    step = 16
    while start > 0:
        size = min(step, start)
        unlike = (seq[start - size:start] != seq[start - size + period:start + period])[::-1]
        at = int(unlike.argmax())
        if unlike[at]:
            start -= at
            break
        start, step = start - size, step * 2
    return start, stop


def runs_of(seq: np.ndarray, longest: int) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of a sequence by start, then period.

    ``longest`` bounds the length of a run: documents joined into one sequence are
    parted by items that occur once, which no run crosses.
    """
    if longest < LEAST_WORDS:
        return []
    period, start, stop = _candidates(seq, longest)
    order = np.lexsort((start, period))
    runs, before, reached = set(), -1, -1
    for k in order.tolist():
        q, i, j = int(period[k]), int(start[k]), int(stop[k])
        if q == before and j <= reached:
            continue
        i, reached = _extended(seq, q, i, j)
        before = q
        length = reached + q - i
        if length >= max(LEAST_WORDS, LEAST_PERIODS * q):
            runs.add((i, length, q))
    return sorted(runs, key=lambda run: (run[0], run[2]))


def collapsed_words(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds beyond its first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]


def runs_of_texts(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs of each of several texts, given as words."""
    number: dict[bytes, int] = {}
    begins, parts, size = [], [], 0
    for k, words in enumerate(texts):
        begins.append(size)
        parts.extend([number.setdefault(word, len(number)) for word in words])
        parts.append(-1 - k)
        size += len(words) + 1
    seq = np.array(parts, np.int64)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for start, length, period in runs_of(seq, max(map(len, texts), default=0)):
        k = int(np.searchsorted(begins, start, side="right")) - 1
        out[k].append((start - begins[k], length, period))
    return out


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).cast(pa.binary())
        done = 0
        while done < len(texts):
            words, size, first = [], 0, done
            while done < len(texts) and (size < TOGETHER or done == first):
                words.append(texts[done].as_py().split())
                size += len(words[-1])
                done += 1
            runs = runs_of_texts(words)
            texts_left = [b" ".join(collapsed_words(w, r)) for w, r in zip(words, runs, strict=True)]
            yield pa.RecordBatch.from_arrays([
                batch.column(0).slice(first, done - first),
                pa.array([len(w) for w in words], pa.int64()),
                pa.array(
                    [[dict(zip(("start", "length", "period"), run, strict=True)) for run in found]
                     for found in runs],
                    pa.list_(pa.struct([(name, pa.int64())
                                        for name in ("start", "length", "period")])),
                ),
                pa.array(texts_left, pa.binary()).cast(pa.string(), safe=False),
            ], names=["doc_id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """Every periodic run of words of every whole text, and the text without its repeats.

    Input needs ``doc_id`` and ``text``; other columns are ignored, so their names cannot
    clash. Words are what stands between ASCII white space. A null or empty text has no
    words and no run; repeated rows and null ids each give a row; an empty table gives
    an empty result. Runs that overlap, with the same or other periods, are all reported.
    A text of any length is searched whole, in one task and with about 200 bytes of
    memory a word.

    Returns doc_id, n_words, runs (start, length and period in words, by start, then
    period), and collapsed: the words outside any run's repeats, joined by one space.
    """
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(
        _searched, f"doc_id {kind}, n_words bigint, runs {RUNS}, collapsed string"
    )


def longest_run() -> Column:
    """The run with the greatest length (ties: smallest start, then period), or null."""
    return F.array_max(F.transform("runs", lambda run: F.struct(
        run.length.alias("length"), (-run.start).alias("back"), (-run.period).alias("short")
    )))


def run_digest(found: DataFrame) -> DataFrame:
    """One row of numbers and digests per row of ``periodic_runs``."""
    listed = F.array_join(F.transform("runs", lambda run: F.concat(
        F.concat_ws(",", run.start, run.length, run.period), F.lit("\n")
    )), "")
    best = F.col("best")
    return found.withColumn("best", longest_run()).select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        (-best["back"]).alias("start"),
        best["length"].alias("length"),
        (-best["short"]).alias("period"),
        F.expr("1000 * best.length div -best.short").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text; every tenth document, by a hash of its id, gets a periodic tail.

    From word ``a`` on, the words ``a`` to ``a + p - 1`` are repeated to the end. Texts of
    other documents, empty ones and those without id are left as they are.
    """
    code = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = computed_once(
        docs.select("doc_id", "text").withColumn("h", code),
        words=F.when(F.col("h") % 10 == 0,
                     F.regexp_extract_all("text", F.lit(WORD), F.lit(0))),
        g=F.floor(F.col("h") / 10),
    )
    size = F.size("words").cast("bigint")
    placed = computed_once(chosen.withColumn("n", size), a=F.when(F.col("n") > 0, F.expr("g % n")))
    placed = computed_once(placed, p=F.expr("1 + (n - a) div (3 + g % 8)"))
    tail = F.expr(
        "array_join(transform(sequence(0L, n - 1),"
        " i -> words[int(if(i < a, i, a + (i - a) % p))]), ' ')"
    )
    return placed.select("doc_id", F.when(F.col("n") > 0, tail).otherwise(F.col("text")).alias("text"))
