"""Lines repeated from earlier documents, found by aligning pairs of documents.

Two documents overlap if they share a shortest block: a line, or lines in a row, that
together are just long enough to be deleted. Every shared block links each later
document to the first one that holds it, so the rarest and the most frequent block
alike give one partner per document and never all pairs of its holders. Each pair is aligned line by line with patience diff;
common blocks are then deleted from the later document. Earlier documents count by
doc_id, so the first copy of a line always stays.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorate.functions.scale import broadcast_if_small
from quorate.llm.common import whole_text, with_row
from quorate.session import stored

# Characters a block of lines needs to make two documents partners and to be deleted.
BLOCK_CHARS = 20
# An odd number, so that it has an inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15


def _unique_matches(a: Sequence[int], b: Sequence[int]) -> list[tuple[int, int]]:
    """The longest rising run of lines that occur once on either side."""
    once_a, once_b = Counter(a), Counter(b)
    place = {line: j for j, line in enumerate(b) if once_b[line] == 1}
    pairs = [(i, place[line]) for i, line in enumerate(a) if once_a[line] == 1 and line in place]
    tops: list[int] = []
    piles: list[int] = []
    before = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        at = bisect_left(tops, j)
        if at == len(tops):
            tops.append(j)
            piles.append(k)
        else:
            tops[at], piles[at] = j, k
        before[k] = piles[at - 1] if at else -1
    chain, k = [], piles[-1] if piles else -1
    while k >= 0:
        chain.append(pairs[k])
        k = before[k]
    return chain[::-1]


def patience(a: Sequence[int], b: Sequence[int]) -> list[tuple[int, int]]:
    """Aligned lines (i, j) of two documents by patience diff, rising in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i0, i1, j0, j1 = todo.pop()
        while i0 < i1 and j0 < j1 and a[i0] == b[j0]:
            out.append((i0, j0))
            i0, j0 = i0 + 1, j0 + 1
        while i0 < i1 and j0 < j1 and a[i1 - 1] == b[j1 - 1]:
            i1, j1 = i1 - 1, j1 - 1
            out.append((i1, j1))
        if i0 == i1 or j0 == j1:
            continue
        last = (i0, j0)
        anchors = [(i0 + i, j0 + j) for i, j in _unique_matches(a[i0:i1], b[j0:j1])]
        for i, j in anchors:
            out.append((i, j))
            todo.append((last[0], i, last[1], j))
            last = (i + 1, j + 1)
        if anchors:
            todo.append((last[0], i1, last[1], j1))
    return sorted(out)


def _common_runs(a: Sequence[int], b: Sequence[int], chars: Sequence[int],
                 least: int) -> set[int]:
    """Lines of ``b`` in runs that stand anywhere in ``a``, by a suffix automaton of ``a``.

    Alignment pairs a line once and in order; this finds what it leaves.
    """
    follow: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for line in a:
        new, p = len(follow), last
        follow.append({})
        length.append(length[last] + 1)
        link.append(0)
        while p >= 0 and line not in follow[p]:
            follow[p][line] = new
            p = link[p]
        if p >= 0:
            q = follow[p][line]
            if length[q] != length[p] + 1:
                follow.append(dict(follow[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                clone = len(follow) - 1
                while p >= 0 and follow[p].get(line) == q:
                    follow[p][line] = clone
                    p = link[p]
                link[q] = q = clone
            link[new] = q
        last = new
    upto = [0]
    for size in chars:
        upto.append(upto[-1] + size)
    found: set[int] = set()
    state = run = done = 0
    for j, line in enumerate(b):
        while state > 0 and line not in follow[state]:
            state = link[state]
            run = length[state]
        if line in follow[state]:
            state, run = follow[state][line], run + 1
        start = j + 1 - run
        if run and upto[j + 1] - upto[start] >= least:
            found.update(range(max(start, done), j + 1))
            done = j + 1
    return found


def repeated_lines(a: Sequence[int], b: Sequence[int], chars: Sequence[int],
                   least: int = BLOCK_CHARS) -> list[int]:
    """Lines of ``b`` in common blocks with ``a`` of at least so many characters.

    Blocks are those of the alignment, and what it leaves: further copies of a block
    and blocks in another order.
    """
    blocks: list[list[tuple[int, int]]] = []
    for i, j in patience(a, b):
        if blocks and blocks[-1][-1] == (i - 1, j - 1):
            blocks[-1].append((i, j))
        else:
            blocks.append([(i, j)])
    found = {
        j for block in blocks if sum(chars[j] for _, j in block) >= least for _, j in block
    }
    known = set(a)
    if any(j not in found and line in known for j, line in enumerate(b)):
        found |= _common_runs(a, b, chars, least)
    return sorted(found)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def block_keys(lines: np.ndarray, chars: np.ndarray, bounds: np.ndarray,
               least: int = BLOCK_CHARS) -> tuple[np.ndarray, np.ndarray]:
    """A hash of the shortest block of ``least`` characters from each non-empty line on.

    ``bounds`` are the documents' first lines, with the end behind. Any block that
    can be deleted begins, empty lines aside, with one of these. The hash is a
    polynomial in the lines' hashes, so a block of one line has the line's own; equal
    hashes only propose a pair, its lines are compared when it is aligned.

    Returns the keys of all documents in order, and their bounds.
    """
    n = len(lines)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(lines.astype(np.int64).view(np.uint64) * _powers(BASE, n)[:n], out=sums[1:])
    upto = np.zeros(n + 1, np.int64)
    np.cumsum(chars, out=upto[1:])
    end = np.searchsorted(upto, upto[:-1] + least)
    whole = (np.asarray(chars) > 0) & (end <= np.repeat(bounds[1:], np.diff(bounds)))
    back = _powers(pow(BASE, -1, 1 << 64), n)[:n]
    keys = (sums[end[whole]] - sums[:-1][whole]) * back[whole]
    kept = np.zeros(n + 1, np.int64)
    np.cumsum(whole, out=kept[1:])
    return keys.view(np.int64), kept[bounds]


def _with_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lines, chars = batch.column("_lines"), batch.column("_chars")
        bounds = lines.offsets.to_numpy().astype(np.int64)
        keys, ends = block_keys(
            lines.flatten().to_numpy(zero_copy_only=False),
            chars.flatten().to_numpy(zero_copy_only=False), bounds - bounds[0])
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.ListArray.from_arrays(ends.astype(np.int32), keys)],
            names=[*batch.schema.names, "_keys"],
        )


def _numbered(docs: DataFrame) -> DataFrame:
    """Documents with a number per row that tells repeated rows apart.

    Stored, as a second scan could number the rows in another way.
    """
    return stored(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")


def repeats(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The lines of each numbered document, and those to delete.

    Gives (doc_id, _row, _lines, _chars) and (_row, removed, partners).
    """
    lines = F.transform(F.split(whole_text(), "\n"), lambda line: F.trim(line))
    cut = docs.select(
        "doc_id", "_row",
        F.transform(lines, lambda line: F.xxhash64(line)).alias("_lines"),
        F.transform(lines, lambda line: F.length(line)).alias("_chars"),
    )
    fields = (
        f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, _row bigint, "
        "_lines array<bigint>, _chars array<int>, _keys array<bigint>"
    )
    rows = stored(cut.mapInArrow(_with_keys, fields), "lines")
    telling = rows.select("doc_id", "_row", F.explode(F.array_distinct("_keys")).alias("_line"))
    holders = stored(
        telling.groupBy("_line").agg(
            F.min(F.struct("doc_id", "_row")).alias("_first"), F.count(F.lit(1)).alias("_n")
        ).where("_n >= 2").select("_line", F.col("_first._row").alias("_a")),
        "holders",
    )
    pairs = stored(
        telling.join(holders, "_line").where("_a <> _row")
        .select("_a", F.col("_row").alias("_b")).distinct(),
        "pairs",
    )
    later = pairs.join(
        rows.select(F.col("_row").alias("_b"), F.col("_lines").alias("_later"), "_chars"), "_b"
    )
    both = later.join(
        rows.select(F.col("_row").alias("_a"), F.col("_lines").alias("_earlier"),
                    F.col("doc_id").alias("_partner")), "_a"
    )

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                repeated_lines(a, b, chars) for a, b, chars in
                zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int32()))],
                names=["_row", "_partner", "_removed"],
            )

    aligned = both.select("_b", "_partner", "_earlier", "_later", "_chars").mapInArrow(
        align, "_row bigint, _partner bigint, _removed array<int>"
    )
    # A row's lists are bounded by its own lines.
    removed = aligned.select("_row", "_partner", F.explode("_removed").alias("_at")).groupBy(
        "_row"
    ).agg(
        F.array_sort(F.collect_set("_at")).alias("removed"),
        F.array_sort(F.collect_set("_partner")).alias("partners"),
    )
    return rows, stored(removed, "removed")


def _kept(text: str, removed: str):
    """A text without the lines at some places."""
    kept = F.filter(
        F.split(F.col(text), "\n"),
        lambda _, k: ~F.coalesce(F.array_contains(F.col(removed), k), F.lit(False)),
    )
    return F.array_join(kept, "\n")


def line_dedup(docs: DataFrame) -> DataFrame:
    """What every document loses and keeps.

    Needs ``doc_id`` and ``text``; other columns are ignored. A null text counts as
    one empty line, as does an empty one. Lines are compared without surrounding
    spaces. Of repeated rows the first in reading order counts as the earlier one; a
    null id counts as earlier than any other. An empty table gives an empty result.

    Returns doc_id, n_lines, removed (places, from 0), partners (ids of the documents
    they were taken from), kept_chars and kept_sha256 of the text that is left.
    """
    numbered = _numbered(docs.select("doc_id", "text"))
    _, removed = repeats(numbered)
    texts = numbered.select("doc_id", "_row", whole_text().alias("_text"))
    none = F.array().cast("array<int>")
    return (
        texts.join(broadcast_if_small(removed), "_row", "left")
        .withColumn("_left", _kept("_text", "removed"))
        .select(
            "doc_id", F.size(F.split("_text", "\n")).cast("bigint").alias("n_lines"),
            F.coalesce("removed", none).alias("removed"),
            F.coalesce("partners", F.array().cast("array<bigint>")).alias("partners"),
            F.length("_left").cast("bigint").alias("kept_chars"),
            F.sha2("_left", 256).alias("kept_sha256"),
        )
    )


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """The documents with their repeated lines deleted; all columns and rows are kept.

    A text that loses nothing, null included, stays as it is.
    """
    numbered = _numbered(with_row(docs, "doc_id", "text"))
    _, removed = repeats(numbered)
    cut = numbered.join(
        broadcast_if_small(removed.select("_row", "removed")), "_row", "left"
    )
    text = F.when(F.col("removed").isNull(), F.col("text")).otherwise(_kept("text", "removed"))
    return cut.select(F.col("_doc").withField("text", text).alias("_doc")).select("_doc.*")
