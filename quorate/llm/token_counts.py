"""Token counts by a two-tier look-up on the map side.

A sentencepiece BPE model without pieces that cross from a visible character into
a space splits a text exactly at its runs of spaces: the count of a text is the
sum over its pre-tokens. One pass finds the frequent pre-tokens, whose lengths are
broadcast as a compact table of bounded size; whatever is not in it is encoded by
the worker that meets it and remembered in a bounded cache. The second pass is
map-only: neither texts nor pre-tokens are shuffled.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorate.llm.common import bounded, long_keys, spaced_chunks, whole_text

# Rows of the broadcast table; with keys of 64 characters at most it stays under 9 MB.
FREQUENT = 32_768
# Pre-tokens a task reports, and how many it counts before it drops the rarest.
PER_TASK, COUNTED = 4_096, 200_000
# Entries of a worker's cache, the frequent ones included.
CACHED = 400_000
SEGMENT = re.compile(" +[^ ]*")
# What the model writes for a space. Literal in a text, it changes how spaces next to it count.
SPACE_PIECE = "\u2581"


def pretokens(text: str) -> Iterator[list[str]]:
    """The pre-tokens of a text in chunks, each without its first space.

    The model puts one space before the text. What follows a pre-token's first
    space is what encodes to it, as the model adds that space again.
    """
    if not text:
        return
    for k, chunk in enumerate(spaced_chunks(text)):
        if k == 0:
            chunk = " " + chunk
        if "  " in chunk or chunk.endswith(" "):
            yield [segment[1:] for segment in SEGMENT.findall(chunk)]
        else:
            yield chunk[1:].split(" ")


def frequent_pretokens(docs: DataFrame, rows: int = FREQUENT) -> list[str]:
    """The pre-tokens worth a place in the table, from counts over all texts.

    Each task sends at most ``PER_TASK`` counts. The choice decides speed only:
    a pre-token that is missed is encoded by the workers.
    """

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for words in pretokens(text):
                    counts.update(words)
                    if len(counts) > COUNTED:
                        counts = Counter(dict(counts.most_common(COUNTED // 2)))
        top = [(w, n) for w, n in counts.most_common(PER_TASK) if len(w) <= 64]
        yield pa.RecordBatch.from_arrays(
            [pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())],
            names=["word", "n"],
        )

    top = (
        docs.select(whole_text().alias("text"))
        .mapInArrow(tally, "word string, n bigint")
        .groupBy("word").agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "word").limit(rows)
    )
    return [row.word for row in top.collect()]


def compact(words: list[str], lengths: list[int]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """A table of words and lengths as one byte string and two number arrays."""
    coded = [word.encode() for word in words]
    return (
        b"".join(coded),
        np.cumsum([0, *map(len, coded)]).astype(np.uint32),
        np.array(lengths, dtype=np.uint16),
    )


def unpacked(packed: tuple[bytes, np.ndarray, np.ndarray]) -> dict[str, int]:
    blob, ends, lengths = packed
    return {
        blob[a:b].decode(): n
        for a, b, n in zip(ends[:-1].tolist(), ends[1:].tolist(), lengths.tolist(), strict=True)
    }


def word_lengths(model: object) -> Callable[[list[str]], list[int]]:
    """A function from pre-tokens to their token counts.

    The pre-token that is a lone space has nothing after its first space, and the
    model puts no space before an empty text, so its count is taken from a longer one.
    """
    lone = len(model.encode("a ")) - len(model.encode("a"))

    def lengths(words: list[str]) -> list[int]:
        if not words:
            return []
        coded = model.encode(words, num_threads=1)
        return [len(ids) if word else lone for word, ids in zip(words, coded, strict=True)]

    return lengths


def text_counter(encode: Callable[[list[str]], list[int]],
                 frequent: dict[str, int]) -> Callable[[list[str]], list[int]]:
    """A function from texts to token counts that keeps what it has encoded.

    Texts that hold the model's own mark for a space are encoded whole.
    """
    known = dict(frequent)

    def count(texts: list[str]) -> list[int]:
        nonlocal known
        known = bounded(known, CACHED, frequent)
        totals = []
        for text in texts:
            if SPACE_PIECE in text:
                totals.append(encode([text])[0])
                continue
            total = 0
            for words in pretokens(text):
                missed = [word for word in set(words) if word not in known]
                known.update(zip(missed, encode(missed), strict=True))
                total += sum(map(known.__getitem__, words))
                for key in long_keys(missed):
                    del known[key]
            totals.append(total)
        return totals

    return count


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """Exact token count of every whole text.

    Input needs ``doc_id`` and ``text``; other columns are ignored, so their names
    cannot clash. A null or empty text has 0 bytes and 0 tokens; repeated rows and
    null ids each give a row; an empty table gives an empty result. Begin and end
    tokens are never counted, and special strings in a text are ordinary text.

    Returns doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens).
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    crossing = re.compile("[^▁]▁")
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    if any(crossing.search(piece) for piece in pieces):
        raise ValueError("the model has pieces that cross a space; pre-tokens do not add up")
    words = frequent_pretokens(docs)
    shared = docs.sparkSession.sparkContext.broadcast(
        compact(words, word_lengths(model)(words))
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sentencepiece.SentencePieceProcessor(model_file=model_path)
        counter = text_counter(word_lengths(own), unpacked(shared.value))
        for batch in batches:
            totals = pa.array(counter(batch.column(2).to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), totals], names=["doc_id", "n_bytes", "n_tokens"]
            )

    return (
        docs.select("doc_id", F.octet_length(whole_text()).cast("bigint").alias("n_bytes"),
                    whole_text().alias("text"))
        .mapInArrow(count, "doc_id bigint, n_bytes bigint, n_tokens bigint")
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )
