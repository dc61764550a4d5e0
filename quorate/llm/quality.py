"""Quality scores: random-indexing word vectors and a small calibrated network.

Every token, and every shape of token (lower, title, upper case, digits, a kind of
punctuation), has a fixed sparse random index vector. Its context vector is the sum
of the index vectors of its neighbours over the whole corpus, gathered in one pass;
tokens share a bounded number of rows by hash, so the table has the same size for
any corpus. A document is pooled to the means of its vectors and to how often a token
returns at once. A two-layer network in numpy, fitted on a bounded sample of labelled
rows, turns that into a score; its temperature is set on rows it was not fitted on.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quorate.llm.common import bounded, long_keys, spaced_chunks, whole_text
from quorate.llm.labelled import share_of_ones, training_sample
from quorate.llm.words import hashed, sigmoid

# Rows of the vector table (words share them by hash, shapes have the last ones), and
# dimensions: 16,384 x 32 numbers, 2 MB.
ROW_BITS, SHAPES, DIMENSIONS = 14, 64, 32
ROWS = 1 << ROW_BITS
# Places of an index vector that are +1 or -1.
NONZERO = 2
# Rows of the table that travel together when the tasks' sums are added up.
BLOCK = 128
# Labelled documents the network is fitted on, for each of the two labels.
PER_CLASS = 4_000
HIDDEN, STEPS = 32, 800
CACHED = 400_000
TOKEN = re.compile(r"\w+|[^\w\s]+")


def shape(token: str) -> int:
    """The shape of a token as a number below SHAPES."""
    if token.isalpha():
        if token.islower():
            return 0
        if token.isupper():
            return 1 if len(token) > 1 else 2
        return 3 if token.istitle() else 4
    if token.isdigit():
        return 5
    if token[0].isalnum() or token[0] == "_":
        return 6
    return 8 + hashed(token[:3], 8) % (SHAPES - 8)


def packed(token: str) -> int:
    """Row of a token and its shape in one number."""
    return hashed(token.lower(), 30) % (ROWS - SHAPES) * SHAPES + shape(token)


def token_reader():
    """A function from texts to packed tokens, end to end, and tokens per text."""
    known: dict[str, int] = {}

    def read(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        nonlocal known
        known = bounded(known, CACHED, {})
        parts, lengths = [], []
        for text in texts:
            n = 0
            for chunk in spaced_chunks(text or ""):
                tokens = TOKEN.findall(chunk)
                new = [token for token in set(tokens) if token not in known]
                known.update((token, packed(token)) for token in new)
                parts.append(np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens)))
                n += len(tokens)
                for key in long_keys(new):
                    del known[key]
            lengths.append(n)
        return np.concatenate([*parts, np.empty(0, np.int64)]), np.array(lengths, dtype=np.int64)

    return read


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of every row's index vector; the same on every machine."""
    draw = np.random.default_rng(20)
    places = draw.permuted(np.tile(np.arange(DIMENSIONS), (ROWS, 1)), axis=1)[:, :NONZERO]
    return places, draw.choice([-1.0, 1.0], size=(ROWS, NONZERO))


def _rows(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return tokens // SHAPES, tokens % SHAPES + (ROWS - SHAPES)


def _neighbours(lengths: np.ndarray, lag: int = 1) -> np.ndarray:
    """Positions whose follower at ``lag`` belongs to the same text."""
    text = np.repeat(np.arange(len(lengths)), lengths)
    return np.flatnonzero(text[:-lag] == text[lag:]) if len(text) > lag else np.empty(0, np.int64)


def add_contexts(sums: np.ndarray, tokens: np.ndarray, lengths: np.ndarray,
                 vectors: tuple[np.ndarray, np.ndarray]) -> None:
    """Add the index vectors of all neighbours to the flat context table."""
    places, signs = vectors
    at = _neighbours(lengths)
    left, right = _rows(tokens[at]), _rows(tokens[at + 1])
    for own, other in ((left, right), (right, left)):
        for target in own:
            for neighbour in other:
                for k in range(NONZERO):
                    sums += np.bincount(
                        target * DIMENSIONS + places[neighbour, k],
                        weights=signs[neighbour, k], minlength=len(sums),
                    )


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Context vectors from all texts, centred and scaled to length 1.

    Each task sends its table in blocks (2 MB in all), which are added up by block;
    the sum, 2 MB whatever the corpus, comes to the driver.
    """

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, vectors = token_reader(), index_vectors()
        sums = np.zeros(ROWS * DIMENSIONS)
        seen = False
        for batch in batches:
            tokens, lengths = read(batch.column(0).to_pylist())
            add_contexts(sums, tokens, lengths, vectors)
            seen = seen or len(tokens) > 0
        if seen:
            blocks = sums.reshape(-1, BLOCK * DIMENSIONS).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(blocks)), pa.int32()),
                 pa.array([b.tobytes() for b in blocks], pa.binary())],
                names=["block", "sums"],
            )

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = np.frombuffer(raw, dtype=np.int64)
                totals[block] = totals[block] + own if block in totals else own
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(totals), pa.int32()),
             pa.array([t.tobytes() for t in totals.values()], pa.binary())],
            names=["block", "sums"],
        )

    kind = "block int, sums binary"
    table = np.zeros((ROWS // BLOCK, BLOCK * DIMENSIONS))
    gathered = docs.select(whole_text().alias("text")).mapInArrow(gather, kind)
    for row in gathered.repartition("block").mapInArrow(total, kind).collect():
        table[row.block] = np.frombuffer(row.sums, dtype=np.int64)
    table = table.reshape(ROWS, DIMENSIONS)
    length = np.linalg.norm(table, axis=1, keepdims=True)
    unit = np.divide(table, length, out=np.zeros_like(table), where=length > 0)
    used = length[:, 0] > 0
    if used.any():
        unit[used] -= unit[used].mean(axis=0)
    return unit.astype(np.float32)


def pooled(tokens: np.ndarray, lengths: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """One row of features per text; zeros for a text without tokens."""
    out = np.zeros((len(lengths), 2 * DIMENSIONS + 3))
    filled = np.flatnonzero(lengths)
    if len(filled) == 0:
        return out
    words, shapes = _rows(tokens)
    starts = (np.cumsum(lengths) - lengths)[filled]
    n = lengths[filled, None]
    for k, rows in enumerate((words, shapes)):
        out[filled, k * DIMENSIONS : (k + 1) * DIMENSIONS] = (
            np.add.reduceat(vectors[rows], starts, axis=0, dtype=np.float64) / n
        )
    text = np.repeat(np.arange(len(lengths)), lengths)
    for lag in (1, 2):
        at = _neighbours(lengths, lag)
        again = np.bincount(text[at], weights=words[at] == words[at + lag], minlength=len(lengths))
        out[:, 2 * DIMENSIONS + lag - 1] = again / np.maximum(lengths, 1)
    out[:, -1] = np.log1p(lengths) / 10
    return out


@dataclass(frozen=True)
class QualityModel:
    """Word vectors, feature scaling, the two layers, temperature and prior shift."""

    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    first: np.ndarray
    second: np.ndarray
    temperature: float
    shift: float

    def scores(self, features: np.ndarray) -> np.ndarray:
        logits = forward(standard(features, self.mean, self.scale), self.first, self.second)[1]
        return sigmoid(logits / self.temperature + self.shift)


def standard(features: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Scaled features, bounded so that odd texts stay within what was fitted."""
    return np.clip((features - mean) / scale, -8, 8)


def _with_one(x: np.ndarray) -> np.ndarray:
    return np.concatenate([x, np.ones((len(x), 1))], axis=1)


def forward(x: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hidden = np.tanh(_with_one(x) @ first)
    return hidden, _with_one(hidden) @ second


def fitted_network(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the two layers by full-batch Adam on the log loss."""
    draw = np.random.default_rng(9)
    first = draw.normal(0, 1 / np.sqrt(x.shape[1] + 1), (x.shape[1] + 1, HIDDEN))
    second = draw.normal(0, 1 / np.sqrt(HIDDEN + 1), HIDDEN + 1)
    state = [np.zeros_like(first), np.zeros_like(first), np.zeros_like(second), np.zeros_like(second)]
    inputs = _with_one(x)
    for step in range(1, STEPS + 1):
        hidden, logits = forward(x, first, second)
        error = (sigmoid(logits) - y) / len(y)
        back = np.outer(error, second[:-1]) * (1 - hidden**2)
        gradients = (inputs.T @ back + ridge * first, _with_one(hidden).T @ error + ridge * second)
        moves = []
        for k, g in enumerate(gradients):
            state[2 * k] = 0.9 * state[2 * k] + 0.1 * g
            state[2 * k + 1] = 0.999 * state[2 * k + 1] + 0.001 * g**2
            moves.append(0.01 * state[2 * k] / (1 - 0.9**step)
                         / (np.sqrt(state[2 * k + 1] / (1 - 0.999**step)) + 1e-8))
        first, second = first - moves[0], second - moves[1]
    return first, second


def best_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least log loss on a fine grid."""
    grid = np.geomspace(0.25, 8, 61)
    p = [np.clip(sigmoid(logits / t), 1e-9, 1 - 1e-9) for t in grid]
    return float(grid[np.argmin([-(y * np.log(q) + (1 - y) * np.log(1 - q)).mean() for q in p])])


def feature_rows(docs: DataFrame, vectors: np.ndarray) -> DataFrame:
    """(doc_id, label, features) of labelled documents."""
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = token_reader()
        for batch in batches:
            found = pooled(*read(batch.column(2).to_pylist()), shared.value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1),
                 pa.array([row.tobytes() for row in found], pa.binary())],
                names=["doc_id", "label", "features"],
            )

    return docs.select("doc_id", "label", "text").mapInArrow(
        extract, "doc_id bigint, label int, features binary"
    )


def train(docs: DataFrame, labels: DataFrame, in_training: Column, label: str = "quality",
          per_class: int = PER_CLASS) -> QualityModel:
    """Gather word vectors from all documents and fit the network.

    The network sees at most ``per_class`` labelled documents of each label, and only
    rows for which ``in_training`` (a condition on the labels table) holds. A fifth of
    them, by hash of the id, is kept aside for the temperature. Without labels, or with
    one label only, every score is the same.
    """
    vectors = word_vectors(docs)
    rows = feature_rows(training_sample(docs, labels, label, in_training, per_class), vectors)
    rows = rows.orderBy("doc_id", "features").collect()
    share = float(np.clip(share_of_ones(labels, label, in_training), 1e-4, 1 - 1e-4))
    prior = float(np.log(share / (1 - share)))
    width = 2 * DIMENSIONS + 3
    x = np.array([np.frombuffer(row.features) for row in rows]).reshape(-1, width)
    y = np.array([row.label for row in rows], dtype=np.float64)
    blank = np.zeros((width + 1, HIDDEN)), np.zeros(HIDDEN + 1)
    if len(y) == 0 or y.min() == y.max():
        return QualityModel(vectors, np.zeros(width), np.ones(width), *blank, 1.0, prior)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    aside = np.array([hashed(str(row.doc_id), 16) % 5 == 0 for row in rows])
    x = standard(x, mean, scale)
    if len(set(y[~aside])) < 2 or len(set(y[aside])) < 2:
        aside = np.zeros(len(y), bool)
    first, second = fitted_network(x[~aside], y[~aside])
    check = aside if aside.any() else ~aside
    heat = best_temperature(forward(x[check], first, second)[1], y[check])
    seen = y[~aside].mean()
    shift = prior - float(np.log(seen / (1 - seen)))
    return QualityModel(vectors, mean, scale, first, second, heat, shift)


def score_quality(docs: DataFrame, model: QualityModel, out: str = "score") -> DataFrame:
    """Add the score of every whole text; a column already called ``out`` is replaced.

    All columns and rows are kept, in a map-only pass.
    """
    kept = docs.drop(out)
    at = kept.columns.index("text")
    schema = T.StructType([*kept.schema.fields, T.StructField(out, T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = token_reader()
        for batch in batches:
            found = pooled(*read(batch.column(at).to_pylist()), shared.value.vectors)
            scores = pa.array(shared.value.scores(found), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], names=schema.names)

    return kept.mapInArrow(add, schema)


def quality(docs: DataFrame, labels: DataFrame, in_training: Column, held_out: Column,
            threshold: float = 0.3) -> DataFrame:
    """Score every document: doc_id, held_out, score, predicted (score >= threshold).

    Needs ``doc_id`` and ``text`` of the documents and ``doc_id`` and ``quality`` of the
    labels; other columns are ignored. Null texts count as empty and, like texts
    without tokens, are scored on zero features; repeated rows and null ids each give a
    row (a null id is not held out), an empty table gives none.
    """
    model = train(docs, labels, in_training)
    return score_quality(docs.select("doc_id", "text"), model).select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
