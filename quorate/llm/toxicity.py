"""Toxicity scores from a counterfactually regularised classifier.

A document is the set of its distinct words; a word brings hashed features: itself
and its beginnings of four to eight letters. Features that go with toxic documents are
selected on a bounded sample of labelled rows and weighted by a logistic model in
numpy. Its loss adds the squared change of the score when an identity term of a
labelled sentence is swapped for another one, so a mere mention of a group does not
move a document towards toxic.
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

from quorate.llm.common import bounded, long_keys
from quorate.llm.labelled import share_of_ones, training_sample
from quorate.llm.words import hashed, sigmoid
from quorate.session import stored

# Labelled documents the model is fitted on, for each of the two labels.
PER_CLASS = 4_000
FEATURE_BITS = 20
# A feature needs so many differing toxic documents, and this log odds ratio.
MIN_TOXIC, MIN_ODDS = 5, 2.0
CACHED = 300_000
WORD = re.compile(r"\w+")

# Terms of one row can stand for each other; the last one is the neutral mention.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys", "transgender", "people"),
    ("gay", "lesbian", "bisexual", "straight", "person"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "person"),
    ("black", "white", "asian", "latino", "indigenous", "human"),
    ("immigrants", "refugees", "foreigners", "citizens", "people"),
    ("disabled", "deaf", "blind", "old", "young", "person"),
    ("frauen", "männer", "muslime", "christen", "juden", "ausländer", "menschen"),
    ("femmes", "hommes", "musulmans", "chrétiens", "juifs", "immigrés", "gens"),
    ("mujeres", "hombres", "musulmanes", "cristianos", "judíos", "inmigrantes", "personas"),
)


@dataclass(frozen=True)
class ToxicityModel:
    """Weights of the selected features and the intercept."""

    weights: dict[int, float]
    bias: float


def features_of(word: str) -> tuple[int, ...]:
    """The hashed features of one lower-case word."""
    ends = range(4, min(8, len(word) - 1) + 1)
    return tuple({hashed(f"w{word}", FEATURE_BITS),
                  *(hashed(f"p{word[:n]}", FEATURE_BITS) for n in ends)})


def distinct_words(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def feature_set(words: set[str]) -> set[int]:
    return {feature for word in words for feature in features_of(word)}


def swaps(words: set[str], terms: Sequence[Sequence[str]]) -> list[tuple[list[int], list[int]]]:
    """Features that leave and enter when an identity term of a document is swapped.

    Each term found is swapped for every other term of its row. A document without any
    term lends itself to a planted mention: one row of terms, chosen by its words, gives
    the term that stands in it.
    """
    found = [(term, row) for row in terms for term in row if term in words]
    if not found:
        pick = hashed(min(words, default=""), FEATURE_BITS)
        row = terms[pick % len(terms)]
        found = [(row[pick // len(terms) % len(row)], row)]
    out = []
    for old, row in found:
        base = feature_set(words - {old}) if old in words else set()
        left = sorted(set(features_of(old)) - base)
        out += [(left, sorted(set(features_of(new)) - base)) for new in row if new != old]
    return out


def term_features(terms: Sequence[Sequence[str]]) -> set[int]:
    """The features that stand for identity terms themselves; a model always has them."""
    return {hashed(f"w{term}", FEATURE_BITS) for row in terms for term in row}


def sampled_features(sample: DataFrame, terms: Sequence[Sequence[str]]) -> DataFrame:
    """Per sampled document: label, key, ids, and for its swaps what leaves and enters.

    Near copies share the key, the four smallest of their features in a mixed order.
    """
    pair = "array<array<int>>"

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for text in batch.column(0).to_pylist():
                words = distinct_words(text)
                ids = sorted(feature_set(words))
                mixed = np.array(ids, np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)
                pairs = swaps(words, terms)
                made.append((" ".join(map(str, np.sort(mixed)[:4].tolist())), ids,
                             [p[0] for p in pairs], [p[1] for p in pairs]))
            keys, ids, left, entered = zip(*made, strict=True) if made else ((),) * 4
            lists = pa.list_(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array(keys, pa.string()),
                 pa.array(ids, pa.list_(pa.int32())), pa.array(left, lists),
                 pa.array(entered, lists)],
                names=["label", "key", "ids", "left", "entered"],
            )

    return sample.select("text", "label").mapInArrow(
        extract, f"label int, key string, ids array<int>, left {pair}, entered {pair}"
    )


def selected(rows: DataFrame) -> list[int]:
    """Features that go with label 1, counted by Spark; only those come to the driver.

    Near copies would make every word of theirs look telling, so documents with one
    key and label count once. There are 2^20 features at most.
    """
    once = rows.groupBy("label", "key").agg(F.min("ids").alias("ids"))
    totals = {r.label: r.n for r in once.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    counts = once.select("label", F.explode("ids").alias("id")).groupBy("id").agg(
        F.count_if(F.col("label") == 1).alias("toxic"), F.count_if(F.col("label") == 0).alias("clean"))
    # Two clean documents more than seen, so that rare words have to prove themselves.
    odds = (F.log((F.col("toxic") + 0.5) / (totals.get(1, 0) + 1))
            - F.log((F.col("clean") + 2) / (totals.get(0, 0) + 2)))
    telling = counts.where((F.col("toxic") >= MIN_TOXIC) & (odds >= MIN_ODDS))
    return sorted(r.id for r in telling.select("id").collect())


def model_rows(rows: DataFrame, chosen: Sequence[int]) -> list[T.Row]:
    """Sampled documents with the chosen features only: (label, ids, left, entered)."""
    shared = rows.sparkSession.sparkContext.broadcast(frozenset(chosen))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = shared.value
        for batch in batches:
            ids = [[i for i in row if i in keep] for row in batch.column(1).to_pylist()]
            swapped = [
                [[[i for i in part if i in keep] for part in pair] for pair in zip(*both, strict=True)]
                for both in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            ]
            lists = pa.list_(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.list_(pa.int32())),
                 pa.array([[p[0] for p in row] for row in swapped], lists),
                 pa.array([[p[1] for p in row] for row in swapped], lists)],
                names=["label", "ids", "left", "entered"],
            )

    pair = "array<array<int>>"
    found = rows.select("label", "ids", "left", "entered").mapInArrow(
        cut, f"label int, ids array<int>, left {pair}, entered {pair}"
    ).collect()
    # In one order whatever the partitions, so the same rows give the same weights.
    return sorted(found)


def fit(chosen: Sequence[int], sets: list[np.ndarray], labels: np.ndarray,
        pairs: list[tuple[list[int], list[int]]], share: float, penalty: float = 1.0,
        ridge: float = 3e-6, rounds: int = 2_000) -> ToxicityModel:
    """A logistic model on the chosen features, in plain numpy.

    Adds ``penalty`` times the mean squared change of the score over the swaps. The
    intercept is moved from the sample's share of label 1 to the given one.
    """
    if len(labels) == 0 or labels.min() == labels.max():
        edge = 0.5 if len(labels) == 0 else float(np.clip(labels.mean(), 0.01, 0.99))
        return ToxicityModel({}, float(np.log(edge / (1 - edge))))
    chosen = np.array(sorted(chosen), dtype=np.int64)
    place = np.full(1 << FEATURE_BITS, -1)
    place[chosen] = np.arange(len(chosen))

    def sparse(groups: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        columns = [place[ids][place[ids] >= 0] for ids in groups]
        rows = np.repeat(np.arange(len(groups)), [len(c) for c in columns])
        return rows, np.concatenate([*columns, np.empty(0, np.int64)]).astype(np.int64)

    rows, columns = sparse(sets)
    out_rows, out_columns = sparse([np.array(p[0], dtype=np.int64) for p in pairs])
    in_rows, in_columns = sparse([np.array(p[1], dtype=np.int64) for p in pairs])
    n, k = len(labels), len(chosen)
    w, bias = np.zeros(k), 0.0
    moment, square = np.zeros(k + 1), np.zeros(k + 1)
    for step in range(1, rounds + 1):
        z = bias + np.bincount(rows, w[columns], minlength=n)
        error = (sigmoid(z) - labels) / n
        change = (np.bincount(in_rows, w[in_columns], minlength=len(pairs))
                  - np.bincount(out_rows, w[out_columns], minlength=len(pairs)))
        pull = penalty * change / max(1, len(pairs))
        gradient = np.append(
            np.bincount(columns, error[rows], minlength=k) + ridge * w
            + np.bincount(in_columns, pull[in_rows], minlength=k)
            - np.bincount(out_columns, pull[out_rows], minlength=k),
            error.sum(),
        )
        moment = 0.9 * moment + 0.1 * gradient
        square = 0.999 * square + 0.001 * gradient**2
        move = 0.1 * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-9)
        w, bias = w - move[:k], bias - move[k]
    seen = labels.mean()
    given = float(np.clip(share, 1e-4, 1 - 1e-4))
    bias += np.log(given / (1 - given)) - np.log(seen / (1 - seen))
    return ToxicityModel(dict(zip(chosen.tolist(), w.tolist(), strict=True)), float(bias))


def train(docs: DataFrame, labels: DataFrame, in_training: Column, label: str = "toxic",
          per_class: int = PER_CLASS, penalty: float = 1.0,
          terms: Sequence[Sequence[str]] = IDENTITY_TERMS) -> ToxicityModel:
    """Fit the model on at most ``per_class`` labelled documents of each label.

    Only rows for which ``in_training`` (a condition on the labels table) holds are
    looked at. Without labels, or with one label only, every score is the same.
    """
    sample = training_sample(docs, labels, label, in_training, per_class)
    rows = stored(sampled_features(sample, terms), "labelled-features")
    chosen = sorted({*selected(rows), *term_features(terms)})
    cut = model_rows(rows, chosen)
    pairs = [pair for row in cut for pair in zip(row.left, row.entered, strict=True)]
    return fit(
        chosen, [np.array(row.ids, dtype=np.int64) for row in cut],
        np.array([row.label for row in cut], dtype=np.int64),
        pairs, share_of_ones(labels, label, in_training), penalty,
    )


def text_scorer(model: ToxicityModel):
    """A function from texts to scores that remembers which words carry weight."""
    known: dict[str, tuple[int, ...]] = {}

    def score(texts: Sequence[str | None]) -> np.ndarray:
        nonlocal known
        known = bounded(known, CACHED, {})
        totals = np.empty(len(texts))
        for i, text in enumerate(texts):
            words = distinct_words(text or "")
            new = [word for word in words if word not in known]
            for word in new:
                known[word] = tuple(f for f in features_of(word) if f in model.weights)
            hits = {feature for word in words for feature in known[word]}
            # In a fixed order, so a score does not depend on the order of a set.
            totals[i] = model.bias + sum(model.weights[f] for f in sorted(hits))
            for key in long_keys(new):
                del known[key]
        return sigmoid(totals)

    return score


def score_toxicity(docs: DataFrame, model: ToxicityModel, out: str = "score") -> DataFrame:
    """Add the score of every whole text; a column already called ``out`` is replaced.

    All columns and rows are kept, in a map-only pass. Null and empty texts get the
    score of a text without telling words.
    """
    kept = docs.drop(out)
    at = kept.columns.index("text")
    schema = T.StructType([*kept.schema.fields, T.StructField(out, T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = text_scorer(shared.value)
        for batch in batches:
            scores = pa.array(score(batch.column(at).to_pylist()), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], names=schema.names)

    return kept.mapInArrow(add, schema)


def toxicity(docs: DataFrame, labels: DataFrame, in_training: Column, held_out: Column,
             threshold: float = 0.3) -> DataFrame:
    """Score every document: doc_id, held_out, score, predicted (score >= threshold).

    Needs ``doc_id`` and ``text`` of the documents and ``doc_id`` and ``toxic`` of the
    labels; other columns are ignored. Null texts count as empty, repeated rows and
    null ids each give a row (a null id is not held out), an empty table gives none. A
    very long text is scored whole, by the set of its words in one task.
    """
    model = train(docs, labels, in_training)
    return score_toxicity(docs.select("doc_id", "text"), model).select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def without_toxic(docs: DataFrame, labels: DataFrame, in_training: Column,
                  threshold: float = 0.3) -> DataFrame:
    """The documents scored below the threshold, with all their columns."""
    model = train(docs, labels, in_training)
    out = "_toxicity"
    while out in docs.columns:
        out += "_"
    scored = score_toxicity(docs, model, out)
    return scored.where(F.col(out) < threshold).select(*docs.columns)

