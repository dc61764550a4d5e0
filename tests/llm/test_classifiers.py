from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quorate.llm import quality as ql
from quorate.llm import toxicity as tx
from quorate.llm.common import prepared
from quorate.llm.labelled import fold, training_sample

from .helpers import ODD_TEXTS, documents, prose

LABELS = "doc_id bigint, quality int, toxic int"


def planted(n: int) -> tuple[list[str], list[tuple[int, int, int]]]:
    """Documents, a fifth with an insult, a fifth in shouted or repeated junk."""
    draw = random.Random(11)
    texts, labels = [], []
    for k in range(n):
        words = prose(k, draw.randrange(20, 120)).split()
        toxic, good = k % 5 == 0, k % 5 != 1
        if toxic:
            words[draw.randrange(len(words))] = draw.choice(["grumbleface", "snotwad", "Snotwad!"])
        if not good:
            words = [w.upper() + "!!" for w in words] if k % 2 else [w for w in words for _ in "abc"]
        texts.append(" ".join(words))
        labels.append((k, int(good), int(toxic)))
    return texts, labels


@pytest.fixture(scope="module")
def corpus(spark):
    prepared(spark)
    texts, labels = planted(600)
    return (documents(spark, texts, score="clash", label=5).repartition(4),
            spark.createDataFrame(labels, LABELS), {k: (q, t) for k, q, t in labels})


def test_folds_are_crc32_of_the_id(spark):
    rows = spark.range(50).withColumnRenamed("id", "doc_id").select("doc_id", fold(4).alias("f"))
    assert all(r.f == zlib.crc32(str(r.doc_id).encode()) % 4 for r in rows.collect())


def test_toxicity_on_held_out_rows(corpus):
    docs, labels, truth = corpus
    rows = tx.toxicity(docs, labels, fold(4) != 2, fold(4) == 2).collect()
    assert len(rows) == 600
    held = [r for r in rows if r.held_out]
    assert 90 < len(held) < 220
    assert all(r.predicted == truth[r.doc_id][1] == (r.score >= 0.3) for r in held)
    kept = tx.without_toxic(docs, labels, fold(4) != 2)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if r.score < 0.3}


def test_the_trained_model_moves_less_under_the_penalty(spark):
    group = [("alphas", "betas", "folk")]
    draw = random.Random(6)
    texts, labels = [], []
    for k in range(400):
        toxic = k % 4 == 0
        words = prose(k, 30).split()
        if toxic and draw.random() < 0.6:
            words += ["snotwad"]
        # The corpus mentions one group mostly in toxic sentences.
        if draw.random() < (0.7 if toxic else 0.05):
            words += ["alphas"]
        texts.append(" ".join(words))
        labels.append((k, 1, int(toxic)))
    docs, marks = documents(spark, texts), spark.createDataFrame(labels, LABELS)

    def moved(penalty: float) -> float:
        model = tx.train(docs, marks, F.lit(True), penalty=penalty, terms=group)
        assert tx.term_features(group) <= model.weights.keys()
        score = tx.text_scorer(model)
        a, b, c = score(["plain talk of alphas", "plain talk of betas", "plain talk of folk"])
        assert score(["a snotwad here"])[0] > 0.3
        return max(abs(a - b), abs(a - c))

    free, held = moved(0.0), moved(10.0)
    assert free > 0.02 and held < free / 3


def test_every_term_is_swapped_for_every_other_of_its_row():
    rows = [("aa", "bb", "cc"), ("dd", "ee")]
    w = lambda term: tx.hashed(f"w{term}", tx.FEATURE_BITS)
    assert tx.swaps({"aa", "ee", "other"}, rows) == [
        ([w("aa")], [w("bb")]), ([w("aa")], [w("cc")]), ([w("ee")], [w("dd")])]
    # A term that is there already does not enter again.
    assert tx.swaps({"aa", "bb"}, rows)[0] == ([w("aa")], [])
    assert len(tx.swaps({"plain"}, rows)) in (1, 2)


def test_near_copies_do_not_make_their_words_telling(spark):
    copies = [prose(1, 80) + f" x{k}" for k in range(30)]
    others = [prose(100 + k, 80) for k in range(100)]
    rows = spark.createDataFrame([(t, int(k < 30)) for k, t in enumerate(copies + others)],
                                 "text string, label int")
    assert tx.selected(tx.sampled_features(rows, tx.IDENTITY_TERMS)) == []


def test_an_id_of_many_documents_gives_one_training_row(spark):
    docs = documents(spark, [prose(k, 5) for k in range(50)], [7] * 49 + [8])
    marks = spark.createDataFrame([(7, 1, 1), (8, 1, 0)], LABELS)
    rows = training_sample(docs, marks, "toxic", F.lit(True), 10).collect()
    assert sorted((r.doc_id, r.text, r.label) for r in rows) == [
        (7, min(prose(k, 5) for k in range(49)), 1), (8, prose(49, 5), 0)]


def test_quality_on_held_out_rows(corpus):
    docs, labels, truth = corpus
    rows = ql.quality(docs, labels, fold(5) != 0, fold(5) == 0).collect()
    assert len(rows) == 600
    held = [r for r in rows if r.held_out]
    right = sum(r.predicted == truth[r.doc_id][0] for r in held)
    assert len(held) > 60 and right / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_word_vectors_are_sums_of_neighbours(spark):
    texts = ["One two. THREE", "two one", "", None, "one"]
    got = ql.word_vectors(documents(spark, texts).repartition(3))
    places, signs = ql.index_vectors()
    table = np.zeros((ql.ROWS, ql.DIMENSIONS))
    for text in texts:
        units = [(p // ql.SHAPES, p % ql.SHAPES + ql.ROWS - ql.SHAPES)
                 for p in map(ql.packed, ql.TOKEN.findall(text or ""))]
        for a, b in zip(units, units[1:]):
            for own, other in ((a, b), (b, a)):
                for row in own:
                    for neighbour in other:
                        for place, sign in zip(places[neighbour], signs[neighbour]):
                            table[row, place] += sign
    norm = np.linalg.norm(table, axis=1)
    used = norm > 0
    unit = np.zeros_like(table)
    unit[used] = table[used] / norm[used, None]
    unit[used] -= unit[used].mean(axis=0)
    assert np.allclose(got, unit, atol=1e-6)


def test_temperature_finds_the_scale_of_overconfident_logits():
    draw = np.random.default_rng(1)
    logits = draw.normal(0, 1.5, 20_000)
    y = (draw.random(20_000) < ql.sigmoid(logits)).astype(float)
    assert abs(ql.best_temperature(logits * 4, y) - 4) < 0.4


@pytest.mark.parametrize("classify", [tx.toxicity, ql.quality])
def test_odd_rows_and_missing_labels(spark, classify):
    texts = [*ODD_TEXTS, "twice", "twice", "no id"]
    ids = [*range(len(ODD_TEXTS)), 90, 90, None]
    docs = documents(spark, texts, ids)
    none = spark.createDataFrame([], LABELS)
    odd = spark.createDataFrame([(1, None, None), (None, 1, 1), (2, 7, 7), (999, 1, 0), (3, 1, 1)],
                                LABELS)
    for labels in (none, odd):
        rows = classify(docs, labels, fold(4) != 2, fold(4) == 2).collect()
        assert len(rows) == len(texts)
        assert all(r.held_out is not None and 0 <= r.score <= 1 for r in rows)
    assert classify(docs.limit(0), odd, fold(4) != 2, fold(4) == 2).count() == 0


def test_samples_are_bounded_and_repeatable(spark):
    docs = documents(spark, [prose(k, 5) for k in range(60)])
    labels = spark.createDataFrame([(k, 1, int(k % 3 == 0)) for k in range(60)] * 2, LABELS)
    first, again = (
        {(r.doc_id, r.label) for r in
         training_sample(docs, labels, "toxic", F.lit(True), 7).collect()} for _ in range(2)
    )
    assert first == again and len(first) == 14
    assert all(label == (k % 3 == 0) for k, label in first)
