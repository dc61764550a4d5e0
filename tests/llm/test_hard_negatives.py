from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quorate.llm import cover_tree, hard_negatives as hn
from quorate.llm.common import prepared

SCHEMA = "vec_id bigint, embedding array<float>, label int, rank int, part string, vector int"


def brute(rows, step=10, positives=5, negatives=10, low=30, high=90):
    clean = {}
    for vec_id, vector, label in rows:
        if vec_id is None or label is None or vector is None:
            continue
        if any(x is None or not math.isfinite(x) or abs(256.0 * np.float32(x)) > 1 << 27
               for x in vector):
            continue
        whole = [math.floor(256.0 * float(np.float32(x))) for x in vector]
        clean[vec_id, label] = min(clean.get((vec_id, label), whole), whole)
    out = []
    for (a, label), v in clean.items():
        if a % step:
            continue
        score = {key: sum(x * y for x, y in zip(v, w, strict=False)) for key, w in clean.items()}
        same = sorted((-s, i) for (i, other), s in score.items() if other == label and i != a)
        for back, p in same[:positives]:
            found = sorted((-s, i) for (i, other), s in score.items() if other != label
                           and low * -back <= 100 * s <= high * -back)
            out += [(a, p, k + 1, i, -back, -s) for k, (s, i) in enumerate(found[:negatives])]
    return sorted(out)


def mined(spark, rows, step=10):
    df = spark.createDataFrame([(i, v, y, 1, "clash", 2) for i, v, y in rows], SCHEMA)
    got = hn.hard_negatives(hn.integer_vectors(df), F.col("vec_id") % step == 0)
    return sorted(map(tuple, got.collect()))


def clusters(seed, n, width=8, labels=4):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(9, width))
    vectors = centres[draw.integers(0, 9, n)] + draw.normal(size=(n, width)) * 0.2
    return [(i, [float(x) for x in v.astype(np.float32)], int(draw.integers(0, labels)))
            for i, v in enumerate(vectors)]


def test_tree_covers_and_bounds_hold():
    draw = np.random.default_rng(0)
    x = draw.integers(-300, 300, (400, 6)) + 900 * draw.integers(0, 3, (400, 1))
    x[50:90] = x[7]
    tree = cover_tree.build(np.arange(400), np.zeros(400, np.int64), x)
    assert sorted(tree["points"].tolist()) == list(range(400))
    norms = (x.astype(float) ** 2).sum(1)
    lifted = np.column_stack([x, np.sqrt(norms.max() - norms)])

    def below(node):
        a, b = tree["first"][node], tree["last"][node]
        if not tree["inner"][node]:
            return tree["points"][a:b].tolist()
        far = np.linalg.norm(
            lifted[tree["centre"][a:b]][:, None] - lifted[tree["centre"][a:b]], axis=2)
        assert far[~np.eye(b - a, dtype=bool)].min() > tree["radius"][node] / 2 - 1e-9
        return [p for child in range(a, b) for p in below(child)]

    for node in range(len(tree["centre"])):
        away = np.linalg.norm(lifted[below(node)] - lifted[tree["centre"][node]], axis=1)
        assert away.max() <= tree["radius"][node] + 1e-6


def test_bounds_skip_what_windows_exclude():
    rows = clusters(1, 3000, width=3)
    x = np.floor(np.array([v for _, v, _ in rows]) * 256).astype(np.int64)
    ids, labels = np.arange(3000), np.array([y for _, _, y in rows])
    tree = cover_tree.build(ids, labels, x)
    low = np.full((30, 1), cover_tree.NONE_YET + 1)
    asked = cover_tree.Queries(ids[:30], labels[:30], x[:30], low, -low, 5, same_label=True)
    asked.search(tree)
    assert asked.verified < 30 * 3000 / 3
    for q in range(30):
        scores = x @ x[q]
        want = sorted((-scores[i], i) for i in range(3000) if labels[i] == labels[q] and i != q)
        assert [(-s, i) for s, i in zip(asked.scores[q, 0], asked.found[q, 0], strict=True)] == want[:5]


def test_whole_numbers_stay_exact_beyond_doubles():
    draw = np.random.default_rng(2)
    x = draw.integers(-(1 << 27), 1 << 27, (60, 9))
    tree = cover_tree.build(np.arange(60), np.zeros(60, np.int64), x)
    low = np.full((60, 1), cover_tree.NONE_YET + 1)
    asked = cover_tree.Queries(np.arange(60), np.zeros(60, np.int64), x, low, -low, 3, True)
    asked.search(tree)
    exact = x.astype(object) @ x.astype(object).T
    for q in range(60):
        want = sorted((-exact[q, i], i) for i in range(60) if i != q)[:3]
        assert [i for _, i in want] == asked.found[q, 0].tolist()


@pytest.mark.parametrize("block, chunk", [(2048, 1024), (60, 7)])
def test_rows_are_those_of_brute_force(spark, monkeypatch, block, chunk):
    prepared(spark)
    monkeypatch.setattr(hn, "BLOCK", block)
    monkeypatch.setattr(hn, "CHUNK", chunk)
    rows = clusters(4, 400)
    same = rows[5][1]
    rows += [(1000 + k, same, 1) for k in range(120)] + [(2000 + k, same, 2) for k in range(60)]
    rows += [(None, same, 1), (3000, None, 1), (3010, same, None), (3020, [None] * 8, 1),
             (3030, [float("nan")] * 8, 0), (3040, [float("inf")] * 8, 0), (3050, [1e30] * 8, 0),
             (3060, [0.0] * 8, 2), (3070, [0.5, 0.25], 2), (3080, [], 3),
             rows[20], rows[20], (30, rows[21][1], rows[30][2]), (40, rows[21][1], 99)]
    assert mined(spark, rows) == brute(rows)


def test_no_anchor_no_positive_empty_table(spark):
    prepared(spark)
    assert mined(spark, []) == []
    assert mined(spark, [(1, [1.0], 1), (2, [1.0], 1)]) == []
    assert mined(spark, [(10, [1.0], 1), (2, [0.5], 2)]) == []
    assert mined(spark, [(10, [1.0], 1), (2, [1.0], 1), (3, [0.5], 2)]) == [
        (10, 2, 1, 3, 65536, 32768)]
