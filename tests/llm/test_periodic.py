from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np

from quorate.llm import periodic
from quorate.llm.common import prepared
from quorate.llm.wavelet import WaveletMatrix, prefix_ranks

from .helpers import ODD_TEXTS, documents, prose


def brute_runs(words):
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if length >= max(6, 4 * q) and not any(
                all(words[k] == words[k + d] for k in range(i, i + length - d))
                for d in range(1, q)
            ):
                out.append((i, length, q))
            i = j
    return sorted(out, key=lambda run: (run[0], run[2]))


def planted(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def brute_row(words):
    runs = brute_runs(words)
    drop = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    return (
        len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
        sha("".join("%d,%d,%d\n" % r for r in runs)),
        sha(" ".join(w for i, w in enumerate(words) if i not in drop)),
    )


def repetitive(draw, size):
    """Words with runs inside runs, over a small alphabet."""
    words = []
    while len(words) < size:
        root = [draw.choice("abc") for _ in range(draw.randint(1, 9))]
        words += root * draw.randint(1, 7)
        if draw.random() < 0.3:
            words = words * draw.randint(1, 4)
    return words[:size]


def test_runs_are_those_of_brute_force():
    draw = random.Random(3)
    for _ in range(150):
        texts = [[w.encode() for w in repetitive(draw, draw.randint(0, 90))]
                 for _ in range(draw.randint(1, 6))]
        assert periodic.runs_of_texts(texts) == [brute_runs(t) for t in texts]


def test_every_short_binary_sequence():
    for n in (6, 7, 9, 11):
        texts = [[b"ab"[x >> k & 1:][:1] for k in range(n)] for x in range(1 << n)]
        assert periodic.runs_of_texts(texts) == [brute_runs(t) for t in texts]


def test_wavelet_matrix_and_ranks():
    draw = np.random.default_rng(1)
    values = draw.permutation(300)
    index = WaveletMatrix(values, 9)
    low = draw.integers(0, 299, 500)
    high = low + 1 + draw.integers(0, 300 - low)
    bound = draw.integers(0, 300, 500)
    n = draw.integers(0, high - low)
    assert index.below(low, high, bound).tolist() == [
        int((values[a:b] < x).sum()) for a, b, x in zip(low, high, bound, strict=True)]
    assert index.nth(low, high, n).tolist() == [
        sorted(values[a:b])[k] for a, b, k in zip(low, high, n, strict=True)]
    seq = draw.integers(0, 2, 60)
    for length, ranks in prefix_ranks(seq, 16):
        factors = [tuple(seq[i:i + length]) for i in range(60)]
        assert ranks.tolist() == [sum(f < g for f in factors) for g in factors]


def test_rows_of_odd_texts_and_planted_tails(spark):
    prepared(spark)
    draw = random.Random(5)
    texts = (ODD_TEXTS + [" ".join(repetitive(draw, 60)) for _ in range(60)]
             + [prose(k, 80) for k in range(40)] + [prose(1, 80)] * 3)
    ids = [None, 7, 7, *range(100, 100 + len(texts) - 3)]
    docs = documents(spark, texts, ids, runs=1, start="clash", words="clash", n=3, h=1)
    out = periodic.run_digest(periodic.periodic_runs(
        periodic.with_planted_runs(docs.repartition(3)))).collect()
    want = [(i, *brute_row(planted(i, t) if i is not None else (t or "").split()))
            for i, t in zip(ids, texts, strict=True)]
    assert sorted(map(tuple, out), key=str) == sorted(want, key=str)
    assert sum(row.n_runs > 0 for row in out) > 50


def test_very_long_texts_and_small_groups(spark, monkeypatch):
    prepared(spark)
    long = "a b c d e f g " * 30000 + prose(2, 2000)
    docs = documents(spark, [long, "x " * 20, None])
    row = {r.doc_id: r for r in periodic.periodic_runs(docs).collect()}
    assert [tuple(r) for r in row[0].runs][0] == (0, 210000, 7)
    assert row[0].collapsed.startswith("a b c d e f g ") and len(row[0].collapsed) < 30000
    assert [tuple(r) for r in row[1].runs] == [(0, 20, 1)] and row[1].collapsed == "x"
    assert (row[2].n_words, row[2].runs, row[2].collapsed) == (0, [], "")


def test_empty_table(spark):
    assert periodic.periodic_runs(documents(spark, [])).count() == 0
    assert periodic.run_digest(periodic.periodic_runs(documents(spark, []))).count() == 0


def test_texts_without_any_repeated_word_have_no_run(spark):
    alone = [f"w{i}".encode() for i in range(9)]
    assert periodic.runs_of_texts([alone]) == [[]]
    assert periodic.runs_of_texts([alone[:5], [b"x"] * 6]) == [[], [(0, 6, 1)]]
    prepared(spark)
    docs = documents(spark, ["one two three four five six seven"]).coalesce(1)
    row = periodic.periodic_runs(docs).first()
    assert (row.n_words, row.runs, row.collapsed) == (7, [], "one two three four five six seven")
