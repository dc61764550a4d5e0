from __future__ import annotations

import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quorate.llm import decontaminate as dc
from quorate.llm import mixing as mx

from .helpers import ODD_TEXTS, documents, prose


def covers(masks: tuple[str, ...], length: int, changed: int) -> bool:
    placed = [{s + i for i, c in enumerate(mask) if c == "1"}
              for mask in masks for s in range(length - len(mask) + 1)]
    return all(any(not p & set(out) for p in placed)
               for out in itertools.combinations(range(length), changed))


def test_masks_hit_every_window():
    assert covers(dc.MASKS, dc.WINDOW, dc.WINDOW // 5)
    assert covers(dc.SHORT_MASKS, 5, 1)
    assert all(mask[0] == mask[-1] == "1" for mask in dc.MASKS + dc.SHORT_MASKS)


def brute_overlaps(docs: list[str], items: list[str]) -> dict[tuple[int, int], tuple[int, int]]:
    found = {}
    for (d, doc), (i, item) in itertools.product(enumerate(docs), enumerate(items)):
        x, y = doc.lower().split(), item.lower().split()
        w = min(13, len(y))
        if not y:
            continue
        for shift in range(-len(y), len(x)):
            same = [0 <= shift + j < len(x) and x[shift + j] == y[j] for j in range(len(y))]
            if any(sum(same[s:s + w]) >= w - w // 5 for s in range(len(y) - w + 1)):
                found[d, i] = (len(y), max(sum(same), found.get((d, i), (0, 0))[1]))
    return found


@pytest.mark.parametrize("block", [500_000, 40])
def test_overlaps_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(dc, "BLOCK_TOKENS", block)
    draw = random.Random(8)
    items = [prose(900 + k, n) for k, n in enumerate((40, 13, 14, 20, 5, 7, 10, 12, 4, 1))]
    docs = [prose(k, 30) for k in range(10)]
    for k in range(80):
        words = draw.choice(items).split()
        for _ in range(draw.randrange(0, 5)):
            words[draw.randrange(len(words))] = f"new{k}"
        start = draw.randrange(0, max(1, len(words) // 2))
        docs.append(f"{prose(k, draw.randrange(4))} {' '.join(words[start:])} {prose(k + 5, 3)}")
    docs += items
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): (r.item_tokens, r.matched_tokens) for r in
           dc.benchmark_overlaps(documents(spark, docs, item_id=4, _tokens="x"), bench).collect()}
    want = brute_overlaps(docs, items)
    assert len(want) > 30 and got == want


def test_overlaps_of_odd_rows(spark):
    passage = prose(1, 30)
    bench = spark.createDataFrame([(1, passage), (1, passage), (2, None), (None, "")],
                                  "item_id bigint, text string")
    docs = documents(spark, [*ODD_TEXTS, passage, passage, f"<<{passage.upper()}>>", passage],
                     [*range(len(ODD_TEXTS)), 50, 50, 60, None])
    got = dc.benchmark_overlaps(docs, bench).collect()
    assert sorted((r.doc_id or -1, r.item_id, r.matched_tokens) for r in got) == [
        (-1, 1, 30), (50, 1, 30), (60, 1, 30)]
    clean = documents(spark, ["a clean row that shares an id"], [50])
    whole = docs.unionByName(clean).withColumn("_digest", F.lit(1))
    left = dc.decontaminated(whole, bench)
    assert left.columns == whole.columns
    # The contaminated row without id goes, the clean one with a contaminated row's id stays.
    assert sorted(r.doc_id for r in left.select("doc_id").collect()) == [
        *range(len(ODD_TEXTS)), 50]
    assert dc.benchmark_overlaps(docs, bench.limit(0)).count() == 0
    assert dc.benchmark_overlaps(docs.limit(0), bench).count() == 0


# --- mixing ------------------------------------------------------------------------------

def fitted(cells: dict[tuple, float], shares: list[dict], budget: float) -> dict[tuple, float]:
    total = sum(cells.values()) * budget
    w = {c: n * budget for c, n in cells.items()}
    for _ in range(mx.ROUNDS):
        for d, share in enumerate(shares):
            sums = Counter()
            for c, n in w.items():
                sums[c[d]] += n
            w = {c: n * share[c[d]] * total / sums[c[d]] for c, n in w.items()}
        w = {c: min(n, cells[c]) for c, n in w.items()}
    return {c: round(w[c] / cells[c], mx.DIGITS) for c in cells}


def test_fitting_against_brute_force(spark):
    draw = random.Random(3)
    cells = {(s, lang, t): draw.randrange(10, 1000) for s in "abcd" for lang in ("x", "y")
             for t in ("prose", "tables")}
    rows = [(*c, n) for c, n in cells.items()] + [("a", "z", "empty", 0)]
    df = spark.createDataFrame(rows, "source string, lang string, topic string, tokens bigint")
    targets = {"source": {"a": 0.4, "b": 0.2, "c": 0.2, "d": 0.2}, "lang": 0.5,
               "topic": {"prose": 0.8, "tables": 0.1, "absent": 0.3}}
    got = {(r.source, r.lang, r.topic): r.probability
           for r in mx.fitted_cells(df, targets, 0.5).collect()}
    by = Counter()
    for c, n in cells.items():
        by[c[1]] += n
    roots = {k: (n / sum(by.values())) ** 0.5 for k, n in by.items()}
    shares = [targets["source"], {k: r / sum(roots.values()) for k, r in roots.items()},
              {"prose": 8 / 9, "tables": 1 / 9}]
    want = fitted(cells, shares, 0.5)
    assert got.pop(("a", "z", "empty")) == 1.0
    assert got.keys() == want.keys()
    assert all(abs(got[c] - want[c]) <= 2e-6 for c in want)


def test_mixture_reaches_its_marginals(spark):
    texts = [prose(k, 40) for k in range(800)]
    docs = documents(spark, texts)
    cells = mx.mixture(docs, {"source": {"src0": 0.4, "src1": 0.35, "(none)": 0.25}, "lang": 1.0},
                       budget=0.5).collect()
    by = Counter()
    for r in cells:
        by[r.source] += r.tokens * r.probability
    total = sum(by.values())
    assert abs(total / (800 * 40) - 0.5) < 0.01
    assert abs(by["src0"] / total - 0.4) < 0.01 and abs(by["(none)"] / total - 0.25) < 0.01


def test_mixed_gives_every_row_a_result(spark):
    docs = documents(spark, ODD_TEXTS * 2, topic="clash", probability="x", _p=1)
    rows = mx.mixed(docs).collect()
    assert len(rows) == len(ODD_TEXTS) * 2
    assert all(0 <= r.probability <= 1 and r.kept is not None for r in rows)
    assert all(r.kept and r.topic == "empty" for r in rows if r.n_tokens == 0)
    kept = {r.doc_id for r in rows if r.kept}
    sample = mx.sampled(docs)
    assert sample.columns == docs.columns and {r.doc_id for r in sample.collect()} == kept
    assert mx.mixed(documents(spark, [])).count() == 0
