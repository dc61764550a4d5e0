from __future__ import annotations

import random

import numpy as np
import pytest

import corpus_pipeline as cp
from quorate.llm import shingles as sg
from quorate.llm import simhash as sh

from .helpers import ODD_TEXTS, documents, prose


def plain_set(text: str | None) -> frozenset:
    found = (text or "").encode().lower().split()
    if not found:
        return frozenset()
    return frozenset(tuple(found[k:k + 5]) for k in range(max(1, len(found) - 4)))


def survivors(texts: list[str | None]) -> list[int]:
    """The first document of each component, by all pairs."""
    sets = [plain_set(t) for t in texts]
    root = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return [k for k, r in enumerate(root) if r == k]


def edited(seed: int, changes: int) -> str:
    found = prose(seed, 300).split()
    for k in range(changes):
        found[20 * k + 7] = f"changed{seed}x{k}"
    return " ".join(found)


@pytest.fixture(scope="module")
def texts():
    out = [*ODD_TEXTS, *(prose(k, 300) for k in range(12))]
    # Up to five shingles a change: similarity 0.97 down to 0.60.
    out += [edited(k, changes) for k in range(12) for changes in (k, k + 1)]
    # Copies of one text that are alike through it rather than among themselves.
    base = prose(77, 200).split()
    draw = random.Random(3)
    for k in range(40):
        copy = list(base)
        for j in draw.sample(range(0, 200, 7), 3):
            copy[j] = f"other{k}x{j}"
        out.append(" ".join(copy))
    return [*out, " ".join(base), *["same text here"] * 5, "SAME\ttext  here"]


def test_stage_drops_all_pairs_at_four_fifths(spark, texts):
    docs = documents(spark, texts, key=1, band="x", root=2).repartition(4)
    kept = cp.drop_near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    got = sorted(r.doc_id for r in kept.select("doc_id").collect())
    assert got == survivors(texts)
    # What four bits of SimHash leave is more: the stage used to keep these.
    assert set(got) < {r.doc_id for r in sh.one_of_each(docs).select("doc_id").collect()}


def test_stage_goes_by_simhash_as_well(spark):
    """Close fingerprints over shingle sets that are less than 0.8 alike."""
    words = prose(5, 41).split()
    base = words * 100
    other = base + prose(6, 20).split()
    texts = [" ".join(base), " ".join(other), prose(7, 100)]
    one, two = plain_set(texts[0]), plain_set(texts[1])
    assert 5 * len(one & two) < 4 * len(one | two)
    assert (sh.fingerprint(texts[0]) ^ sh.fingerprint(texts[1])).bit_count() <= sh.THRESHOLD
    kept = cp.drop_near_duplicates(spark, documents(spark, texts), "")
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == [0, 2]


def test_ids_and_empty_tables(spark):
    texts = ["a b", "a b", "a b", "other words here", None, "", "c d", "c d", "e f", "e f", "g h"]
    docs = documents(spark, texts, [3, 1, None, 9, 4, 5, None, None, 6, 6, 3], doc="x", _doc=1)
    kept = sg.one_of_similar(docs)
    assert kept.columns == docs.columns
    # Of each text one row stays, with or without an id, whatever other rows share the id.
    assert sorted(((r.doc_id or 0), r.text or "") for r in kept.collect()) == [
        (0, "c d"), (1, "a b"), (3, "g h"), (4, ""), (6, "e f"), (9, "other words here")]
    assert sg.one_of_similar(documents(spark, [])).count() == 0


def test_bands_of_long_sets_do_not_depend_on_the_chunk(monkeypatch):
    found = sg.shingle_set(np.arange(20_000, dtype=np.uint64))
    whole = sg.bands(found)
    monkeypatch.setattr(sg, "CHUNK", 7_777)
    assert len(found) == 19_996 and (sg.bands(found) == whole).all()
