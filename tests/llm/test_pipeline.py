from __future__ import annotations

import pytest

import corpus_pipeline as cp
from quorate.llm import oracle, queries
from quorate.llm import simhash as sh
from quorate.session import scratch_path

from .helpers import ODD_TEXTS, documents, prose
from .test_selection import brute_overlaps
from .test_shingles import survivors

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark):
    """A small data folder with planted copies, leaks, insults and odd rows."""
    items = [prose(900 + k, 30) for k in range(5)]
    texts = [*ODD_TEXTS, *(prose(k, 60) for k in range(200))]
    texts += [f"{t} snotwad" for t in texts[100:160]]
    texts += [f"{prose(k, 20)} {item}" for k, item in enumerate(items)]
    texts += [prose(5, 60)] * 10
    # One word more: alike at 0.8.
    texts += [prose(k, 60) + " " + prose(k + 500, 1) for k in range(20, 24)]
    path = scratch_path(spark, "folder")
    documents(spark, texts, extra="kept").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string").write.parquet(
        f"{path}/benchmark.parquet")
    spark.createDataFrame(
        [(k, 1, int("snotwad" in (t or ""))) for k, t in enumerate(texts) if k % 2],
        "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, texts, items


def test_stages_against_brute_force(spark, folder):
    path, texts, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in cp.STAGES[:-1]:
        out = scratch_path(spark, name)
        stage(spark, docs, path).write.parquet(out)
        docs = spark.read.parquet(out)
        assert docs.columns == columns, name
        kept[name] = sorted(r.doc_id for r in docs.select("doc_id").collect())
    clean = [k for k, t in enumerate(texts) if "snotwad" not in (t or "")]
    assert kept["toxicity"] == clean
    single = [clean[i] for i in survivors([texts[k] for k in clean])]
    assert kept["simhash_near_dedup"] == single
    leaks = {d for d, _ in brute_overlaps([texts[k] or "" for k in single], items)}
    assert kept["decontamination"] == [k for i, k in enumerate(single) if i not in leaks]
    assert len(leaks) == len(items)
    assert set(kept["mixing"]) <= set(kept["decontamination"])
    assert len(kept["mixing"]) > len(single) * 0.6
    tokens = cp.STAGES[-1][1](spark, docs, path).orderBy("start").collect()
    assert [r.doc_id for r in tokens] == kept["mixing"]
    assert [r.start for r in tokens] == [
        sum(t.n_tokens for t in tokens[:k]) for k in range(len(tokens))]
    again = cp.run(spark, path).orderBy("start").collect()
    assert [tuple(r) for r in again] == [tuple(r) for r in tokens]


def test_stages_on_an_empty_table(spark, folder):
    path = folder[0]
    docs = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for name, stage in cp.STAGES:
        assert stage(spark, docs, path).count() == 0, name


def test_stage_names_are_their_operators():
    assert [name for name, _ in cp.STAGES] == [
        "toxicity", "simhash_near_dedup", "decontamination", "mixing", "token_output"]
    assert sh.THRESHOLD == 4


@pytest.mark.parametrize("name", sorted(oracle.ORACLE))
def test_queries_against_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    got = queries.registered()[name](spark, SMALL).toPandas()
    con = duckdb.connect()
    for table in ("documents", "labels", "benchmark", "conversations", "embeddings"):
        con.sql(f"create view {table} as select * from '{SMALL}/{table}.parquet'")
    want = con.sql(oracle.ORACLE[name]).df()
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns

    def plain(frame):
        return frame[columns].astype(str).sort_values(columns).reset_index(drop=True)

    assert plain(got).equals(plain(want))
