from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from quorate.llm import token_counts as tc
from quorate.llm import token_files as tf
from quorate.llm.common import prepared, spaced_chunks
from quorate.session import scratch_path

from .helpers import ODD_TEXTS, documents, prose

tokenizers = pytest.importorskip("tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
vocabularies = pytest.importorskip("public_tokenizers")

PIECES = vocabularies.path("piece_bpe_32k.model")
WORDS = vocabularies.path("word_bpe_49k.json")


def test_chunks_join_to_the_text_and_cut_before_spaces():
    text = "ab  cd " * 50 + "x" * 500 + " y"
    chunks = list(spaced_chunks(text, 40))
    assert "".join(chunks) == text and len(chunks) > 5
    assert all(chunk[0] == " " for chunk in chunks[1:])
    assert list(spaced_chunks("")) == [""]


def test_counts_are_those_of_the_library(spark):
    prepared(spark)
    texts = ODD_TEXTS + [prose(k, 200) for k in range(20)] + [prose(1, 200)] * 3
    docs = documents(spark, texts, n_tokens=7, n_bytes="clash").repartition(3)
    got = {r.doc_id: r for r in tc.token_counts(docs, PIECES, limit=100).collect()}
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for k, text in enumerate(texts):
        n = len(model.encode(text or ""))
        assert (got[k].n_tokens, got[k].n_bytes) == (n, len((text or "").encode())), repr(text)
        assert got[k].over_limit == (n > 100)


def test_counts_do_not_depend_on_chunks_or_on_the_table(monkeypatch):
    monkeypatch.setattr(tc, "spaced_chunks", lambda text: spaced_chunks(text, 64))
    monkeypatch.setattr(tc, "CACHED", 50)
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    count = tc.text_counter(tc.word_lengths(model), {"the": 1})
    texts = [t or "" for t in ODD_TEXTS] + [prose(k, 300) + "   " + prose(k, 9) for k in range(9)]
    assert count(texts) == [len(ids) for ids in model.encode(texts)]


def test_counts_next_to_the_mark_for_a_space():
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    count = tc.text_counter(tc.word_lengths(model), {"the": 1})
    draw = random.Random(2)
    texts = ["▁", "▁ ", " ▁", "a▁ b", "▁▁  "]
    texts += ["".join(draw.choice("▁▁  ab\n.") for _ in range(draw.randint(1, 12)))
              for _ in range(3000)]
    assert count(texts) == [len(ids) for ids in model.encode(texts)]


def test_marks_after_every_letter_are_encoded_as_the_library_does():
    kind = tf.id_type(WORDS)
    encode = tf.text_encoder(WORDS, 2, kind)
    draw = random.Random(3)
    letters = [chr(c) for c in range(0x30000) if chr(c).isalpha()]
    words = [letter + "." for letter in letters]
    words += ["".join(draw.choice(letters + ["İ"] * 20000) for _ in range(draw.randint(1, 4)))
              + draw.choice(["!", "...", ",", "|*", "?!"]) for _ in range(20_000)]
    words += ["DENİ.", "MİLLİ!", "İ."]
    library = tokenizers.Tokenizer.from_file(WORDS)
    want = [e.ids for e in library.encode_batch_fast(words, add_special_tokens=False)]
    got = [np.frombuffer(ids, kind)[:-1].tolist() for ids in encode(words)]
    assert [w for w, a, b in zip(words, want, got, strict=True) if a != b] == []


def test_counts_of_an_empty_table(spark):
    assert tc.token_counts(documents(spark, []), PIECES).count() == 0


def test_token_files_round_trip(spark):
    prepared(spark)
    texts = ODD_TEXTS + [prose(k, 100) for k in range(60)]
    ids = [None, 7, 7, *range(100, 100 + len(texts) - 3)]
    docs = documents(spark, texts, ids, start=1, frame="clash").repartition(5)
    path = scratch_path(spark, "tokens")
    tf.write_token_files(docs, WORDS, 2, path)
    got = tf.read_token_files(spark, path).orderBy("start").collect()
    tokenizer = tokenizers.Tokenizer.from_file(WORDS)
    coded = {}
    for i, text in zip(ids, texts, strict=True):
        own = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        coded.setdefault(i, []).append(own)
    assert [r.doc_id for r in got] == sorted(ids, key=lambda i: -1 if i is None else i)
    start = 0
    for row in got:
        assert row.ids in coded[row.doc_id]
        coded[row.doc_id].remove(row.ids)
        assert (row.start, row.n_tokens) == (start, len(row.ids))
        assert row.ids_crc32 == zlib.crc32(np.array(row.ids, "<u4").tobytes())
        start += len(row.ids)


def test_token_files_check_their_dictionary(spark):
    path = scratch_path(spark, "tokens")
    tf.write_token_files(documents(spark, [prose(k, 80) for k in range(300)]), WORDS, 2, path)
    first = spark.read.parquet(f"{path}/dictionary").first()
    assert len(first.bytes) > 0 and first.id_bytes == 2
    spark.createDataFrame([("0" * 64, 2, first.bytes)],
                          "sha256 string, id_bytes int, bytes binary").write.mode(
        "overwrite").parquet(f"{path}/dictionary")
    with pytest.raises(ValueError, match="hash"):
        tf.read_token_files(spark, path)


def test_token_files_of_an_empty_table(spark):
    path = scratch_path(spark, "tokens")
    tf.write_token_files(documents(spark, []), WORDS, 2, path)
    assert tf.read_token_files(spark, path).count() == 0


def test_words_encoded_together_equal_words_encoded_alone():
    kind = tf.id_type(WORDS)
    tokenizer = tokenizers.Tokenizer.from_file(WORDS)
    words = ["Hello", "straße", "don't", "x1", "ſ", "é", "日本", *prose(3, 700).split(), "İ", "A."]
    alone = [np.array(tokenizer.encode(w, add_special_tokens=False).ids, kind).tobytes()
             for w in words]
    assert tf.word_encoder(WORDS, kind)(words) == alone
    assert tf.text_encoder(WORDS, 2, kind)([" ".join(words)]) == [b"".join(alone) + b"\x02\x00"]
