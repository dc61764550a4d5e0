"""Token ids in a binary format made for reading single documents.

A data set is a folder of three Parquet tables, so any store Spark can write will do
and Spark's commit protocol covers lost and repeated tasks:

- ``dictionary``: one row with a zstandard dictionary trained on serialized id arrays,
  its SHA-256 and the width of an id in bytes;
- ``packs``: rows of about half a megabyte in ascending doc_id order. A pack holds a
  blob of frames, one compressed frame per document, the offsets of the frames, the
  ids and token counts of the documents, and the hash of the dictionary they need;
- ``starts``: the number of ids before each pack.

A document is its pack's blob between two offsets, so a short one costs one small
read and the shared dictionary makes up for the little there is to learn from.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quorate.llm.common import bounded, long_keys, spaced_chunks, whole_text
from quorate.session import stored

# The dictionary is trained on at most so many documents of at most so many ids.
SAMPLE_DOCS, SAMPLE_IDS, DICTIONARY_BYTES = 2_000, 4_096, 65_536
LEVEL = 3
PACK_BYTES, PACK_DOCS = 512 * 1024, 4_096
CACHED = 300_000
# Words encoded in one string, their tokens told apart by the end-of-word mark.
JOINED = 500
ENDED = re.compile(r"([^\W\d_]+)([.,!?*%#$&|]+)")


def stays_letters(run: str) -> bool:
    """Whether a run of letters is still one after lower-casing and composition.

    A few letters become a letter and a mark, which would join the marks that follow.
    """
    return run.isascii() or (
        unicodedata.normalize("NFC", run).lower().isalpha()
        and unicodedata.normalize("NFC", run.lower()).isalpha()
    )


PACKS = ("shard int, pack int, dictionary_sha256 string, doc_ids array<bigint>, "
         "n_tokens array<bigint>, offsets array<bigint>, tokens bigint, blob binary")


# --- encoding ------------------------------------------------------------------------

def id_type(tokenizer_path: str) -> np.dtype:
    """Two bytes an id where the vocabulary allows it, else four; little-endian."""
    from tokenizers import Tokenizer

    size = Tokenizer.from_file(tokenizer_path).get_vocab_size()
    return np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")


def word_encoder(tokenizer_path: str, kind: np.dtype) -> Callable[[list[str]], list[bytes]]:
    """Words to serialized ids, exactly as the library encodes them alone.

    Plain Latin words are encoded many at a time: each becomes one pre-token, whose
    last id is the only one with an end-of-word mark.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path)
    ends = {i for word, i in tokenizer.get_vocab().items() if word.endswith("</w>")}

    def coded(ids: list[int]) -> bytes:
        return np.array(ids, dtype=kind).tobytes()

    def one_by_one(words: list[str]) -> list[bytes]:
        found = tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return [coded(each.ids) for each in found]

    def joined(words: list[str]) -> list[bytes]:
        ids = tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids
        last = [i + 1 for i, token in enumerate(ids) if token in ends]
        if len(last) != len(words) or last[-1] != len(ids):
            return one_by_one(words)
        whole, width = coded(ids), kind.itemsize
        return [whole[a * width : b * width] for a, b in zip([0, *last[:-1]], last, strict=True)]

    def encode(words: list[str]) -> list[bytes]:
        plain = [w.isalpha() and max(w) < "ɐ" for w in words] if ends else [False] * len(words)
        easy = [w for w, p in zip(words, plain, strict=True) if p]
        hard = [w for w, p in zip(words, plain, strict=True) if not p]
        fast = [c for k in range(0, len(easy), JOINED) for c in joined(easy[k : k + JOINED])]
        slow = one_by_one(hard) if hard else []
        fast_left, slow_left = iter(fast), iter(slow)
        return [next(fast_left) if p else next(slow_left) for p in plain]

    return encode


def text_encoder(tokenizer_path: str, end_id: int, kind: np.dtype) -> Callable[[list[str]], list[bytes]]:
    """Texts to serialized ids with the end id, keeping the words it has encoded.

    The tokenizer drops white space and no pre-token crosses it, so a text's ids are
    those of its words in a row.
    """
    encode = word_encoder(tokenizer_path, kind)
    known: dict[str, bytes] = {"": b""}
    end = np.array([end_id], dtype=kind).tobytes()

    def learn(words: list[str]) -> None:
        split = {w: m.groups() for w in words
                 if (m := ENDED.fullmatch(w)) and stays_letters(m[1])}
        atoms = {part for parts in split.values() for part in parts}
        atoms.update(w for w in words if w not in split)
        new = [w for w in atoms if w not in known]
        known.update(zip(new, encode(new), strict=True))
        known.update({w: known[a] + known[b] for w, (a, b) in split.items()})

    def texts_to_ids(texts: list[str]) -> list[bytes]:
        nonlocal known
        known = bounded(known, CACHED, {"": b""})
        out = []
        for text in texts:
            parts = []
            for chunk in spaced_chunks(text):
                words = chunk.replace("\n", " ").split(" ")
                missed = [w for w in set(words) if w not in known]
                if missed:
                    learn(missed)
                parts.append(b"".join(map(known.__getitem__, words)))
                for key in long_keys(missed):
                    del known[key]
            out.append(b"".join([*parts, end]))
        return out

    return texts_to_ids


def trained_dictionary(docs: DataFrame, tokenizer_path: str, end_id: int, kind: np.dtype) -> bytes:
    """A zstandard dictionary from a bounded sample of the documents' id arrays.

    The sample is drawn by a hash of the id: at most SAMPLE_DOCS documents, of which
    those up to SAMPLE_IDS ids count. Too small a sample gives no dictionary.
    """
    picked = (
        docs.where("doc_id is not null").select("doc_id").distinct()
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS)
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts_to_ids = text_encoder(tokenizer_path, end_id, kind)
        for batch in batches:
            coded = texts_to_ids(batch.column(1).to_pylist())
            short = [len(c) <= SAMPLE_IDS * kind.itemsize for c in coded]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(pa.array(short)),
                 pa.array([c for c, s in zip(coded, short, strict=True) if s], pa.binary())],
                names=["doc_id", "ids"],
            )

    rows = (
        docs.select("doc_id", whole_text().alias("text")).join(F.broadcast(picked), "doc_id")
        .mapInArrow(encode, "doc_id bigint, ids binary").orderBy("doc_id", "ids")
        .limit(SAMPLE_DOCS).collect()
    )
    try:
        return zstandard.train_dictionary(
            DICTIONARY_BYTES, [bytes(row.ids) for row in rows]
        ).as_bytes()
    except zstandard.ZstdError:
        return b""


# --- writing -------------------------------------------------------------------------

def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=known)


def _decompressor(dictionary: bytes) -> zstandard.ZstdDecompressor:
    known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdDecompressor(dict_data=known)


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int, path: str) -> None:
    """Encode every whole text, append the end id, and write the folder at ``path``.

    Needs ``doc_id`` and ``text``; other columns are ignored. Null and empty texts are
    the end id alone; null ids come first; rows that repeat an id stand side by side,
    ordered by their ids' checksum. An empty table gives an empty data set.
    """
    spark = docs.sparkSession
    kind = id_type(tokenizer_path)
    dictionary = trained_dictionary(docs, tokenizer_path, end_id, kind)
    sha = hashlib.sha256(dictionary).hexdigest()
    shared = spark.sparkContext.broadcast(dictionary)

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts_to_ids = text_encoder(tokenizer_path, end_id, kind)
        compress = _compressor(shared.value).compress
        for batch in batches:
            coded = texts_to_ids(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0),
                 pa.array([len(c) // kind.itemsize for c in coded], pa.int64()),
                 pa.array([zlib.crc32(c) for c in coded], pa.int64()),
                 pa.array([compress(c) for c in coded], pa.binary())],
                names=["doc_id", "n", "crc", "frame"],
            )

    def packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number = TaskContext.get().partitionId(), 0
        ids: list[int | None] = []
        counts: list[int] = []
        blob: list[bytes] = []
        held = 0

        def pack() -> pa.RecordBatch:
            offsets = np.cumsum([0, *map(len, blob)]).tolist()
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([number], pa.int32()), pa.array([sha]),
                 pa.array([ids], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int64())),
                 pa.array([offsets], pa.list_(pa.int64())), pa.array([sum(counts)], pa.int64()),
                 pa.array([b"".join(blob)], pa.binary())],
                names=["shard", "pack", "dictionary_sha256", "doc_ids", "n_tokens", "offsets",
                       "tokens", "blob"],
            )

        for batch in batches:
            for doc, n, frame in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                ids.append(doc)
                counts.append(n)
                blob.append(frame)
                held += len(frame)
                if held >= PACK_BYTES or len(ids) >= PACK_DOCS:
                    yield pack()
                    ids, counts, blob, held, number = [], [], [], 0, number + 1
        if ids:
            yield pack()

    spark.createDataFrame(
        [(sha, kind.itemsize, bytearray(dictionary))], "sha256 string, id_bytes int, bytes binary"
    ).coalesce(1).write.parquet(f"{path}/dictionary")
    # Written before the range shuffle, which reads its input twice.
    coded = stored(
        docs.select("doc_id", whole_text().alias("text"))
        .mapInArrow(frames, "doc_id bigint, n bigint, crc bigint, frame binary"),
        "frames",
    )
    (
        coded.repartitionByRange("doc_id", "crc").sortWithinPartitions("doc_id", "crc", "frame")
        .select("doc_id", "n", "frame").mapInArrow(packs, PACKS)
        .write.option("compression", "none").parquet(f"{path}/packs")
    )
    sizes = spark.read.schema(PACKS).parquet(f"{path}/packs").select("shard", "pack", "tokens")
    # One row a shard in one task, then the packs of each shard on their own.
    before = (
        Window.partitionBy(F.lit(0)).orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    )
    shards = sizes.groupBy("shard").agg(F.sum("tokens").alias("n")).select(
        "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")
    )
    inside = Window.partitionBy("shard").orderBy("pack").rowsBetween(Window.unboundedPreceding, -1)
    sizes.join(shards, "shard").select(
        "shard", "pack",
        (F.col("first") + F.coalesce(F.sum("tokens").over(inside), F.lit(0))).alias("start"),
    ).write.parquet(f"{path}/starts")


# --- reading -------------------------------------------------------------------------

def read_token_files(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Every document of a data set: doc_id, start, n_tokens, ids_crc32 and its ids.

    ``start`` counts the ids of all documents before it; the checksum is taken over the
    ids as little-endian 32-bit integers. A frame whose dictionary is not the one in
    the folder, or whose length is not the recorded one, raises an error.
    """
    named = spark.read.schema("sha256 string, id_bytes int, bytes binary").parquet(
        f"{path}/dictionary"
    ).first()
    sha, kind = named.sha256, np.dtype(f"<u{named.id_bytes}")
    shared = spark.sparkContext.broadcast(bytes(named.bytes))
    if hashlib.sha256(shared.value).hexdigest() != sha:
        raise ValueError(f"the dictionary in {path} does not match its hash")
    wide = np.dtype("<u4")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decompress = _decompressor(shared.value).decompress
        for batch in batches:
            for first, own, docs, counts, offsets, blob in zip(
                *(batch.column(i).to_pylist() for i in range(6)), strict=True
            ):
                if own != sha:
                    raise ValueError(f"a pack needs dictionary {own}, the folder has {sha}")
                arrays = [
                    np.frombuffer(decompress(blob[a:b]), dtype=kind).astype(wide)
                    for a, b in zip(offsets[:-1], offsets[1:], strict=True)
                ]
                if [len(ids) for ids in arrays] != counts:
                    raise ValueError("a frame does not have the recorded number of ids")
                starts = first + np.cumsum([0, *counts[:-1]])
                columns = [
                    pa.array(docs, pa.int64()), pa.array(starts, pa.int64()),
                    pa.array(counts, pa.int64()),
                    pa.array([zlib.crc32(ids.tobytes()) for ids in arrays], pa.int64()),
                ]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array([ids.astype(np.int32) for ids in arrays],
                                            pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    packs = spark.read.schema(PACKS).parquet(f"{path}/packs")
    starts = spark.read.schema("shard int, pack int, start bigint").parquet(f"{path}/starts")
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    return (
        packs.join(starts, ["shard", "pack"])
        .select("start", "dictionary_sha256", "doc_ids", "n_tokens", "offsets", "blob")
        .mapInArrow(decode, schema + (", ids array<int>" if with_ids else ""))
    )
