"""What the training-data operators share: session settings, tables, texts."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quorate.session import configure, stored

# Python workers get whole texts, so a batch is bounded by rows and by bytes.
BATCH_SETTINGS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 * 1024 * 1024),
}


def prepared(spark: SparkSession) -> SparkSession:
    """Apply the settings these operators rely on to a live session."""
    configure(spark)
    for key, value in BATCH_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder, by any path Spark can read."""
    return prepared(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(name: str = "text") -> Column:
    """The text column with null as the empty text."""
    return F.coalesce(F.col(name), F.lit(""))


def spaced_chunks(text: str, size: int = 1 << 20) -> Iterator[str]:
    """Cut a long text in front of a run of spaces, so a chunk stays near ``size``.

    Joined, the chunks are the text again. A run without spaces is never cut.
    """
    start = 0
    while len(text) - start > size:
        cut = text.find(" ", start + size)
        while cut > start and text[cut - 1] == " ":
            cut -= 1
        if cut <= start:
            break
        yield text[start:cut]
        start = cut
    yield text[start:]


def bounded(cache: dict, limit: int, seed: dict) -> dict:
    """The cache itself, or a fresh copy of its seed once it has outgrown ``limit``."""
    return cache if len(cache) <= limit else dict(seed)


def long_keys(keys: Iterable[str], most: int = 64) -> list[str]:
    """Keys too long to be worth a place in a cache."""
    return [key for key in keys if len(key) > most]


def numbered(docs: DataFrame) -> DataFrame:
    """Every row as ``_doc``, with its text and a number of its own in place of doc_id.

    The rows are stored once with their numbers, so a later scan, also one that a lost
    executor causes, finds the same ones. Decisions on numbers are decisions on rows,
    whatever ids are null or repeated.
    """
    rows = stored(docs.select(
        F.monotonically_increasing_id().alias("doc_id"),
        F.struct(*docs.columns).alias("_doc"),
    ), "numbered-rows")
    return rows.select("doc_id", F.col("_doc.text").alias("text"), "_doc")


def with_row(docs: DataFrame, *columns: str) -> DataFrame:
    """Some columns, and the whole row as ``_doc``, so no name in it can clash."""
    return docs.select(*columns, F.struct(*docs.columns).alias("_doc"))
