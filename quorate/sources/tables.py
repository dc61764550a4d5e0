"""Readers and writers with declared schemas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.readwriter import DataFrameReader
from pyspark.sql.streaming.readwriter import DataStreamReader

from quorate import fixed_values as fixed
from quorate import schemas

FORMATS = ("json", "parquet", "orc")


def _load(reader: DataFrameReader | DataStreamReader, path: str, fmt: str,
          schema: str) -> DataFrame:
    if fmt not in FORMATS:
        raise ValueError(f"format {fmt!r} is none of {', '.join(FORMATS)}")
    return reader.schema(schema).format(fmt).load(path)


def read_cases(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Cases from JSON lines, parquet or orc; nothing is inferred."""
    return _load(spark.read, path, fmt, schemas.CASES)


def read_responses(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Raw answers, one text per case and agent, left unparsed."""
    return _load(spark.read, path, fmt, schemas.RESPONSES)


def read_events(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    return _load(spark.read, path, fmt, schemas.EVENTS)


def _cells(line: Column) -> Column:
    return F.transform(F.split(F.trim(line), r"\|"), lambda c: F.trim(c))


def parse_indicator_map(lines: DataFrame, names: Sequence[str]) -> DataFrame:
    """A piped text table as rows ``specialty, indicator, lead_potential``.

    ``names`` are the cells of its heading line. Heading and rule lines are
    dropped, bold marks and the final full stop stripped, cells cut at commas;
    ``X (Y)`` among the indicators gives both X and Y.
    """
    names = list(names)
    rows = lines.where(F.trim("value").startswith("|")).select(_cells(F.col("value")).alias("c"))
    indicators = next(n for n in names if n.startswith("Key Indicators"))

    def cell(name: str) -> Column:
        return F.get("c", F.lit(names.index(name)))

    specialty = cell("Specialty")
    item = F.trim(F.col("item"))
    with_synonym = r"^(.*?)\s*\((.*)\)$"
    both = F.when(
        item.rlike(with_synonym),
        F.array(F.regexp_extract(item, with_synonym, 1), F.regexp_extract(item, with_synonym, 2)),
    ).otherwise(F.array(item))
    return (
        rows.where((F.size("c") == len(names)) & (specialty != "Specialty"))
        .where(~specialty.rlike(r"^[:\- ]*$"))
        .select(
            F.replace(specialty, F.lit("**"), F.lit("")).alias("specialty"),
            F.explode(F.split(F.regexp_replace(cell(indicators), r"\.$", ""), ","))
            .alias("item"),
            cell("Lead Potential").alias("lead_potential"),
        )
        .select("specialty", F.explode(both).alias("indicator"), "lead_potential")
        .where(F.col("indicator") != "")
    )


def read_indicator_map(spark: SparkSession, path: str) -> DataFrame:
    """The specialist map from a text file; its heading line names the columns."""
    lines = spark.read.text(path)
    heading = (
        lines.select(_cells(F.col("value")).alias("c"))
        .where(F.array_contains("c", "Specialty")).first()
    )
    if heading is None:
        raise ValueError("no heading line with a Specialty column")
    return parse_indicator_map(lines, heading["c"])


def indicator_map_from_text(spark: SparkSession, text: str) -> DataFrame:
    """The specialist map from a table held in memory, heading first."""
    heading = [cell.strip() for cell in text.split("\n", 1)[0].split("|")]
    lines = F.explode(F.split(F.lit(text), "\n")).alias("value")
    return parse_indicator_map(spark.range(1).select(lines), heading)


def default_indicator_map(spark: SparkSession) -> DataFrame:
    return indicator_map_from_text(spark, fixed.INDICATOR_MAP)


def write_bucketed(cases: DataFrame, table: str, buckets: int, path: str | None = None) -> DataFrame:
    """Keep a case table bucketed by case, and return it.

    Joins with teams and claims then leave the texts where they are: only the
    small side is shuffled to the buckets.
    """
    writer = cases.write.bucketBy(buckets, "case_id").sortBy("case_id").format("parquet")
    if path is not None:
        writer = writer.option("path", path)
    writer.saveAsTable(table)
    return cases.sparkSession.table(table)


def write_assessments(assessments: DataFrame, path: str, fmt: str = "parquet",
                      partition_by: tuple[str, ...] = (), mode: str = "errorifexists") -> None:
    """Assessments as nested rows, or as one JSON text per case (``json_text``)."""
    if fmt == "json_text":
        partition = [F.col(c) for c in partition_by]
        others = [c for c in assessments.columns if c not in ("case_id", *partition_by)]
        assessments = assessments.select(
            "case_id", *partition, F.to_json(F.struct(*others)).alias("assessment")
        )
        fmt = "parquet"
    elif fmt not in FORMATS:
        raise ValueError(f"format {fmt!r} is none of {', '.join(FORMATS)}, json_text")
    assessments.write.mode(mode).format(fmt).partitionBy(*partition_by).save(path)
