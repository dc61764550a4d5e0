"""Typed answers out of raw text: no row is lost, every row says how it parsed.

``status`` is ``valid``; ``invalid`` (a JSON object that breaks the contract,
best-effort fields kept); ``unparsed`` (not JSON, kept in ``raw``); ``failed``
(JSON but no object, or an opinion whose specialty is there but is no text).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorate.functions.confidence import clamp, number_from_json, number_from_text
from quorate.functions.scale import computed_once

_TEXTS = ("ARRAY<STRING>", "ARRAY<VOID>")
_YES = ("true", "t", "yes", "y", "on", "1")
_NO = ("false", "f", "no", "n", "off", "0")
_MARK = "end of answer"


def _as(value: Column, as_type: str) -> Column:
    return F.try_variant_get(value, "$", as_type)


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def _is_number(kind: Column) -> Column:
    return kind.startswith("BIGINT") | kind.startswith("DOUBLE") | kind.startswith("DECIMAL")


@dataclass(frozen=True)
class Reader:
    """How a field is read: from its variant and its kind to the best-effort typed
    column, and from that, kind and variant to whether it keeps to its declared type.

    ``text`` is what both of them need prepared: a column of its own, so that it is
    made once.
    """

    value: Callable[[Column, Column, Column], Column]
    holds: Callable[[Column, Column, Column], Column]
    text: Callable[[Column, Column], Column] | None = None


_text = Reader(
    lambda field, kind, _: _as(field, "string"),
    lambda value, kind, field: kind == "STRING",
)

# Whole and decimal numbers as their JSON text: a cast inside a variant look-up is set up
# anew for every row.
_number = Reader(
    lambda field, kind, text: number_from_json(kind, text, _as(field, "double")),
    lambda value, kind, field: value.isNotNull(),
    lambda field, kind: F.when(kind == "STRING", _as(field, "string")).otherwise(
        F.to_json(field)),
)

_texts = Reader(
    lambda field, kind, _: _as(field, "array<string>"),
    lambda value, kind, field:
        kind.isin(*_TEXTS) & F.forall(value, lambda x: x.isNotNull()),
)

_flag = Reader(
    lambda field, kind, low:
        F.when(kind.isin("BOOLEAN", "STRING"),
               F.when(low.isin(*_YES), True).when(low.isin(*_NO), False))
        .when(_is_number(kind),
              F.when(low.try_cast("double") == 1, True)
              .when(low.try_cast("double") == 0, False)),
    lambda value, kind, field: value.isNotNull(),
    lambda field, kind: F.when(
        kind == "STRING", F.lower(F.trim(_as(field, "string")))).otherwise(F.to_json(field)),
)


def _all_texts(value: Column, kind: Column, field: Column) -> Column:
    lists = F.map_values(_as(field, "map<string,variant>"))
    all_texts = F.forall(lists, lambda v: F.coalesce(_kind(v).isin(*_TEXTS), F.lit(False)))
    no_nulls = F.forall(F.flatten(F.map_values(value)), lambda x: x.isNotNull())
    return kind.startswith("OBJECT") & all_texts & no_nulls


_texts_by_name = Reader(
    lambda field, kind, _: _as(field, "map<string,array<string>>"), _all_texts)


def _records(*names: str) -> Reader:
    shape = "array<struct<" + ",".join(f"{n}:string" for n in names) + ">>"

    def texts(item: Column) -> Column:
        return reduce(lambda a, b: a & b, [
            F.coalesce(_kind(F.try_variant_get(item, f"$.{n}", "variant")) == "STRING",
                       F.lit(False))
            for n in names
        ])

    return Reader(
        lambda field, kind, _: _as(field, shape),
        lambda value, kind, field:
            kind.startswith("ARRAY") & F.forall(_as(field, "array<variant>"), texts),
    )


CONTRACTS: dict[str, dict[str, Reader]] = {
    "triage": {
        "specialties": _records("name", "reason"),
        "lead_specialist": _text,
        "rationale": _text,
    },
    "opinion": {
        "specialty": _text,
        "findings": _text,
        "recommendation": _text,
        "evidence_quotes": _texts,
        "confidence": _number,
    },
    "judge": {
        "final_summary": _text,
        "key_findings_by_specialty": _texts_by_name,
        "consolidated_recommendations": _texts,
    },
    "safety": {
        "verified_findings": _texts,
        "flagged_issues": _records("specialist", "claim", "issue"),
        "final_summary": _text,
        "overall_confidence": _number,
        "is_safe": _flag,
    },
}


def closed_json(raw: Column) -> Column:
    """A text's JSON value as the first item of a list that ends in a mark.

    The variant parser stops after the first value; it comes to the mark only
    in a text that is one whole JSON value. Null for anything else. Prose is
    told by its first letter, which saves a parser exception per row.
    """
    may_be_json = raw.rlike(r'^[ \t\n\r]*[\[{"0-9tfn-]')
    closed = F.concat(F.lit("["), raw, F.lit(f',"{_MARK}"]'))
    return F.when(may_be_json, F.try_parse_json(closed))


def parse_responses(responses: DataFrame, contract: str) -> DataFrame:
    """Raw answers as typed rows with ``status`` and ``valid``; ``raw`` is kept.

    Each step is a projection of its own, so that it runs as compiled code and not
    inside a lambda or a generator. Only the parsed fields go through ``computed_once``:
    a filter on the status repeats a few look-ups, never the parsing, and fields that
    nobody reads are not typed.
    """
    readers = CONTRACTS[contract]
    shape = "struct<" + ",".join(f"{name}:variant" for name in readers) + ">"
    closed = F.try_variant_get("_whole", "$[1]", "string") == _MARK
    parsed = (
        responses.withColumn("_whole", closed_json(F.col("raw")))
        .withColumn("_is_json", F.coalesce(closed, F.lit(False)))
        .withColumn("_fields", F.when(
            F.col("_is_json"), F.try_variant_get("_whole", "$[0]", shape)))
    )
    once = computed_once(
        parsed, _json=F.col("_is_json"), _of=F.col("_fields"),
    ).drop("_whole", "_is_json", "_fields")

    is_json, fields = F.col("_json"), F.col("_of")

    def of(part: str, name: str) -> Column:
        return F.col(f"_{part}_{name}")

    kinds = once.withColumns({f"_kind_{name}": _kind(fields[name]) for name in readers})
    texts = kinds.withColumns({
        f"_text_{name}": reader.text(fields[name], of("kind", name))
        for name, reader in readers.items() if reader.text is not None})
    typed = texts.withColumns({
        f"_value_{name}": reader.value(fields[name], of("kind", name), of("text", name))
        for name, reader in readers.items()})
    failed = fields.isNull()
    if contract == "opinion":
        failed = failed | F.coalesce(of("kind", "specialty") != "STRING", F.lit(False))
    holds = reduce(lambda a, b: a & b, [
        F.coalesce(reader.holds(of("value", name), of("kind", name), fields[name]), F.lit(False))
        for name, reader in readers.items()])
    status = (
        F.when(~is_json, "unparsed").when(failed, "failed")
        .when(holds, "valid").otherwise("invalid")
    )
    extra = []
    if contract == "triage":
        absent = fields.isNotNull() & fields["lead_specialist"].isNull()
        extra.append(absent.alias("lead_absent"))
    return typed.select(
        *responses.columns, status.alias("status"), (is_json & holds).alias("valid"),
        *[of("value", name).alias(name) for name in readers], *extra,
    )


def backfill_lead(triage: DataFrame) -> DataFrame:
    """Where an answer names no lead at all, the first specialty leads.

    An explicit null stays null. A first specialty without a name fails the row.
    """
    first = F.try_element_at("specialties", F.lit(1))["name"]
    needed = F.col("lead_absent") & ~F.col("valid") & (
        F.coalesce(F.size("specialties"), F.lit(0)) > 0
    )
    status = F.when(needed & first.isNull(), "failed").otherwise(F.col("status"))
    return triage.withColumns({
        "lead_specialist": F.when(needed, first).otherwise(F.col("lead_specialist")),
        "status": status,
    }).drop("lead_absent")


def clean_confidence(opinions: DataFrame) -> DataFrame:
    """``confidence`` in [0, 1]; absent, null and non-numeric values become 0."""
    value = F.col("confidence")
    if opinions.schema["confidence"].dataType.typeName() == "string":
        value = number_from_text(value)
    return opinions.withColumn("confidence", clamp(value))


def answered_opinions(responses: DataFrame) -> DataFrame:
    """Raw answers as scorable opinions: invalid and unparsed ones still vote.

    Failed rows are left to the caller: they stay in ``parse_responses``.
    """
    parsed = parse_responses(responses, "opinion")
    return clean_confidence(parsed.where(F.col("status") != "failed"))
