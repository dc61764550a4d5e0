"""Reading confidences: what counts as a number, clamping, exact micro-units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DIGITS = r"[0-9]+(?:_[0-9]+)*"
NUMBER_TEXT = (
    rf"^[+-]?(?:{_DIGITS}\.?(?:{_DIGITS})?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?$"
)
# Panels up to this size keep every product of the outlier test inside a BIGINT.
SMALL_PANEL = 3000


def clamp(value: Column) -> Column:
    """Null becomes 0, everything else is held in [0, 1] (NaN gives 1)."""
    number = value.cast("double")
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(number, F.lit(0.0))))


def number_from_text(text: Column) -> Column:
    """A text as a double, null where it is no number.

    Accepts surrounding blanks, digit-group underscores and inf/nan, and
    rejects type suffixes such as ``0.8d`` that a plain cast would take.
    """
    bare = F.lower(F.trim(F.regexp_replace(text, r"[\t\n\r\f\x0b]", " ")))
    return (
        F.when(bare.rlike(NUMBER_TEXT), F.replace(bare, F.lit("_"), F.lit("")).try_cast("double"))
        .when(bare.rlike(r"^[+-]?inf(inity)?$"), bare.try_cast("double"))
        .when(bare.rlike(r"^[+-]?nan$"), F.lit(float("nan")))
    )


def number_from_json(kind: Column, text: Column, double: Column) -> Column:
    """A JSON value as a double, null where it is no number.

    ``kind`` is the value's JSON type as ``schema_of_variant`` names it, ``text`` the
    value as text and ``double`` as a double, asked for only where it is one: true and
    false count 1 and 0, strings are read as numbers; lists, objects, null and absent
    values are none.
    """
    return (
        F.when(kind == "BOOLEAN", F.when(text == "true", 1.0).otherwise(0.0))
        .when(kind == "STRING", number_from_text(text))
        .when(kind.startswith("DOUBLE"), double)
        .when(kind.startswith("BIGINT") | kind.startswith("DECIMAL"), text.try_cast("double"))
    )


def micro(confidence: Column) -> Column:
    """A confidence in [0, 1] as whole millionths."""
    return F.floor(confidence * F.lit(1e6) + F.lit(0.5))


def wide(number: Column) -> Column:
    return number.cast("decimal(38,0)")
