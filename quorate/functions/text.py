"""Column helpers for text: folding, words, n-grams, sentences, facts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quorate.fixed_values import SPECIALIST_PREFIX

WORD = r"[\p{L}\p{N}]+"
GAP = r"[^\p{L}\p{N}]+"
BLANKS = r"[ \t\n\r\f]+"
SENTENCE_END = r"[.!?][ \t\n\r\f]|\n"
# A word, an optional ':' / '=' / 'is' / 'of', then a number: "eGFR 45", "dose: 2.5".
FACT = r"(\p{L}[\p{L}\p{N}]*)[ \t\n\r\f]*(?:[:=]|[ \t\n\r\f]is[ \t\n\r\f]|[ \t\n\r\f]of[ \t\n\r\f]|[ \t\n\r\f])[ \t\n\r\f]*([0-9]+(?:\.[0-9]+)?)"

# Everything a browser's trim() removes.
_JS_BLANK = (
    "\t\n\x0b\x0c\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
)


def fold(text: Column) -> Column:
    """Lower-case, blanks collapsed to one space, ends trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), BLANKS, " "))


def trim_all(text: Column) -> Column:
    """Trim every kind of blank, not only the space character."""
    return F.regexp_replace(text, f"^[{_JS_BLANK}]+|[{_JS_BLANK}]+$", "")


def words(text: Column) -> Column:
    """Maximal runs of letters and digits, lower-cased, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def word_line(text: Column) -> Column:
    """The words of a text joined by single spaces."""
    return F.array_join(words(text), " ")


def edged_line(text: Column) -> Column:
    """The words of a text with one space before, between and behind them."""
    return F.regexp_replace(F.concat(F.lit(" "), F.lower(text), F.lit(" ")), GAP, " ")


def ngrams(tokens: Column, n: int) -> Column:
    """All runs of ``n`` neighbouring tokens, joined by a space.

    Tokens are taken one by one: a slice copies the whole array every time.
    """
    if n == 1:
        return tokens
    last = F.size(tokens) - (n - 1)
    runs = F.transform(
        F.sequence(F.lit(0), last - 1),
        lambda i: F.concat_ws(" ", *[F.get(tokens, i + k) for k in range(n)]),
    )
    return F.when(last >= 1, runs).otherwise(F.array().cast("array<string>"))


def run_hashes(tokens: Column, n: int) -> Column:
    """One 64-bit hash per run of ``n`` neighbouring tokens, without joining them."""
    last = F.size(tokens) - (n - 1)
    runs = F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice(tokens, i, n)))
    return F.when(last >= 1, runs).otherwise(F.array().cast("array<bigint>"))


def sentences(text: Column) -> Column:
    """Trimmed non-empty pieces between sentence ends or line breaks."""
    pieces = F.transform(F.split(text, SENTENCE_END), lambda s: F.trim(s))
    return F.filter(pieces, lambda s: s != "")


def facts(text: Column) -> Column:
    """Attribute/number pairs stated in a text, as an array of structs.

    Texts without a digit skip the search; the rest is searched once, and only
    the short matches are taken apart.
    """
    low = F.lower(text)
    found = F.when(low.rlike("[0-9]"), F.regexp_extract_all(low, F.lit(FACT), F.lit(0))).otherwise(
        F.array().cast("array<string>")
    )
    return F.array_distinct(F.transform(found, lambda m: F.struct(
        F.regexp_extract(m, FACT, 1).alias("attribute"),
        F.regexp_extract(m, FACT, 2).alias("value"),
    )))


def agent_key(specialty: Column) -> Column:
    """The agent name of a specialty on the sending side (spaces only)."""
    return F.concat(F.lit(SPECIALIST_PREFIX), F.replace(F.lower(specialty), F.lit(" "), F.lit("_")))


def card_key(specialty: Column) -> Column:
    """The key the receiving side gives a specialty (every blank replaced)."""
    return F.concat(
        F.lit(SPECIALIST_PREFIX), F.regexp_replace(F.lower(specialty), f"[{_JS_BLANK}]", "_")
    )
