"""Conversations as training text, proven by a round trip through a parser.

Turns are dealt out by (conversation, turn) ranges as they are read, so a very long
conversation is shared by several tasks. Every turn is then rendered between control
strings. A deterministic parser reads the result back; if it does not give the turn
again, the control strings in its content are escaped and it is rendered anew, until it
does. Turns are joined to pieces of about a million characters. A piece holds whole
turns of one conversation and can be parsed alone.

    system     <<SYS>> text <</SYS>>
    user       [INST] text [/INST]
    assistant  <s> text </s>
    others     <<ROLE>> name <</ROLE>> <s> text </s>

A backslash in front of a control string makes it content; a content that has
backslashes there gets one more, so escaping is undone by taking one away.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorate.llm.common import whole_text

CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<<ROLE>>", "<</ROLE>>")
FRAMES = {"system": ("<<SYS>> ", " <</SYS>>\n"), "user": ("[INST] ", " [/INST]\n"),
          "assistant": ("<s> ", " </s>\n")}
_ANY = "|".join(map(re.escape, CONTROLS))
CONTENT = re.compile(rf"(\\*)({_ANY})")
ESCAPED = re.compile(rf"\\(\\*(?:{_ANY}))")
# The look behind comes last: a search that starts with letters skips what cannot start one.
BARE = re.compile("|".join(rf"{c}(?<!\\{c})" for c in map(re.escape, CONTROLS)))
# A piece is closed once it has so many characters.
PIECE_CHARS = 1 << 20
# A null role is written under this name and recovered as it.
NO_ROLE = ""

PIECES = pa.schema([
    ("conv_id", pa.int64()), ("part", pa.int32()), ("piece", pa.int32()),
    ("formatted", pa.string()), ("mask", pa.list_(pa.list_(pa.int64()))),
])
DIGESTS = pa.schema([
    ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
    ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
])


def escaped(text: str) -> str:
    return CONTENT.sub(r"\\\1\2", text)


def unescaped(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def framed(role: str, text: str) -> tuple[str, int, int]:
    """A turn with content as it is: the string, and where its text starts and ends."""
    if role in FRAMES:
        before, after = FRAMES[role]
    else:
        before, after = f"<<ROLE>> {escaped(role)} <</ROLE>> <s> ", " </s>\n"
    return before + text + after, len(before), len(before) + len(text)


class ParseError(ValueError):
    """The text is not a sequence of turns."""


def parsed(rendered: str) -> list[tuple[str, str, int, int]]:
    """The turns of a rendered text: role, text, and where the text starts and ends."""
    turns, at = [], 0
    controls = [(m.start(), m.group()) for m in BARE.finditer(rendered)]
    k = 0

    def take(control: str, place: int | None) -> int:
        nonlocal k
        if k >= len(controls) or controls[k][1] != control:
            raise ParseError(f"{control} expected after character {at}")
        start = controls[k][0]
        if place is not None and start != place:
            raise ParseError(f"text outside of turns at character {at}")
        k += 1
        return start

    def between(opening: str, closing: str, after: str) -> tuple[str, int, int]:
        nonlocal at
        start = take(opening, at) + len(opening) + 1
        end = take(closing, None) - 1
        if end < start or rendered[start - 1] != " " or rendered[end] != " ":
            raise ParseError(f"no spaces around the content at character {start}")
        at = end + 1 + len(closing)
        if rendered[at : at + len(after)] != after:
            raise ParseError(f"a turn does not end at character {at}")
        at += len(after)
        return unescaped(rendered[start:end]), start, end

    while at < len(rendered):
        opening = controls[k][1] if k < len(controls) else ""
        if opening == "<<SYS>>":
            turns.append(("system", *between("<<SYS>>", "<</SYS>>", "\n")))
        elif opening == "[INST]":
            turns.append(("user", *between("[INST]", "[/INST]", "\n")))
        elif opening == "<s>":
            turns.append(("assistant", *between("<s>", "</s>", "\n")))
        elif opening == "<<ROLE>>":
            role = between("<<ROLE>>", "<</ROLE>>", " ")[0]
            turns.append((role, *between("<s>", "</s>", "\n")))
        else:
            raise ParseError(f"no turn starts at character {at}")
    return turns


def rendered(role: str, text: str) -> tuple[str, int, int]:
    """A turn whose parse gives the turn again, escaped only if it has to be."""
    content = text
    for _ in range(2):
        out, start, end = framed(role, content)
        try:
            turns = parsed(out)
        except ParseError:
            turns = []
        if [(r, t) for r, t, _, _ in turns] == [(role, text)]:
            return out, start, end
        content = escaped(text)
    raise ParseError(f"a turn of role {role!r} does not survive the round trip")


def all_rendered(turns: list[tuple[str, str]]) -> list[tuple[str, int, int]]:
    """``rendered`` of every (role, text), read back together where none is escaped.

    Turns that come back all the same each survive alone: a parse goes from left to
    right, so the first turn of a wrong end comes back as another one. Turns that do not
    are tried again in halves.
    """
    plain = [framed(role, text) for role, text in turns]
    try:
        back = parsed("".join(out for out, _, _ in plain))
    except ParseError:
        back = []
    if [(role, text) for role, text, _, _ in back] == turns:
        return plain
    if len(turns) == 1:
        return [rendered(*turns[0])]
    half = len(turns) // 2
    return all_rendered(turns[:half]) + all_rendered(turns[half:])


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), schema.types,
                                                        strict=True)],
        schema=schema,
    )


def format_chats(turns: DataFrame) -> DataFrame:
    """Conversations as pieces of rendered text with the spans that carry loss.

    Needs conv_id, turn, role and text; other columns are ignored. Rows of a
    conversation are ordered by turn, then role and text, nulls first, so ties and
    repeated rows have one order. A null text is empty, a null role the empty name;
    rows with null conv_id form one conversation. An empty table gives an empty result.

    Returns conv_id, part, piece, formatted, mask: pieces of a conversation follow each
    other by (part, piece); mask holds [start, end) of each assistant text within the
    piece, in characters, escapes included.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, number = TaskContext.get().partitionId(), 0
        parts: list[str] = []
        mask: list[list[int]] = []
        held, now, began = 0, None, False
        pieces: list[tuple] = []
        chars = 0

        for batch in batches:
            convs, roles, texts = (c.to_pylist() for c in batch.columns)
            made = all_rendered(list(zip(roles, texts, strict=True)))
            for conv, role, (out, first, last) in zip(convs, roles, made, strict=True):
                if began and (conv != now or held >= PIECE_CHARS):
                    pieces.append((now, at, number, "".join(parts), mask))
                    chars += held
                    parts, mask, held, number = [], [], 0, number + 1
                    # Short pieces go together, a batch each would cost more than they do.
                    if chars >= PIECE_CHARS:
                        yield _rows(pieces, PIECES)
                        pieces, chars = [], 0
                now, began = conv, True
                if role == "assistant":
                    mask.append([held + first, held + last])
                parts.append(out)
                held += len(out)
        if began:
            yield _rows([*pieces, (now, at, number, "".join(parts), mask)], PIECES)

    return (
        turns.select("conv_id", "turn", F.coalesce("role", F.lit(NO_ROLE)).alias("role"),
                     whole_text().alias("text"))
        .repartitionByRange("conv_id", "turn", "role")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
        .select("conv_id", "role", "text")
        .mapInArrow(join, "conv_id bigint, part int, piece int, formatted string, "
                          "mask array<array<bigint>>")
    )


def chat_digests(pieces: DataFrame) -> DataFrame:
    """What formatted conversations hold, recovered by the parser from their pieces.

    Returns conv_id, n_turns, turns_sha256 (role, newline, text, newline per turn),
    loss_chars and loss_sha256 (unescaped texts under the mask), formatted_chars. A
    conversation is read piece by piece, so memory does not grow with its length.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, began = None, False
        turns = loss = hashlib.sha256()
        n = loss_chars = chars = 0

        def row() -> tuple:
            return now, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars

        for batch in batches:
            done: list[tuple] = []
            for conv, text, mask in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not began or conv != now:
                    if began:
                        done.append(row())
                    now, began = conv, True
                    turns, loss = hashlib.sha256(), hashlib.sha256()
                    n = loss_chars = chars = 0
                for role, own, _, _ in parsed(text):
                    turns.update(f"{role}\n{own}\n".encode())
                    n += 1
                for start, end in mask:
                    own = unescaped(text[start:end])
                    loss.update(own.encode())
                    loss_chars += len(own)
                chars += len(text)
            if done:
                yield _rows(done, DIGESTS)
        if began:
            yield _rows([row()], DIGESTS)

    return (
        pieces.repartition("conv_id").sortWithinPartitions("conv_id", "part", "piece")
        .select("conv_id", "formatted", "mask")
        .mapInArrow(digest, "conv_id bigint, n_turns bigint, turns_sha256 string, "
                            "loss_chars bigint, loss_sha256 string, formatted_chars bigint")
    )
