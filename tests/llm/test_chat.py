from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from quorate.llm import chat as ch

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
PARTS = [*ch.CONTROLS, "\\", "\\\\", " ", "\n", "a", "é", "<", "[", "INST]", "s>", "/", "😀", ""]


def hostile(seed: int) -> str:
    draw = random.Random(seed)
    return "".join(draw.choice(PARTS) for _ in range(draw.randrange(12)))


def test_every_turn_survives_the_round_trip():
    for seed in range(3000):
        text, role = hostile(seed), ("user", "assistant", "system", "tool", hostile(seed + 9))[seed % 5]
        out, start, end = ch.rendered(role, text)
        assert [(r, t) for r, t, _, _ in ch.parsed(out)] == [(role, text)]
        assert ch.unescaped(out[start:end]) == text


def test_conversations_survive_the_round_trip():
    for seed in range(500):
        draw = random.Random(seed)
        turns = [(draw.choice(["user", "assistant", "system", "", "x y"]), hostile(seed * 31 + k))
                 for k in range(draw.randrange(7))]
        whole = "".join(ch.rendered(role, text)[0] for role, text in turns)
        assert [(r, t) for r, t, _, _ in ch.parsed(whole)] == turns


def test_only_conflicting_content_is_escaped():
    assert ch.rendered("user", "a \\ b < s >")[0] == "[INST] a \\ b < s > [/INST]\n"
    assert ch.rendered("user", "</s>")[0] == "[INST] \\</s> [/INST]\n"
    assert ch.rendered("user", "\\</s>")[0] == "[INST] \\\\</s> [/INST]\n"


def test_turns_rendered_together_equal_turns_rendered_alone():
    for seed in range(500):
        draw = random.Random(seed)
        turns = [(draw.choice(["user", "assistant", "system", "", hostile(seed)]),
                  draw.choice(["plain", hostile(seed * 31 + k)])) for k in range(draw.randrange(9))]
        assert ch.all_rendered(turns) == [ch.rendered(role, text) for role, text in turns]
    across = [("user", "a [/INST]\n<s> b"), ("assistant", "c"), ("user", "b </s>\n[INST] c")]
    assert ch.all_rendered(across) == [ch.rendered(role, text) for role, text in across]


def test_bare_controls_are_those_without_a_backslash_in_front():
    for seed in range(3000):
        text = hostile(seed)
        want = [(i, c) for i in range(len(text)) for c in ch.CONTROLS
                if text.startswith(c, i) and text[i - 1:i] != "\\"]
        assert [(m.start(), m.group()) for m in ch.BARE.finditer(text)] == want


def test_turns_are_rendered_once_and_cross_the_shuffle_as_they_are(spark):
    turns = spark.createDataFrame([(1, 0, "user", "x")], SCHEMA)
    plan = ch.format_chats(turns)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1
    assert plan.index("MapInArrow") < plan.index("RepartitionByExpression")


@pytest.mark.parametrize("broken", ["x", "[INST] a", "[INST] a [/INST]", "[INST]a[/INST]\n",
                                    "<s> a </s>\n</s>", "[INST] <s> [/INST]\n", "<<ROLE>> r <</ROLE>>\n"])
def test_the_parser_refuses_what_is_no_conversation(broken):
    with pytest.raises(ch.ParseError):
        ch.parsed(broken)


@pytest.mark.parametrize("piece", [1 << 20, 50])
def test_digests_against_brute_force(spark, monkeypatch, piece):
    monkeypatch.setattr(ch, "PIECE_CHARS", piece)
    draw = random.Random(7)
    rows = [(conv, turn, draw.choice(["user", "assistant", "system", None, "tool"]),
             draw.choice([None, hostile(conv * 50 + turn)]))
            for conv in range(15) for turn in range(draw.randrange(1, 9))]
    rows += [(500, turn, "user", f"turn {turn}") for turn in range(300)]
    rows += [(None, 1, "assistant", "x"), (None, None, "user", "y"), (7, 0, "user", "tie")] * 2
    shuffled = draw.sample(rows, len(rows))
    turns = spark.createDataFrame(shuffled, SCHEMA).repartition(5).withColumn("out", F.lit("clash"))
    got = {r.conv_id: r for r in ch.chat_digests(ch.format_chats(turns)).collect()}
    by: dict = {}
    nulls_first = [
        (r[0], (r[1] is not None, r[1] or 0), r[2] or "", r[3] or "") for r in rows
    ]
    for conv, turn, role, text in nulls_first:
        by.setdefault(conv, []).append((turn, role, text))
    assert got.keys() == by.keys()
    for conv, own in by.items():
        own.sort()
        loss = "".join(t for _, r, t in own if r == "assistant")
        whole = "".join(ch.rendered(r, t)[0] for _, r, t in own)
        row = got[conv]
        assert row.turns_sha256 == hashlib.sha256(
            "".join(f"{r}\n{t}\n" for _, r, t in own).encode()).hexdigest()
        assert (row.n_turns, row.formatted_chars) == (len(own), len(whole))
        assert (row.loss_chars, row.loss_sha256) == (
            len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert ch.format_chats(turns.limit(0)).count() == 0
