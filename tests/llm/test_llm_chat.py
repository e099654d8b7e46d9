from __future__ import annotations

import hashlib

from hypothesis import given
from hypothesis import strategies as st

from tillroll.llm import chat

BITS = ["<", "s", ">", "/", "\\", "[", "INST", "]", "|", "image", "ROLE", "\n", "é"]
TRICKY = st.lists(st.sampled_from(BITS), max_size=12).map("".join)


@given(TRICKY)
def test_escape_round_trip(text):
    escaped = chat.escape(text)
    assert chat.unescape(escaped) == text
    assert not chat.CONTROLS.search(escaped)


@given(st.sampled_from(["user", "assistant", "system", "", "[/ROLE]", "tool"]), TRICKY)
def test_turn_round_trip(role, text):
    formatted, start, end, attached = chat.format_turn(role, [{"kind": "text", "text": text}])
    assert chat.read_turn(formatted) == (role, text)
    assert chat.unescape(formatted[start:end]) == (text if role == "assistant" else "")
    assert attached == []


def test_parts_are_flattened_in_order(spark):
    part = lambda kind, **kw: {**dict.fromkeys(["text", "ref", "width", "height", "seconds", "pages"]), "kind": kind, **kw}
    parts = [
        part("text", text="see <|image|> "),
        part("image", ref="a.png", width=56, height=29),
        part("audio", ref="b.wav", seconds=1.5),
        part("document", ref="c.pdf", pages=3),
        part("hologram"),
        part(None, text="end"),
    ]
    messages = spark.createDataFrame([(1, 0, "assistant", None, parts)], f"conv_id long, turn long, role string, text string, parts array<{chat.PART}>")
    row = chat.format_turns(messages).first()
    assert row.formatted == "<s>see <\\|image|> <|image|><|audio|><|document|><|attachment|>end</s>"
    assert [(a.kind, a.ref, a.tokens) for a in row.attachments] == [
        ("image", "a.png", 4), ("audio", "b.wav", 38), ("document", "c.pdf", 3000), ("hologram", None, 1)
    ]
    assert [row.formatted[a.place :].split(">")[0] + ">" for a in row.attachments] == [
        "<|image|>", "<|audio|>", "<|document|>", "<|attachment|>"
    ]
    assert row.expanded_tokens == 3043


def test_read_back_digests(spark):
    rows = [
        (1, 1, "assistant", "b</s>", "x"),
        (1, 0, "user", None, "x"),
        (2, None, None, "first", "x"),
        (2, 0, "assistant", "one", "x"),
        (2, 0, "assistant", "one", "x"),
        (None, 5, "user", "lost", "x"),
    ]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(messages)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].turns_sha256 == sha("user\n\nassistant\nb</s>\n")
    assert (got[1].loss_chars, got[1].loss_sha256) == (5, sha("b</s>"))
    assert got[2].turns_sha256 == sha("\nfirst\nassistant\none\nassistant\none\n") and got[2].loss_sha256 == sha("oneone")
    assert got[None].n_turns == 1 and got[None].loss_sha256 == sha("")
    assert chat.read_back(chat.format_turns(messages.limit(0))).count() == 0


def test_wide_ids_beside_a_null(spark):
    rows = [(2**60 + 1, 2**60 + 1, "user", "a"), (2**60 + 2, None, "user", "b"), (None, 2**60 + 3, "user", "c")]
    formatted = chat.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert sorted(((r.conv_id, r.turn) for r in formatted.collect()), key=str) == sorted(((r[0], r[1]) for r in rows), key=str)
    assert {r.conv_id for r in chat.read_back(formatted).collect()} == {2**60 + 1, 2**60 + 2, None}
