"""Chat formatting of typed content parts.

A visitor flattens the parts of each turn in order: text is escaped and copied, an image, audio
or document part becomes one placeholder, and its reference, place and expanded token count are
recorded. The template marks every turn, and control strings that a text contains are escaped
reversibly: backslashes are doubled, and a backslash goes after the first character of every
control string, so none survives inside a text and unescaping restores it exactly.

    user       <s>[INST]text[/INST]</s>
    assistant  <s>text</s>
    any other  <s>[ROLE]role[/ROLE]text</s>

The loss mask of a turn is the code point range of an assistant's text (empty for others).

Turns are formatted row by row. Reading back sorts turns by conversation and streams over them
with running digests, so that a conversation of any length needs constant memory.

Defined results: a null text is empty; a null role is the empty role; null conversation ids form
one conversation; a null turn comes first; turns of one number are ordered by role, then text;
repeated rows are repeated turns; an empty table gives an empty result; a part of unknown kind or
without a reference is an attachment all the same (reference null); other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tillroll.llm.common import ship_by_value, small_batches, table

# The template's control strings.
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
OTHER_PLACEHOLDER = "<|attachment|>"
CONTROL = (
    "<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]", *PLACEHOLDERS.values(), OTHER_PLACEHOLDER
)
CONTROLS = re.compile("|".join(map(re.escape, CONTROL)))
TURN = re.compile(r"<s>(?:\[INST\](?P<user>.*?)\[/INST\]|\[ROLE\](?P<role>.*?)\[/ROLE\](?P<other>.*?)|(?P<assistant>.*?))</s>", re.S)

#: Token counts that a placeholder expands to.
IMAGE_PATCH = 28
AUDIO_TOKENS_PER_S = 25
DOCUMENT_TOKENS_PER_PAGE = 1000

PART = "struct<kind: string, text: string, ref: string, width: int, height: int, seconds: double, pages: int>"
FORMATTED = (
    "conv_id long, turn long, role string, formatted string, loss_from long, loss_to long, "
    "attachments array<struct<kind: string, ref: string, place: long, tokens: long>>, expanded_tokens long"
)
DIGEST = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
    "formatted_chars long, n_attachments long, expanded_tokens long"
)


def escape(text: str) -> str:
    return CONTROLS.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


class PartVisitor:
    """Flattens the parts of one turn; ``out`` is the escaped text, ``attachments`` what it refers to."""

    def __init__(self, start: int):
        self.out: list[str] = []
        self.place = start
        self.attachments: list[dict] = []

    def visit(self, part: dict) -> None:
        kind = part.get("kind") or "text"
        getattr(self, f"visit_{kind}", self.visit_other)(part)

    def add(self, text: str) -> None:
        self.out.append(text)
        self.place += len(text)

    def attach(self, part: dict, placeholder: str, tokens: float) -> None:
        entry = {"kind": part.get("kind"), "ref": part.get("ref"), "place": self.place, "tokens": int(tokens)}
        self.attachments.append(entry)
        self.add(placeholder)

    def visit_text(self, part: dict) -> None:
        self.add(escape(part.get("text") or ""))

    def visit_image(self, part: dict) -> None:
        across, down = (math.ceil((part.get(side) or 0) / IMAGE_PATCH) for side in ("width", "height"))
        self.attach(part, PLACEHOLDERS["image"], max(1, across * down))

    def visit_audio(self, part: dict) -> None:
        self.attach(part, PLACEHOLDERS["audio"], max(1, math.ceil((part.get("seconds") or 0) * AUDIO_TOKENS_PER_S)))

    def visit_document(self, part: dict) -> None:
        self.attach(part, PLACEHOLDERS["document"], max(1, part.get("pages") or 0) * DOCUMENT_TOKENS_PER_PAGE)

    def visit_other(self, part: dict) -> None:
        self.attach(part, OTHER_PLACEHOLDER, 1)


def format_turn(role: str, parts: list[dict]) -> tuple[str, int, int, list[dict]]:
    """The formatted turn, the code point range of its loss mask, and its attachments."""
    if role == "user":
        before, after = "<s>[INST]", "[/INST]</s>"
    elif role == "assistant":
        before, after = "<s>", "</s>"
    else:
        before, after = f"<s>[ROLE]{escape(role)}[/ROLE]", "</s>"
    visitor = PartVisitor(len(before))
    for part in parts:
        visitor.visit(part)
    loss = (len(before), visitor.place) if role == "assistant" else (0, 0)
    return "".join([before, *visitor.out, after]), *loss, visitor.attachments


def read_turn(formatted: str) -> tuple[str, str]:
    """Role and flattened text of a formatted turn."""
    m = TURN.fullmatch(formatted)
    if m["user"] is not None:
        return "user", unescape(m["user"])
    if m["role"] is not None:
        return unescape(m["role"]), unescape(m["other"])
    return "assistant", unescape(m["assistant"])


def _formatter(kinds: list):
    """mapInArrow from (conv_id, turn, role, parts); ids and turns pass as Arrow has them. ``kinds``
    are the Arrow types of the columns after them."""

    def formatted_batches(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for role, parts in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                role = role or ""
                formatted, start, end, attached = format_turn(role, [p for p in parts if p is not None])
                out.append((role, formatted, start, end, attached, sum(a["tokens"] for a in attached)))
            columns = list(zip(*out)) or [()] * len(kinds)
            arrays = [pa.array(values, type=kind) for values, kind in zip(columns, kinds)]
            names = ["conv_id", "turn", "role", "formatted", "loss_from", "loss_to", "attachments", "expanded_tokens"]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *arrays], names=names)

    return formatted_batches


def format_turns(messages: DataFrame) -> DataFrame:
    """Each turn formatted, with its loss mask and attachments.

    ``messages`` has conv_id, turn, role and text, or in place of (or beside) text a column
    ``parts``: an array of PART. Where parts is null the text is the only part."""
    spark = messages.sparkSession
    ship_by_value(__name__)
    small_batches(spark)
    text_part = F.array(
        F.struct(
            F.lit("text").alias("kind"),
            (F.col("text") if "text" in messages.columns else F.lit(None).cast("string")).alias("text"),
            F.lit(None).cast("string").alias("ref"),
            F.lit(None).cast("int").alias("width"),
            F.lit(None).cast("int").alias("height"),
            F.lit(None).cast("double").alias("seconds"),
            F.lit(None).cast("int").alias("pages"),
        )
    )
    parts = F.coalesce(F.col("parts").cast(f"array<{PART}>"), text_part) if "parts" in messages.columns else text_part
    given = messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", parts.alias("parts"))
    kinds = [to_arrow_type(f.dataType) for f in T.StructType.fromDDL(FORMATTED).fields[2:]]
    return given.mapInArrow(_formatter(kinds), FORMATTED)


class FormattedTurn(NamedTuple):
    conv_id: int | None
    turn: int | None
    role: str
    formatted: str
    loss_from: int
    loss_to: int
    expanded_tokens: int
    n_attachments: int


def _read_batches(batches):
    import pyarrow as pa

    columns = [c.split()[0] for c in DIGEST.split(", ")]
    kinds = [pa.string() if c.split()[1] == "string" else pa.int64() for c in DIGEST.split(", ")]
    current = None  # [conv_id, turns, turns digest, loss chars, loss digest, formatted chars, attachments, tokens]

    def row(c):
        return (c[0], c[1], c[2].hexdigest(), c[3], c[4].hexdigest(), *c[5:])

    def frame(rows):
        arrays = [pa.array(values, type=kind) for values, kind in zip(zip(*rows), kinds)]
        return pa.RecordBatch.from_arrays(arrays, names=columns)

    for batch in batches:
        done = []
        for values in zip(*(column.to_pylist() for column in batch.columns)):
            r = FormattedTurn(*values)
            conv = r.conv_id
            if current is None or current[0] != conv:
                if current is not None:
                    done.append(row(current))
                current = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
            role, text = read_turn(r.formatted)
            current[1] += 1
            current[2].update(f"{role}\n{text}\n".encode())
            loss = unescape(r.formatted[r.loss_from : r.loss_to])
            current[3] += len(loss)
            current[4].update(loss.encode())
            current[5] += len(r.formatted)
            current[6] += r.n_attachments
            current[7] += r.expanded_tokens
        if done:
            yield frame(done)
    if current is not None:
        yield frame([row(current)])


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, digests of what the formatted turns read back to.

    One conversation is one sequential digest, hence one task's stream, in constant memory."""
    ordered = (
        formatted.select(
            "conv_id", "turn", "role", "formatted", "loss_from", "loss_to", "expanded_tokens",
            F.size("attachments").alias("n_attachments"),
        )
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "formatted")
    )
    return ordered.mapInArrow(_read_batches, DIGEST)


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations formatted, and conversation -1 of control strings, read back to digests."""
    tricky = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame(
        [(-1, 0, "user", tricky), (-1, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string"
    )
    messages = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return read_back(format_turns(messages)).select(
        "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"
    )


# the template written as SQL: texts here hold no attachments
_SQL_TEXT = "coalesce(text, '')"
_SQL_ROLE = "coalesce(role, '')"
_CONTROL_SQL = r"([<\[])((/?s>)|(/?INST\])|(/?ROLE\])|(\|(image|audio|document|attachment)\|>))"
ORACLE = rf"""
WITH m AS (
  SELECT conv_id, turn, {_SQL_ROLE} AS role, {_SQL_TEXT} AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
f AS (
  SELECT *, length(text) + length(text) - length(replace(text, '\', ''))
            + len(regexp_extract_all(text, '{_CONTROL_SQL}'))
            + CASE role WHEN 'user' THEN 20 WHEN 'assistant' THEN 7 ELSE 20 + length(role) END AS chars
  FROM m)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM f GROUP BY conv_id
"""

QUERIES = {"op8_chat": op8_chat}
ORACLES = {"op8_chat": ORACLE}
