"""Secret scan: three base patterns, and spans whose tokens are too short for language.

The method is a token-efficiency test: a run of token-like characters is encoded with a
byte-level BPE vocabulary (tiktoken); language and identifiers take many characters a token,
random strings few. Runs under ``ratio`` characters a token are reported as kind ``random``,
unless they are a known digest (hex of a digest's length), a UUID, a decimal number, an
identifier, or touch a base span. An identifier consists of plain words and short numbers between
``- _ / = +``; a word is plain in lower, upper or capital case, and in camel case if its parts have
``CAMEL_LETTERS`` letters on average (random letters of both cases have about two).

Every test is linear in the run: a run is split at its separators, and each part is judged by a
pattern that reads it in one way only.

Defined results: a null or empty text has no span; texts are scanned whole; repeated rows give
repeated results; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm.common import beside_ids, ship_by_value, small_batches, table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fewer characters a token than this is taken for random.
RATIO = 2.0
LEAST_CHARS = 20
#: Digits of a number within an identifier, and letters that the parts of a camel-case word have
#: on average.
NUMBER_DIGITS, CAMEL_LETTERS = 8, 3
KINDS = ("assign", "access", "hex", "random")

# The base patterns, and the word splitting of the public vocabulary.
ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST_CHARS)
DIGEST = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)\Z")
DIGEST_CHARS = {32, 40, 48, 56, 64, 96, 128}
UUID = re.compile(r"[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}\Z")
SEPARATOR = re.compile(r"[-_/=+]")
CAMEL = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

RESULT = "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the three base kinds, leftmost and not overlapping within a kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return found


def is_plain(part: str) -> bool:
    """A word or short number, as identifiers are made of."""
    if part.isdigit():
        return len(part) <= NUMBER_DIGITS
    if not part or not part.isalpha():
        return not part
    cased = part[1:]
    if not cased or cased.islower() or part.isupper():
        return True
    return len(part) >= CAMEL_LETTERS * len(CAMEL.findall(part))


def is_known(run: str) -> bool:
    """A digest, UUID, number or identifier rather than a secret."""
    if run.isdigit() or (len(run) in DIGEST_CHARS and DIGEST.match(run)) or UUID.match(run):
        return True
    return all(map(is_plain, SEPARATOR.split(run)))


def random_spans(text: str, base: list[tuple[int, int, int]], encode, ratio: float) -> list[tuple[int, int, int]]:
    """Runs with too few characters a token, outside the base spans."""
    found = []
    spans = sorted((s, e) for s, _, e in base)
    at = reach = 0  # base spans that start before the run's end, and how far they go
    for m in RUN.finditer(text):
        run, start, end = m[0], m.start(), m.end()
        while at < len(spans) and spans[at][0] < end:
            reach = max(reach, spans[at][1])
            at += 1
        if reach > start or is_known(run):
            continue
        if len(run) < ratio * len(encode(run)):
            found.append((start, 3, end))
    return found


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def encoder(vocabulary: bytes):
    """The encode function of a tiktoken vocabulary given as the bytes of its file."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("scan", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def scanner(vocabulary, ratio: float):
    """A mapInArrow function; the vocabulary (a broadcast) is opened at the first run to judge."""

    def judge():
        known = []

        def encode(run: str):
            if not known:
                known.append(encoder(vocabulary.value))
            return known[0](run)

        def row(text: str) -> tuple:
            base = base_spans(text)
            more = random_spans(text, base, encode, ratio)
            n = [sum(k == kind for _, k, _ in base) for kind in range(3)]
            return (*n, len(more), hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + more))

        return lambda texts: list(map(row, texts))

    return beside_ids(judge, RESULT)


def find_secrets(docs: DataFrame, *, vocabulary: str = VOCABULARY, ratio: float = RATIO) -> DataFrame:
    """Per document: counts by kind, a digest of the base spans, and all spans.

    ``vocabulary`` is a tiktoken file the driver can read; a vocabulary is of fixed size (under
    64 MB is checked), so it is broadcast."""
    spark = docs.sparkSession
    if os.path.getsize(vocabulary) > 64 << 20:
        raise ValueError(f"{vocabulary} is too large for a vocabulary")
    with open(vocabulary, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())
    ship_by_value(__name__)
    small_batches(spark)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scanner(shared, ratio), RESULT)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in the whole text of every document."""
    return find_secrets(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"
    )


QUERIES = {"op10_secrets": op10_secrets}
ORACLES: dict[str, str] = {}
