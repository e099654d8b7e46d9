"""SentencePiece encoding and decoding through a table of distinct chunks.

A text is normalised as the model does it (a mark before it, marks for spaces) and cut before
every run of marks. Where no piece of the vocabulary crosses such a cut, neither a merge nor a
best path can, so the chunks (a marked word each) are segmented independently: the ids of a text
are those of its chunks in order. With a piece for every byte, a line feed or tab that no
other piece contains is a cut too.

A task keeps a table of the chunks that it has met, their ids in one flat array. Per Arrow batch,
the chunks that are new go to the tokenizer once, and the ids of all texts are joined back by
position: chunk numbers look up where their ids start and how many there are, and one gather
yields the ids of the batch. The table starts anew when its words and ids pass ``TABLE_BYTES``,
so memory follows that bound and the longest batch, never the number of distinct words.

The table belongs to a task, not to the whole run: joining every block's words to one table of
all words would shuffle about a fifth of all words twice and sort them, where segmenting a word
anew in another task costs microseconds. No row is shuffled here.

Decoding is the library's own on each row's ids.

Defined results: a null or empty text has no ids and decodes to an empty text; texts are read
whole; a literal mark counts as a space, as in the library; repeated rows give repeated results;
a null doc_id stays null and ids of any width stay exact; an empty table gives an empty result;
other columns are ignored. A model whose pieces cross the cuts, or that rewrites characters, is
refused with a ValueError.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm.common import ship_by_value, small_batches, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Bytes of words and ids that a task's table may hold before it starts anew.
TABLE_BYTES = 64 << 20
#: What a remembered word costs besides its characters and ids.
ENTRY_BYTES = 120

ENCODED = "doc_id long, ids array<int>"
DECODED = "doc_id long, text string"


def load(proto: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=proto)


def read_model(path: str) -> tuple[bytes, str]:
    """A model file's bytes, and the characters besides the mark that its texts may be cut at.

    Raises ValueError if the model's pieces could cross the cuts."""
    from sentencepiece import sentencepiece_model_pb2

    with open(path, "rb") as file:
        proto = file.read()
    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(proto)
    rules = model.normalizer_spec
    if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not (
        rules.add_dummy_prefix and rules.escape_whitespaces
    ):
        raise ValueError("the model rewrites characters or spaces: its texts can't be cut into marked words")
    if model.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError("the model marks the ends of words")
    tokenizer = load(proto)
    numbers = range(tokenizer.get_piece_size())
    special = [tokenizer.is_control(i) or tokenizer.is_unknown(i) or tokenizer.is_byte(i) for i in numbers]
    pieces = [tokenizer.id_to_piece(i) for i in numbers if not special[i]]
    if MARK not in pieces:
        raise ValueError("the mark is no piece of its own")
    crossing = [p for p in pieces if re.search(f"[^{MARK}]{MARK}", p)]
    if crossing:
        raise ValueError(f"pieces cross the marks between words: {crossing[:5]}")
    whole = sum(tokenizer.is_byte(i) for i in numbers) == 256
    return proto, "".join(c for c in "\n\t" if whole and not any(c in p for p in pieces))


def chunk_pattern(cuts: str) -> re.Pattern:
    """Marked words; with ``cuts``, those characters alone and what follows them up to a mark."""
    if not cuts:
        return re.compile(f"{MARK}+[^{MARK}]*")
    return re.compile(f"{MARK}+[^{MARK}{cuts}]*|[{cuts}]|[^{MARK}{cuts}]+")


class ChunkTable(dict):
    """Chunk -> its number. Looking up an unknown chunk enters it; ``segment`` gives it ids."""

    def __init__(self, tokenizer, cuts: str):
        super().__init__()
        self.tokenizer = tokenizer
        self.lead = cuts[:1]
        self.lead_ids = len(tokenizer.encode(self.lead)) if cuts else 0
        self.fresh: list[str] = []
        self.flat = np.zeros(0, dtype=np.int32)
        self.starts = np.zeros(1, dtype=np.int64)  # one more than there are chunks
        self.chars = 0

    def __missing__(self, chunk: str) -> int:
        number = self[chunk] = len(self)
        self.fresh.append(chunk)
        self.chars += len(chunk)
        return number

    def segment(self) -> None:
        """Segment the chunks entered since the last call, each once."""
        if not self.fresh:
            return
        # the tokenizer puts a mark before its input: it stands for a chunk's own first mark, or
        # for nothing before a cut character, whose ids are then left out
        skip = [0 if c[0] == MARK else self.lead_ids for c in self.fresh]
        asked = [c[1:] if c[0] == MARK else self.lead + c for c in self.fresh]
        marked = [i for i, a in enumerate(asked) if not a]
        found = self.tokenizer.encode(asked, num_threads=1)
        for i in marked:  # a lone mark: the tokenizer leaves an empty input without one
            found[i] = [self.tokenizer.piece_to_id(MARK)]
        found = [ids[s:] if s else ids for ids, s in zip(found, skip)]
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        new = np.fromiter((i for ids in found for i in ids), dtype=np.int32, count=int(sizes.sum()))
        self.starts = np.append(self.starts, self.starts[-1] + np.cumsum(sizes))
        self.flat = np.concatenate([self.flat, new])
        self.fresh = []

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the chunks in order, and where each chunk's ids end among them."""
        begin, sizes = self.starts[numbers], self.starts[numbers + 1] - self.starts[numbers]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(begin - (ends - sizes), sizes) + np.arange(total)], ends

    def bytes(self) -> int:
        return self.chars + 4 * len(self.flat) + ENTRY_BYTES * len(self)


def encoder(model, cuts: str, table_bytes: int):
    """A mapInArrow function from (doc_id, text) to (doc_id, ids)."""

    def encoded(batches):
        import pyarrow as pa

        tokenizer = load(model.value)
        find = chunk_pattern(cuts).findall
        known = ChunkTable(tokenizer, cuts)
        for batch in batches:
            if known.bytes() > table_bytes:
                known = ChunkTable(tokenizer, cuts)
            numbers: list[int] = []
            stops = [0]
            for text in batch.column(1).to_pylist():
                if text:
                    numbers += map(known.__getitem__, find(MARK + text.replace(" ", MARK)))
                stops.append(len(numbers))
            known.segment()
            ids, ends = known.gather(np.asarray(numbers, dtype=np.int64))
            offsets = np.append(0, ends)[np.asarray(stops)].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["doc_id", "ids"])

    return encoded


def decoder(model):
    """A mapInArrow function from (doc_id, ids) to (doc_id, text)."""

    def decoded(batches):
        import pyarrow as pa

        tokenizer = load(model.value)
        for batch in batches:
            ids = batch.column(1)
            flat = ids.flatten().to_numpy().tolist()
            stops = np.cumsum(ids.value_lengths().fill_null(0).to_numpy()).tolist()
            texts = [tokenizer.decode(flat[a:b]) for a, b in zip([0, *stops], stops)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return decoded


def encode_documents(docs: DataFrame, *, model: str = MODEL, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """(doc_id, ids) of every document. The model's file is of fixed size and is broadcast."""
    spark = docs.sparkSession
    proto, cuts = read_model(model)
    ship_by_value(__name__)
    small_batches(spark)
    shared = spark.sparkContext.broadcast(proto)
    narrow = docs.select(F.col("doc_id").cast("long"), "text")
    return narrow.mapInArrow(encoder(shared, cuts, table_bytes), ENCODED)


def decode_documents(encoded: DataFrame, *, model: str = MODEL) -> DataFrame:
    """(doc_id, text) from rows of (doc_id, ids)."""
    spark = encoded.sparkSession
    proto, _ = read_model(model)
    ship_by_value(__name__)
    small_batches(spark)
    shared = spark.sparkContext.broadcast(proto)
    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(decoder(shared), DECODED)


def round_trip(docs: DataFrame, *, model: str = MODEL, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """(doc_id, ids, text) of every document: its ids, and the text that they decode to."""
    spark = docs.sparkSession
    proto, cuts = read_model(model)
    ship_by_value(__name__)
    small_batches(spark)
    shared = spark.sparkContext.broadcast(proto)
    encode, decode = encoder(shared, cuts, table_bytes), decoder(shared)

    def both(batches):
        import pyarrow as pa

        for batch in encode(batches):
            (back,) = decode([batch])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, back.column(1)], names=["doc_id", "ids", "text"]
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(both, f"{ENCODED}, text string")


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of every document and of the text that they decode to."""
    both = round_trip(table(spark, sf_dir, "documents"))
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )


QUERIES = {"op11_sentencepiece": op11_sentencepiece}
ORACLES: dict[str, str] = {}
