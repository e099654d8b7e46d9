"""Token counts under a unigram vocabulary, without producing the tokens.

Every word, with the word mark before it, goes through an Aho-Corasick automaton that enumerates
all vocabulary pieces in it, by end and longest first. Dynamic programming over the ends carries
the best score and the number of pieces on the way to it. Ties go as in the tokenizer: a
candidate replaces the best only if its score is strictly higher, and candidates for one end
come in the order of their starts. A character that is no piece of its own may be taken as
unknown, ten below the lowest score; with ``byte_fallback`` it is one token per UTF-8 byte, else
a run of unknown characters is one token. A vocabulary that has a piece for every byte is
counted with byte fallback.

Words are counted once per task and looked up afterwards, in a table of bounded size in bytes; long
words are not remembered.

Defined results: a null, empty or blank text has no words and no tokens; words are runs of
anything but the six ASCII white space characters; texts are read whole; repeated rows give
repeated results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm.common import beside_ids, ship_by_value, small_batches, table

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Bytes of words that a task remembers; beyond it the table starts anew.
REMEMBERED = 64 << 20
#: What a remembered word costs besides its bytes, and bytes of a word that is not remembered.
ENTRY_BYTES, LONG_WORD = 150, 256

RESULT = "doc_id long, n_words long, n_tokens long"


def read_vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece file, without control, unknown and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [
        (model.id_to_piece(i), model.get_score(i))
        for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
    ]


def has_byte_pieces(path: str) -> bool:
    """Whether a sentencepiece file has a piece for every byte, so that nothing is unknown."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return sum(model.is_byte(i) for i in range(model.get_piece_size())) == 256


class PieceCounter:
    """Counts the pieces of the best segmentation."""

    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool = False):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min((score for _, score in pieces), default=0.0) - UNKNOWN_PENALTY
        self.byte_fallback = byte_fallback

    def __call__(self, text: str) -> int:
        ends: list[list | None] = [None] * (len(text) + 1)
        for last, match in self.automaton.iter(text):
            if ends[last + 1] is None:
                ends[last + 1] = [match]
            else:
                ends[last + 1].append(match)
        score, pieces, unknown = [0.0], [0], [False]
        for end in range(1, len(text) + 1):
            best = start = None
            alone = False
            for length, own in ends[end] or ():
                candidate = own + score[end - length]
                if best is None or candidate > best:
                    best, start = candidate, end - length
                alone = alone or length == 1
            if not alone and (best is None or self.unknown + score[end - 1] > best):
                score.append(self.unknown + score[end - 1])
                if self.byte_fallback:
                    pieces.append(pieces[end - 1] + len(text[end - 1].encode()))
                else:
                    pieces.append(pieces[end - 1] + (not unknown[end - 1]))
                unknown.append(True)
            else:
                score.append(best)
                pieces.append(pieces[start] + 1)
                unknown.append(False)
        return pieces[-1]


def counter(vocabulary, byte_fallback: bool):
    """A mapInArrow function over (doc_id, text)."""

    def judge():
        pieces = PieceCounter(vocabulary.value, byte_fallback)
        known: dict[bytes, int] = {}
        held = 0

        def count(texts):
            nonlocal held
            out = []
            for text in texts:
                words = text.encode().split()  # bytes split at the six ASCII white space characters
                tokens = 0
                for word in words:
                    n = known.get(word)
                    if n is None:
                        n = pieces(MARK + word.decode())
                        if len(word) <= LONG_WORD:
                            held += len(word) + ENTRY_BYTES
                            if held > REMEMBERED:
                                known.clear()
                                held = len(word) + ENTRY_BYTES
                            known[word] = n
                    tokens += n
                out.append((len(words), tokens))
            return out

        return count

    return beside_ids(judge, RESULT)


def count_tokens(docs: DataFrame, *, vocabulary: str = VOCABULARY, byte_fallback: bool | None = None) -> DataFrame:
    """Words and tokens of every document. The vocabulary is of fixed size and is broadcast; it
    decides on ``byte_fallback`` unless the caller does."""
    spark = docs.sparkSession
    if byte_fallback is None:
        byte_fallback = has_byte_pieces(vocabulary)
    shared = spark.sparkContext.broadcast(read_vocabulary(vocabulary))
    ship_by_value(__name__)
    small_batches(spark)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(counter(shared, byte_fallback), RESULT)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and tokens of every document."""
    return count_tokens(table(spark, sf_dir, "documents"))


QUERIES = {"op4_token_counts": op4_token_counts}
ORACLES: dict[str, str] = {}
