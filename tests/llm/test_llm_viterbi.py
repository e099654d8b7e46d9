from __future__ import annotations

import random

from tokenizers import Regex, Tokenizer, models, pre_tokenizers

from tillroll.llm import viterbi


def reference(pieces, byte_fallback=False):
    vocabulary = [("<unk>", 0.0), *pieces]
    tokenizer = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=byte_fallback))
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence(
        [
            pre_tokenizers.Split(Regex(r"[\x20\x09-\x0D]+"), "removed"),
            pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=False),
        ]
    )
    return tokenizer


def test_small_vocabularies_with_ties_and_unknowns():
    rng = random.Random(5)
    for _ in range(40):
        alphabet = "▁abc"
        pieces = {"".join(rng.choice(alphabet) for _ in range(rng.randint(1, 4))) for _ in range(12)}
        scored = sorted((p, float(-rng.randint(1, 4))) for p in pieces)
        tokenizer = reference([("<unk>x", -20.0), *scored])
        count = viterbi.PieceCounter([("<unk>x", -20.0), *scored])
        for _ in range(40):
            word = "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 12)))
            assert count(viterbi.MARK + word) == len(tokenizer.encode(word).tokens), (scored, word)


def test_public_vocabulary_on_given_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    pieces = viterbi.read_vocabulary(viterbi.VOCABULARY)
    tokenizer = reference(pieces)
    got = {r.doc_id: (r.n_words, r.n_tokens) for r in viterbi.count_tokens(docs).collect()}
    for r in docs.select("doc_id", "text").collect():
        assert got[r.doc_id] == (len(r.text.encode().split()), len(tokenizer.encode(r.text).tokens))


def test_byte_fallback_counts_bytes():
    count = viterbi.PieceCounter([("▁a", -1.0), ("▁", -2.0)], byte_fallback=True)
    assert count("▁aé€") == 1 + 2 + 3
    assert viterbi.PieceCounter([("▁a", -1.0), ("▁", -2.0)])("▁aé€") == 2


def test_public_vocabulary_on_uncovered_scripts(make_docs):
    pieces = viterbi.read_vocabulary(viterbi.VOCABULARY)
    lowest = min(score for _, score in pieces)
    tokenizer = reference([*pieces, *((f"<0x{b:02X}>", lowest) for b in range(256))], byte_fallback=True)
    texts = ["\U00010348" * 1000, "ሰላም ለዓለም the ሰላምworld", "a\U0001f9ffb ߊߋ", "plain words"]
    got = {r.doc_id: r.n_tokens for r in viterbi.count_tokens(make_docs(list(enumerate(texts)))).collect()}
    assert got == {i: len(tokenizer.encode(t).tokens) for i, t in enumerate(texts)}
    assert got[0] == 4001


def test_edge_rows(make_docs):
    docs = make_docs([(1, None), (2, ""), (3, " \n"), (None, "the"), (4, "the"), (4, "the"), (5, "z" * 50_000)])
    got = sorted(((r.doc_id, r.n_words) for r in viterbi.count_tokens(docs).collect()), key=str)
    assert got == [(1, 0), (2, 0), (3, 0), (4, 1), (4, 1), (5, 1), (None, 1)]
    assert viterbi.count_tokens(docs.limit(0)).count() == 0


def test_wide_ids_beside_a_null(make_docs):
    docs = make_docs([(2**60 + 1, "a"), (2**60 + 2, "b c"), (None, "c")])
    got = sorted((r.doc_id or 0, r.n_words) for r in viterbi.count_tokens(docs).collect())
    assert got == [(0, 1), (2**60 + 1, 1), (2**60 + 2, 2)]


def test_remembered_words_are_bounded_in_bytes(make_docs, monkeypatch):
    texts = [f"w{i} " * 3 + "z" * 300 for i in range(300)]
    docs = make_docs(list(enumerate(texts)))
    whole = sorted(map(tuple, viterbi.count_tokens(docs).collect()))
    monkeypatch.setattr(viterbi, "REMEMBERED", 400)
    assert sorted(map(tuple, viterbi.count_tokens(docs).collect())) == whole
