from __future__ import annotations

import hashlib
import random

import pytest
import sentencepiece

from tillroll.llm import pieces

TRICKY = " ▁\n\t\r\x0b\x0c\0 　�é́ﬁ１ab.,'\"<s>0129𐍈中ሰ"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def test_ids_and_texts_are_the_librarys(make_docs, library):
    rng = random.Random(3)
    words = ["the", "Reitern", "naïve", "  ", "\n\n", "</s>", "<0x0A>", "▁▁", "i18n", "http://a.b/c?d=e"]
    texts = ["".join(rng.choice(TRICKY) for _ in range(rng.randint(0, 30))) for _ in range(300)]
    texts += [" ".join(rng.choice(words) for _ in range(rng.randint(1, 40))) for _ in range(100)]
    texts += ["", " ", "  ", "\n", "▁", " \n ", "\n\na", "x" * 30_000, "a " * 20_000, "\n" * 500]
    docs = make_docs(list(enumerate(texts)))
    encoded = pieces.encode_documents(docs)
    assert {r.doc_id: list(r.ids) for r in encoded.collect()} == dict(enumerate(library.encode(texts)))
    back = {r.doc_id: r.text for r in pieces.decode_documents(encoded).collect()}
    assert back == {i: library.decode(library.encode(t)) for i, t in enumerate(texts)}


def test_query_against_the_library_on_given_texts(spark, library):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: tuple(r)[1:] for r in pieces.op11_sentencepiece(spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for doc_id, text in rows:
        ids = library.encode(text or "")
        assert got[doc_id] == (len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids)))


def test_each_distinct_word_is_segmented_once_and_the_table_is_bounded(library):
    class Counting:
        asked: list = []

        def encode(self, texts, **options):
            if isinstance(texts, list):
                self.asked += texts
            return library.encode(texts, **options)

        piece_to_id = staticmethod(library.piece_to_id)

    known = pieces.ChunkTable(Counting(), "\n\t")
    find = pieces.chunk_pattern("\n\t").findall
    for text in ["a rose is a rose", "is a rose\nis a rose"]:
        numbers = [known[c] for c in find("▁" + text.replace(" ", "▁"))]
        known.segment()
    assert sorted(Counting.asked) == ["\n\n", "\nis", "a", "is", "rose"]
    assert len(numbers) == 7 and known.bytes() > 0


def test_a_table_that_starts_anew_changes_nothing(make_docs, library):
    texts = [f"word{i} and some more {i % 7}" for i in range(2000)]
    got = pieces.encode_documents(make_docs(list(enumerate(texts))), table_bytes=1)
    assert {r.doc_id: list(r.ids) for r in got.collect()} == dict(enumerate(library.encode(texts)))


def test_models_that_cross_marks_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(pieces.MODEL, "rb") as file:
        model.ParseFromString(file.read())
    model.pieces[500].piece = "of▁the"
    crossing = tmp_path / "crossing.model"
    crossing.write_bytes(model.SerializeToString())
    with pytest.raises(ValueError, match="cross"):
        pieces.read_model(str(crossing))
    model.pieces[500].piece = "ofthe"
    model.normalizer_spec.remove_extra_whitespaces = True
    squeezing = tmp_path / "squeezing.model"
    squeezing.write_bytes(model.SerializeToString())
    with pytest.raises(ValueError, match="spaces"):
        pieces.read_model(str(squeezing))


def test_edge_rows(make_docs, library):
    wide = 2**60 + 1
    docs = make_docs([(1, None), (2, ""), (None, "the"), (wide, "the"), (wide + 1, "the"), (4, "x y"), (4, "x y")])
    rows = pieces.round_trip(docs).collect()
    got = sorted(((r.doc_id, tuple(r.ids), r.text) for r in rows), key=str)
    the, xy = tuple(library.encode("the")), tuple(library.encode("x y"))
    expected = [(1, (), ""), (2, (), ""), (None, the, "the"), (wide, the, "the"), (wide + 1, the, "the")]
    assert got == sorted([*expected, (4, xy, "x y"), (4, xy, "x y")], key=str)
    assert pieces.round_trip(docs.limit(0)).count() == 0
