"""The pipeline's stages against brute force, each on its own input."""

from __future__ import annotations

import sys
from collections import defaultdict
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from test_llm_decontaminate import shingles  # noqa: E402
from test_llm_ngram_join import brute as near_groups  # noqa: E402
from test_llm_repetition import brute as repeats  # noqa: E402

from tillroll.llm import mixing, repetition  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    tables = [docs.collect()]
    for _, stage in corpus_pipeline.STAGES:
        given = spark.createDataFrame(tables[-1], docs.schema)
        tables.append(stage(spark, given, SF).collect())
    return tables


def test_quality_stage(stages):
    kept = []
    for r in stages[0]:
        n = len(r.text.encode().split())
        windows, covered, longest = repeats(r.text) if n < 400 else repetition.judge([r.text], repetition._rules(repetition.LEAST_WORDS, repetition.MAX_COVERED, repetition.MAX_REPEAT))[0][4:7]
        if n >= 10 and 5 * windows <= n and covered <= repetition.MAX_COVERED * n and longest <= repetition.MAX_REPEAT:
            kept.append(r)
    assert sorted(stages[1]) == sorted(kept)


def test_near_duplicate_stage(stages):
    groups = near_groups([(r.doc_id, r.text) for r in stages[1]])
    assert sorted(stages[2]) == sorted(r for r in stages[1] if groups[r.doc_id][1] == r.doc_id)


def test_decontamination_stage(spark, stages):
    items = [shingles(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = [r for r in stages[2] if all(len(i & shingles(r.text)) < 0.6 * len(i) for i in items if i)]
    assert sorted(stages[3]) == sorted(clean) and len(clean) < len(stages[2])


def test_mixing_stage(spark, stages):
    docs = spark.createDataFrame(stages[3])
    copies = {r.doc_id: r.copies for r in mixing.mix_sources(docs).collect()}
    assert sorted(stages[4]) == sorted(r for r in stages[3] for _ in range(copies[r.doc_id]))


def test_sharding_stage(stages):
    assert sorted(r.doc_id for r in stages[5]) == sorted(r.doc_id for r in stages[4])
    slots = defaultdict(list)
    for r in stages[5]:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_run_is_the_stages_in_turn(spark, stages):
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted(map(str, got)) == sorted(map(str, stages[-1]))


def test_stages_on_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, mix_copies int, gone_id long"
    clean = " ".join(f"w{i}" for i in range(30))
    rows = [
        (1, clean, "x", "a", 1, 9, 9),
        (1, clean, "x", "a", 1, 9, 9),
        (None, clean, None, None, None, None, None),
        (2, None, "x", "a", 1, 1, 1),
        (3, "", "x", "a", 1, 1, 1),
    ]
    docs = spark.createDataFrame(rows, schema)
    for given in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, given, SF)
            assert out.columns == docs.columns, name
            out.collect()
        corpus_pipeline.sharding(spark, given, SF).collect()
    assert corpus_pipeline.near_duplicates(spark, docs, SF).filter("doc_id = 1").count() == 1


def prose(name, n=40):
    return " ".join(f"{name}{i}" for i in range(n))


def test_one_doc_id_with_several_texts(spark):
    """A decision about one text of a doc_id leaves the others alone, in every stage."""
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    a, b, c, d = map(prose, "abcd")
    rows = [(3, a), (5, a), (5, b), (9, b + " end"), (6, c), (6, c), (6, d), (None, d), (None, prose("e")), (None, prose("e"))]
    rows += [(7, f"{prose('f')} {item} {prose('g')}"), (7, prose("h")), (None, f"{item} {prose('i')}"), (8, None), (8, None), (8, "")]
    docs = spark.createDataFrame([(i, t, "x", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")

    def after(stage):
        return sorted(((r.doc_id, r.text) for r in stage(spark, docs, SF).collect()), key=str)

    assert after(corpus_pipeline.near_duplicates) == sorted(
        [(3, a), (5, b), (6, c), (6, d), (None, prose("e")), *rows[10:]], key=str
    )
    assert after(corpus_pipeline.benchmark_decontamination) == sorted([*rows[:10], rows[11], *rows[13:]], key=str)
    bad = (5, "no " * 100)
    more = docs.unionByName(spark.createDataFrame([(*bad, "x", "s", 0)], docs.schema))
    kept = corpus_pipeline.quality_rules(spark, more, SF).filter("doc_id = 5").collect()
    assert sorted(r.text for r in kept) == [a, b]
    assert corpus_pipeline.sharding(spark, docs, SF).count() == len(rows)
