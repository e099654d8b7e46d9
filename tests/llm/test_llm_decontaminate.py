from __future__ import annotations

import random

from pyspark.sql import functions as F

from tillroll.llm import decontaminate as dc


def shingles(text):
    table = {i: i + 32 for i in range(65, 91)}
    w = (text or "").translate(table).encode().split()
    return {b" ".join(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(docs, items, containment):
    found = set()
    for d, text in docs:
        for i, item in items:
            want = shingles(item)
            if d is not None and i is not None and want:
                shared = len(want & shingles(text))
                if shared / len(want) >= containment:
                    found.add((d, i, shared, len(want)))
    return found


def corpus():
    rng = random.Random(11)
    words = [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, text(rng.randint(3, 60))) for i in range(25)] + [(100, None), (101, ""), (None, text(20))]
    items.append((102, items[3][1]))
    docs = []
    for d in range(120):
        body = text(rng.randint(0, 200))
        if d % 3 == 0:
            i, item = items[rng.randrange(25)]
            cut = item.split()
            if d % 2:
                cut = cut[: max(5, int(len(cut) * rng.random()))]
            body = f"{body}\n{' '.join(cut).upper()}\t{text(30)}"
        docs.append((d, body))
    return [*docs, (500, None), (501, ""), (None, items[0][1]), (502, "x " * 50_000 + items[5][1]), (0, docs[0][1])], items


def test_against_brute_force(spark, make_docs):
    docs, items = corpus()
    benchmark = spark.createDataFrame([(i, t, "n") for i, t in items], "item_id long, text string, hash string")
    for containment in (0.3, 0.6, 1.0):
        got = dc.contained_items(make_docs(docs), benchmark, containment=containment).collect()
        found = {(r.doc_id, r.item_id, r.shared, r.item_shingles) for r in got}
        assert found == brute(docs, items, containment) and len(found) == len(got)
        assert found


def test_beyond_the_broadcast_bound(spark, make_docs, monkeypatch):
    monkeypatch.setattr(dc, "BROADCAST_ROWS", 0)
    docs, items = corpus()
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in dc.contained_items(make_docs(docs), benchmark).collect()}
    assert got == {f[:2] for f in brute(docs, items, dc.CONTAINMENT)}


def test_sketches_are_far_smaller_than_sets(spark):
    items = dc.item_shingles(spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet"))
    assert dc.sketches(items, 0.6).count() < 0.75 * items.select(F.count("*")).first()[0]


def test_empty_tables(spark, make_docs):
    benchmark = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    docs = make_docs([(1, "a b c d e f")])
    assert dc.contained_items(docs.limit(0), benchmark).count() == 0
    assert dc.contained_items(docs, benchmark.limit(0)).count() == 0
    assert dc.contained_items(docs, benchmark).count() == 1


def test_no_python_in_the_plan(spark):
    got = dc.op1_decontaminate(spark, "/root/testdata/sf0.001")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
