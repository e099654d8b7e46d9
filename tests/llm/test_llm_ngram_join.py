from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest

from tillroll.llm import ngram_join as nj
from tillroll.llm.components import connected_components


def shingles(text):
    w = (text or "").translate({i: i + 32 for i in range(65, 91)}).encode().split()
    if not w:
        return frozenset()
    return frozenset(b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def brute(rows):
    """doc_id -> (set size, smallest doc_id linked to it), for unique ids."""
    sets = {d: shingles(t) for d, t in rows}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


def edited(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"e{rng.randrange(10**6)}"
    return out


def corpus(seed=1):
    rng = random.Random(seed)
    rows, passage = [], [f"p{i}" for i in range(60)]
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    for size in (6, 12, 40, 120, 300):
        for _ in range(4):
            words = fresh(size)
            for copy in range(8):  # a chain of edits: neighbours link, ends need not
                rows.append(" ".join(words))
                if copy % 3 == 0:
                    rows.append(" ".join(words).upper())
                words = edited(rng, words, max(1, size // 40))
    rows += [" ".join(fresh(30) + passage + fresh(20)) for _ in range(60)]
    rows += ["one two", "One two", "one two three", "", " ", None, "a " * 400, "a " * 300, "a b " * 200]
    rng.shuffle(rows)
    return list(enumerate(rows, 10))


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_against_brute_force(make_docs):
    rows = corpus()
    assert got(nj.join_documents(make_docs(rows))) == brute(rows)


@pytest.mark.parametrize("entries", [300, 3000])
def test_small_tasks_ranges_and_blocks_change_nothing(make_docs, monkeypatch, entries):
    monkeypatch.setattr(nj, "ENTRIES", entries)
    monkeypatch.setattr(nj, "GROUP_ENTRIES", 400)
    monkeypatch.setattr(nj, "BROADCAST_IDS", 0)
    rows = corpus(2)
    assert got(nj.join_documents(make_docs(rows).repartition(5))) == brute(rows)


def test_spanning_links_find_every_component():
    rng = random.Random(4)
    base = list(range(80))
    sets = []
    for _ in range(150):
        s = set(base)
        for _ in range(rng.randint(0, 14)):
            s.discard(rng.choice(base))
            s.add(rng.randrange(1000, 1200))
        sets.append(frozenset(s))
    sets = sorted(set(sets), key=sorted)
    keys = np.array(rng.sample(range(-500, 500), len(sets)), dtype=np.int64)
    links = nj.spanning_links(keys, [np.array(sorted(s), dtype=np.uint64) for s in sets])
    label = dict(links)
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = defaultdict(lambda: 10**9)
    for i in range(len(sets)):
        least[find(i)] = min(least[find(i)], int(keys[i]))
    assert {int(k): label.get(int(k), int(k)) for k in keys} == {int(k): least[find(i)] for i, k in enumerate(keys)}


def test_repeated_and_missing_ids(make_docs):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(5, text), (5, text), (None, text), (7, text + " x"), (None, None), (8, None), (None, "only here and nowhere else now")]
    out = sorted(((r.doc_id, r.component_id) for r in nj.join_documents(make_docs(rows)).collect()), key=str)
    assert out == [(5, 5), (5, 5), (7, 5), (8, 8), (None, 5), (None, None), (None, None)]


def test_empty_tables(make_docs):
    docs = make_docs([(1, "a")])
    assert nj.join_documents(docs.limit(0)).count() == 0
    assert got(nj.join_documents(make_docs([(1, None), (2, "")]))) == {1: (0, 1), 2: (0, 2)}


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    df = spark.createDataFrame(edges, "a long, b long")
    found = {r.node: r.component for r in connected_components(df).collect()}
    assert found == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100)}
    assert connected_components(df.limit(0)).count() == 0


def test_wide_and_null_ids(make_docs):
    wide = 2**60 + 1
    text = " ".join(f"w{i}" for i in range(60))
    near = text + " more"
    docs = make_docs([(wide, text), (wide + 1, near), (wide + 2, "something else here entirely now"), (None, "x")])
    out = {r.doc_id: r.component_id for r in nj.join_documents(docs).collect()}
    assert out == {wide: wide, wide + 1: wide, wide + 2: wide + 2, None: None}
    # a link that goes through a text without an id holds
    chain = [" ".join(f"w{i}" for i in range(a, a + 100)) for a in (0, 8, 16)]
    assert set(brute([(0, chain[0]), (1, chain[2])])) and brute([(0, chain[0]), (1, chain[2])])[1][1] == 1
    through = make_docs([(1, chain[0]), (None, chain[1]), (2, chain[2])])
    assert {r.doc_id: r.component_id for r in nj.join_documents(through).collect()} == {1: 1, None: 1, 2: 1}


def test_packing_visits_only_ranges_that_occur():
    rng = np.random.default_rng(1)
    for n, ranges in ((0, 5), (1, 1), (1, 1_000_000), (300, 7), (300, 10_000_000), (3000, 40)):
        h = np.sort(rng.integers(0, nj.SCAN_BELOW, n, dtype=np.uint64))
        found = list(nj.in_ranges(h, ranges, nj.SCAN_BELOW))
        assert len(found) <= min(n, ranges)  # steps follow the entries, not the ranges
        width = nj.SCAN_BELOW // ranges
        assert [i for i, a, b in found for _ in range(a, b)] == [min(int(x) // width, ranges - 1) for x in h.tolist()]
        assert [x for _, a, b in found for x in range(a, b)] == list(range(n))
    assert [i for i, _, _ in nj.in_ranges(np.array([0, 1 << 63, (1 << 64) - 1], dtype=np.uint64), 2, 1 << 64)] == [0, 1]


def test_long_chains_settle(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")
    assert {r.component for r in connected_components(edges).collect()} == {0}
    assert connected_components(edges.limit(0)).count() == 0
