from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np

from tillroll.llm import sharding


def test_place_takes_the_best_dot_product():
    rng = np.random.default_rng(2)
    demands = rng.random((200, 3))
    placed = sharding.place(demands, 7)
    scaled = demands / demands.sum(axis=0) * np.sqrt(np.asarray(sharding.WEIGHTS))
    residual = np.tile(scaled.sum(axis=0) / 7, (7, 1))
    for i in np.argsort(-scaled[:, 0], kind="stable"):
        dots = [float(residual[s] @ scaled[i]) for s in range(7)]
        assert dots[placed[i]] >= max(dots) - 1e-12
        residual[placed[i]] -= scaled[i]


def test_shards_are_balanced_and_slots_gapless(make_docs):
    rows = [(i, f"text {i} " * (i % 50 + 1)) for i in range(3000)] + [(10_000 + i, "copy of one text " * 20) for i in range(1500)]
    got = sharding.shard_documents(make_docs(rows), shards=8).collect()
    texts = dict(rows)
    size, slots = defaultdict(int), defaultdict(list)
    for r in got:
        assert r.size == len(texts[r.doc_id].encode()) + 16
        assert r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert set(size) == set(range(8)) and len(got) == 4500
    assert max(size.values()) <= 1.02 * sum(size.values()) / 8
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_a_small_group_stays_together(make_docs):
    rows = [(i, f"text {i} " * 30) for i in range(2000)] + [(9000 + i, "pair") for i in range(3)]
    got = sharding.shard_documents(make_docs(rows), shards=4, lots_per_shard=16).filter("doc_id >= 9000").collect()
    assert len({r.shard for r in got}) == 1


def test_groups_that_fit_a_shard_stay_together(make_docs):
    copies = {"pair": 2, "twenty": 20, "most 100": 60}
    rows = [(i, f"text {i} " * 30) for i in range(3000)]
    rows += [(10_000 * (g + 1) + i, f"{t} " * 30) for g, (t, n) in enumerate(copies.items()) for i in range(n)]
    got = sharding.shard_documents(make_docs(rows)).filter("doc_id >= 10000").collect()
    shards = defaultdict(set)
    for r in got:
        shards[r.doc_id // 10_000].add(r.shard)
    assert [len(shards[g + 1]) for g in range(3)] == [1, 1, 1]


def test_a_group_above_a_shard_is_split_into_few_pieces(make_docs):
    rows = [(i, f"text {i} " * 30) for i in range(2000)] + [(10_000 + i, "hot text 12 " * 25) for i in range(500)]
    got = sharding.shard_documents(make_docs(rows), shards=8).collect()
    size = defaultdict(int)
    for r in got:
        size[r.shard] += r.size
    assert 2 <= len({r.shard for r in got if r.doc_id >= 10_000}) <= 4
    assert max(size.values()) <= 1.02 * sum(size.values()) / 8


def test_edge_rows(make_docs):
    docs = make_docs([(1, None), (None, None), (2, ""), (3, "é"), (3, "é"), (4, "x" * 200_000)])
    got = sharding.as_contract(sharding.shard_documents(docs)).collect()
    assert sorted(r["size"] for r in got) == [16, 16, 16, 18, 18, 200_016]
    assert len({(r.shard, r.slot) for r in got}) == 6
    assert {r.text_crc32 for r in got if r["size"] == 16} == {0}
    assert sharding.shard_documents(docs.limit(0)).count() == 0
