from __future__ import annotations

from collections import defaultdict

import pytest

from tillroll.llm import mixing


def water_level(sizes, weights=(1, 2, 3), cap=3):
    """Targets by repeated resharing, as the contract words it."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, target, free = sum(sizes.values()), {}, set(order)
    while free:
        left, w = total - sum(target.values()), sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / w >= cap * sizes[s]}
        if not over:
            target |= {s: left * weight[s] / w for s in free}
            break
        target |= {s: float(cap * sizes[s]) for s in over}
        free -= over
    return target


def documents(n=600):
    rows = []
    for i in range(n):
        source = ["b", None, "a", "é", "hot", "z"][min(i % 12, 5) if i % 3 else 4]
        rows.append((i, "w " * (i % 17 + (400 if i == 5 else 0)), source))
    return rows


@pytest.mark.parametrize("ranges", [1, 7, 4096])
def test_targets_and_draw(make_docs, ranges):
    docs = documents()
    got = mixing.mix_sources(make_docs(docs), ranges=ranges).collect()
    sizes = defaultdict(int)
    for _, text, source in docs:
        sizes[source] += len(text.split())
    targets = water_level(sizes)
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(targets[r.source])
        assert r.taken <= 3 * r.size
        taken[r.source] += r.taken
    largest = max(len(t.split()) for _, t, _ in docs)
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= largest / 2 + 1
    assert len(got) == len(docs)


def test_the_number_of_ranges_changes_nothing(make_docs):
    docs = make_docs(documents())
    draws = [sorted((r.doc_id, r.taken) for r in mixing.mix_sources(docs, ranges=n).collect()) for n in (1, 50, 4096)]
    assert draws[0] == draws[1] == draws[2]


def test_draw_follows_sorted_keys(make_docs, spark):
    """Brute force of the fractional selection: sort by key, prefix sums up to the rest."""
    docs = make_docs(documents())
    rows = mixing.drawn(docs.select("doc_id", "source", "text")).collect()
    got = {r.doc_id: r for r in mixing.mix_sources(docs).collect()}
    by_source = defaultdict(list)
    for r in rows:
        by_source[r.source].append(r)
    for members in by_source.values():
        ahead = 0
        for r in sorted(members, key=lambda r: (r.mix_key, r.doc_id)):
            g = got[r.doc_id]
            epochs = int(g.target // g.source_size)
            rest = g.target - epochs * g.source_size
            assert g.copies == epochs + (2 * ahead + r.mix_size < 2 * rest)
            ahead += r.mix_size


def test_mixed_documents_are_copies_of_rows(make_docs):
    docs = make_docs(documents())
    copies = {r.doc_id: r.copies for r in mixing.mix_sources(docs).collect()}
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    count = defaultdict(int)
    for r in mixed.collect():
        count[r.doc_id] += 1
    assert dict(count) == {k: v for k, v in copies.items() if v}


def test_edge_rows(make_docs):
    docs = make_docs([(1, None, "a"), (2, "", "a"), (None, "x y", None), (3, "x y", None), (3, "x y", None)])
    got = mixing.mix_sources(docs).collect()
    assert len(got) == 5 and {r.taken for r in got if r.size == 0} == {0}
    assert mixing.mix_sources(docs.limit(0)).count() == 0
    assert mixing.mix_sources(make_docs([(1, None, "a"), (2, " ", None)])).count() == 2
    assert mixing.mixed_documents(docs.limit(0)).count() == 0


def test_quality_sharpens_the_draw(make_docs):
    """Clean documents are drawn before those full of symbols far more often than not."""
    rows = [(i, "#$% " * 50 if i % 2 else "abc " * 50, "a") for i in range(400)] + [(1000, "w " * 20_000, "b")]
    got = [r for r in mixing.mix_sources(make_docs(rows), cap=1, weights=(1, 9)).collect() if r.source == "a"]
    assert sum(r.taken for r in got if r.doc_id % 2 == 0) >= sum(r.taken for r in got if r.doc_id % 2)


@pytest.mark.parametrize("own_text", [False, True])
def test_many_null_or_equal_ids_come_near_the_target(make_docs, own_text):
    rows = [(None, f"w{i if own_text else ''} x y z", "hot") for i in range(1000)]
    rows += [(7, "one two three four five", "same") for _ in range(1000)]
    rows += [(i, "a b c d e f", "other") for i in range(100, 1300)]
    docs = make_docs(rows).repartition(7)
    got = mixing.mix_sources(docs).collect()
    taken, targets = defaultdict(int), {}
    for r in got:
        taken[r.source] += r.taken
        targets[r.source] = r.target
        assert r.taken % max(r.size, 1) == 0 and r.taken <= 3 * r.size
    assert len(got) == len(rows) and len(targets) == 3
    for source, target in targets.items():
        assert abs(taken[source] - target) <= 6 / 2 + 1, source
    words = defaultdict(int)
    for r in mixing.mixed_documents(docs).collect():
        words[r.source] += len(r.text.split())
    assert words == taken
    again = mixing.mix_sources(docs.repartition(3)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
