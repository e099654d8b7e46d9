from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest

from tillroll.llm import periodic


def brute_force(words):
    """Every stretch with its smallest period, kept if long enough and not extendable."""
    n, found = len(words), []
    for s in range(n):
        for e in range(s + 6, n + 1):
            q = next(p for p in range(1, e - s + 1) if all(words[i] == words[i + p] for i in range(s, e - p)))
            if e - s < max(6, 4 * q):
                continue
            left = s > 0 and words[s - 1] == words[s - 1 + q]
            right = e < n and words[e] == words[e - q]
            if not left and not right:
                found.append((s, e - s, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def by_stretches(words):
    """The same by scanning for equal words p apart, for longer texts."""
    n, best = len(words), {}
    for p in range(1, n // 4 + 1):
        s = None
        for i in range(n - p + 1):
            if i < n - p and words[i] == words[i + p]:
                s = i if s is None else s
            elif s is not None:
                if i - s + p >= max(6, 4 * p):
                    best.setdefault((s, i + p), p)
                s = None
    return sorted(((s, e - s, p) for (s, e), p in best.items()), key=lambda r: (r[0], r[2]))


def test_against_brute_force():
    rng = random.Random(11)
    texts = []
    for _ in range(120):
        alphabet = "ab" if rng.random() < 0.6 else "abc"
        words = [rng.choice(alphabet) for _ in range(rng.randint(0, 26))]
        if len(words) > 4 and rng.random() < 0.7:
            cut, p = rng.randrange(len(words)), rng.randint(1, 4)
            words[cut:] = [words[cut + (i - cut) % p] for i in range(cut, len(words)) if cut + (i - cut) % p < len(words)]
        texts.append(words)
    got = [list(map(tuple, r.tolist())) for r in periodic.periodic_runs(texts)]
    assert got == [brute_force(t) for t in texts]
    assert sum(map(len, got)) > 40
    assert [by_stretches(t) for t in texts] == got


def test_long_periods_and_copies_in_one_sequence():
    rng = random.Random(4)
    texts = []
    for n in (50, 300, 900, 900):
        words = [str(rng.randrange(40)) for _ in range(n)]
        a = rng.randrange(n // 3)
        p = 1 + (n - a) // rng.randint(3, 9)
        texts.append(words[:a] + [words[a + i % p] for i in range(n - a)])
    texts += [texts[-1], ["x"] * 500, [], ["x"] * 5, ["x"] * 6]
    got = [list(map(tuple, r.tolist())) for r in periodic.periodic_runs(texts)]
    assert got == [by_stretches(t) for t in texts]
    assert got[-1] == [(0, 6, 1)] and got[-2] == []


def test_many_short_texts_that_repeat_up_to_their_ends():
    rng = random.Random(8)
    texts = [[rng.choice("ab")] * rng.randint(4, 9) for _ in range(3000)]
    texts += [["b", "a", "c"] * rng.randint(1, 5) for _ in range(500)]
    got = [list(map(tuple, r.tolist())) for r in periodic.periodic_runs(texts)]
    assert got == [by_stretches(t) for t in texts]


def test_extensions_against_comparing_words():
    rng = np.random.default_rng(2)
    words = rng.integers(0, 2, 400)
    words[200:390] = words[0:190]
    sequence = np.append(words, 2)
    extend = periodic.CommonExtension(sequence, np.zeros(401, dtype=np.int64))
    left = rng.integers(0, 399, 3000)
    right = rng.integers(0, 400, 3000)
    left, right = np.minimum(left, right), np.maximum(left, right)
    left, right = left[left < right], right[left < right]
    expected = [
        next(k for k in range(400) if sequence[i + k] != sequence[j + k]) for i, j in zip(left.tolist(), right.tolist())
    ]
    assert extend(left, right).tolist() == expected
    assert max(expected) > 100


def test_every_difference_is_covered():
    assert {(a - b) % periodic.MODULUS for a in periodic.RESIDUES for b in periodic.RESIDUES} == set(range(13))


def test_blocks_of_the_grid_change_nothing(monkeypatch):
    texts = [["a", "b"] * 40, ["c"] * 30, ["d", "e", "f"] * 9]
    whole = [r.tolist() for r in periodic.periodic_runs(texts)]
    monkeypatch.setattr(periodic, "GRID", 7)
    assert [r.tolist() for r in periodic.periodic_runs(texts)] == whole


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def digest_row(doc_id, text):
    words = [w.decode() for w in (text or "").encode().split()]
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = by_stretches(words)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    return {
        "doc_id": doc_id,
        "n_runs": len(runs),
        "start": best[0],
        "length": best[1],
        "period": best[2],
        "exponent_milli": 1000 * best[1] // best[2] if runs else None,
        "runs_sha256": sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)),
        "collapsed_sha256": sha(" ".join(w for i, w in enumerate(words) if i not in dropped)),
    }


def test_query_against_brute_force_on_given_texts(spark):
    sf = "/root/testdata/sf0.001"
    got = [r.asDict() for r in periodic.op12_periodic_runs(spark, sf).collect()]
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(map(str, got)) and len(got) == len(docs)
    by_id = {r["doc_id"]: r for r in got}
    checked = [tuple(d) for d in docs if len((d.text or "").split()) < 1500]
    assert len(checked) > 100
    for doc_id, text in checked:
        assert by_id[doc_id] == digest_row(doc_id, text)


def test_edge_rows(make_docs):
    wide = 2**60 + 1
    lots = "go " * 40_000
    rows = [(1, None), (2, ""), (3, " \n"), (None, "a a a a a a"), (wide, "a a a a a a a"), (wide + 1, "b"), (4, lots), (4, lots)]
    docs = make_docs(rows)
    got = sorted(
        ((r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in periodic.find_periodic_runs(docs).collect()), key=str
    )
    assert got == sorted(
        [
            (1, [], ""),
            (2, [], ""),
            (3, [], ""),
            (None, [(0, 6, 1)], "a"),
            (wide, [(0, 7, 1)], "a"),
            (wide + 1, [], "b"),
            (4, [(0, 40_000, 1)], "go"),
            (4, [(0, 40_000, 1)], "go"),
        ],
        key=str,
    )
    assert periodic.find_periodic_runs(docs.limit(0)).count() == 0


@pytest.mark.parametrize("doc_id", [n for n in range(400) if zlib.crc32(str(n).encode()) % 10 == 0][:8])
def test_planted_texts(make_docs, doc_id):
    docs = make_docs([(doc_id, "one two  three\nfour five six seven eight nine ten"), (doc_id, ""), (doc_id, None)])
    texts = [r[0] for r in docs.select(periodic.planted(docs).alias("t")).collect()]
    words = "one two three four five six seven eight nine ten".split()
    g = zlib.crc32(str(doc_id).encode()) // 10
    a = g % 10
    p = 1 + (10 - a) // (3 + g % 8)
    assert texts == [" ".join(words[:a] + [words[a + (i - a) % p] for i in range(a, 10)]), "", None]
