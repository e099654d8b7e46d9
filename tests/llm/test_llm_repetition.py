from __future__ import annotations

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tillroll.llm import repetition

RULES = {"base_window": 5, "least_words": 8, "max_covered": 0.2, "max_repeat": 100}


def brute(text):
    w = text.encode().split()
    n = len(w)
    best = [0] * n
    for i in range(n):
        for j in range(n):
            h = 0
            while i != j and i + h < n and j + h < n and w[i + h] == w[j + h]:
                h += 1
            best[i] = max(best[i], h)

    def covered(least, fixed):
        return len({p for i in range(n) if best[i] >= least for p in range(i, i + (fixed or best[i]))})

    return covered(5, 5), covered(8, None), max(best, default=0)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab \n", max_size=60), min_size=1, max_size=5))
def test_repeats_against_brute_force(texts):
    for text, row in zip(texts, repetition.judge(texts, RULES)):
        assert (row[4], row[5], row[6]) == brute(text)


def test_suffixes_sort_like_lists():
    rng = random.Random(3)
    texts = [[rng.choice("ab") for _ in range(rng.randint(1, 30))] for _ in range(20)]
    words = np.array([ord(c) for t in texts for c in t])
    ends = np.repeat(np.cumsum([len(t) for t in texts]), [len(t) for t in texts])
    rank = repetition.suffix_ranks(words, ends, ends)
    expected = sorted(range(len(words)), key=lambda i: (ends[i], list(words[i : ends[i]])))
    assert list(np.argsort(rank)) == expected


def test_base_counts_and_verdict(make_docs):
    fresh = " ".join(f"w{i}" for i in range(40))
    loop = "buy now cheap pills today and save lots " * 12
    rows = [
        (1, fresh),
        (1, fresh),
        (2, loop),
        (3, None),
        (4, ""),
        (5, " \n\t "),
        (6, "same line\nsame line\n\n# $ other word"),
        (None, fresh),
        (7, fresh + " " + " ".join(f"x{i}" for i in range(30_000)) + " " + fresh),
    ]
    got = {(r.doc_id, r.n_words): r for r in repetition.repetition_rules(make_docs(rows)).collect()}
    assert got[(1, 40)].kept and not got[(1, 40)].base_failed
    assert got[(None, 40)].kept
    assert got[(2, 96)].base_failed and not got[(2, 96)].kept and got[(2, 96)].longest_repeat == 88
    assert got[(3, 0)].base_failed and got[(4, 0)].base_failed and got[(5, 0)].base_failed
    six = got[(6, 7)]
    assert (six.n_symbols, six.n_dup_lines, six.word_chars) == (2, 1, 28)
    long = got[(7, 30_080)]
    assert long.longest_repeat == 40 and long.n_covered_words == 80 and long.kept


def test_long_repeat_is_rejected(make_docs):
    passage = " ".join(f"p{i}" for i in range(150))
    text = passage + " " + " ".join(f"x{i}" for i in range(3000)) + " " + passage
    row = repetition.repetition_rules(make_docs([(1, text)])).first()
    assert not row.base_failed and not row.kept and row.longest_repeat == 150


def test_kept_documents_carry_all_columns(make_docs):
    docs = make_docs([(1, " ".join(f"w{i}" for i in range(20))), (None, " ".join("abcdefghijklm")), (2, None), (3, "x " * 90)])
    kept = repetition.kept_documents(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "None"]


def test_empty_table(make_docs):
    assert repetition.repetition_rules(make_docs([(1, "a")]).limit(0)).count() == 0


def test_wide_ids_beside_a_null(make_docs):
    docs = make_docs([(2**60 + 1, "a"), (2**60 + 2, "b c"), (None, "c")])
    got = sorted((r.doc_id or 0, r.n_words) for r in repetition.repetition_rules(docs).collect())
    assert got == [(0, 1), (2**60 + 1, 1), (2**60 + 2, 2)]
