from __future__ import annotations

import hashlib
import random
import string
import time

from tillroll.llm import secrets

HEX40 = "0123456789abcdef0123456789abcdef01234567"


def scan(make_docs, rows):
    return {r.doc_id: r for r in secrets.find_secrets(make_docs(rows)).collect()}


def test_base_spans(make_docs):
    text = f'é Password = "abcd1234" api_key:short {HEX40} AKIAABCDEFGHIJKL AKIASHORT tokeN: "x.y-z_12='
    r = scan(make_docs, [(1, text)])[1]
    spans = []
    for kind, part in (("assign", 'Password = "abcd1234'), ("hex", HEX40), ("access", "AKIAABCDEFGHIJKL"), ("assign", 'tokeN: "x.y-z_12=')):
        spans.append((text.index(part), secrets.KINDS.index(kind), text.index(part) + len(part)))
    expected = ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))
    assert r.spans == expected
    assert r.base_sha256 == hashlib.sha256(expected.encode()).hexdigest()
    assert (r.n_assign, r.n_access, r.n_hex, r.n_random) == (2, 1, 1, 0)


def test_keywords_ignore_ascii_case_only(make_docs):
    got = scan(make_docs, [(1, "ſecret=abcdefgh1"), (2, "SECRET=abcdefgh1")])
    assert got[1].n_assign == 0 and got[2].n_assign == 1


def test_random_strings_are_added_and_known_ones_are_not(make_docs):
    rng = random.Random(7)
    strange = "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(40))
    known = [
        "550e8400-e29b-41d4-a716-446655440000",
        HEX40.upper(),
        "1234567890123456789012345",
        "internationalization_of_applications",
        "release-2024-notes-for-version-12345",
        "averyveryveryverylongordinaryword",
    ]
    got = scan(make_docs, [(0, f"x {strange} y"), *enumerate((f"see {k} ok" for k in known), 1)])
    assert got[0].spans == "random:2:42" and got[0].n_random == 1
    assert all(got[i].spans == "" for i in range(1, len(known) + 1))


def test_no_random_span_within_a_base_span(make_docs):
    rng = random.Random(8)
    strange = "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(40))
    r = scan(make_docs, [(1, f"token={strange}")])[1]
    assert (r.n_assign, r.n_random) == (1, 0)


def brute_force(text):
    """The base spans, read character by character."""
    word = string.ascii_letters + string.digits + "+/_.=-"
    found = []
    at = 0
    while at < len(text):
        end = None
        for name in ("password", "passwd", "secret", "token", "apikey", "api_key"):
            low = "".join(c.lower() if c in string.ascii_letters else c for c in text[at : at + len(name)])
            if low != name:
                continue
            i = at + len(name)
            i += text[i : i + 1] in ('"', "'") and i < len(text)
            while text[i : i + 1] == " ":
                i += 1
            if text[i : i + 1] not in (":", "=") or i >= len(text):
                continue
            i += 1
            while text[i : i + 1] == " ":
                i += 1
            i += text[i : i + 1] in ('"', "'") and i < len(text)
            j = i
            while j < len(text) and text[j] in word:
                j += 1
            if j > i:
                end, value = j, j - i
                break
        if end is None:
            at += 1
            continue
        if value >= 8:
            found.append((at, 0, end))
        at = end
    for kind, first, alphabet, least in ((1, "AKIA", string.ascii_uppercase + string.digits, 16), (2, "", "0123456789abcdef", 32)):
        at = 0
        while at < len(text):
            j = at + len(first)
            while j < len(text) and text[j] in alphabet:
                j += 1
            if text.startswith(first, at) and j > at + len(first):
                if j - at >= least:
                    found.append((at, kind, j))
                at = j
            else:
                at += 1
    return sorted(found)


def test_base_spans_against_brute_force():
    rng = random.Random(5)
    parts = ["password", "PassWd", "secret", "Token", "api_key", "apikey", "APIKEY", '"', "'", " ", "  ", ":", "=", "==", ".", "-"]
    parts += ["abcdefgh", "1234567", "x", "AKIA", "AKIAAKIA", "ABCDEFGHIJKL", "0123456789abcdef", "ſ", "é", "\n", "/"]
    hits = 0
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))
        assert sorted(secrets.base_spans(text)) == brute_force(text), text
        hits += len(brute_force(text))
    assert hits > 500


def encode():
    with open(secrets.VOCABULARY, "rb") as file:
        return secrets.encoder(file.read())


def test_long_slugs_and_many_spans_take_linear_time():
    e = encode()
    began = time.perf_counter()
    for run in ("a-" * 40 + "x9y9z9", "a/b" * 20_000 + "9z", "-" * 50_000 + "9z9", "aB" * 30_000 + "9"):
        secrets.random_spans(run, [], e, secrets.RATIO)
    many = ("secret=abcdefgh1 " + "plainwords/" * 3 + " ") * 20_000
    secrets.random_spans(many, secrets.base_spans(many), e, secrets.RATIO)
    assert time.perf_counter() - began < 20


def test_precision_and_recall_on_planted_strings():
    e, rng = encode(), random.Random(3)

    def caught(alphabet, size):
        strings = ("".join(rng.choice(alphabet) for _ in range(size)) for _ in range(500))
        return sum(bool(secrets.random_spans(f"see {s} there", [], e, secrets.RATIO)) for s in strings) / 500

    letters = string.ascii_letters
    assert min(caught(letters + string.digits, n) for n in (20, 32, 40)) > 0.95
    assert min(caught(letters + string.digits + "+/", n) for n in (20, 40)) > 0.95
    assert min(caught(string.ascii_uppercase + string.digits, n) for n in (20, 40)) > 0.95
    assert min(caught(letters, n) for n in (20, 32, 40)) > 0.75  # without digits: 0.84 to 0.87
    plain = ["getHTTPResponseHeaderFieldsAsync", "src/main/java/com/example/service", "some_very_long_snake_case_identifier_here"]
    plain += ["THISISACONSTANTNAMEINUPPERCASE", "aQuickTourOfTheCountrySide", "2024-01-31/report-final-v/page-12"]
    assert not any(secrets.random_spans(p, [], e, secrets.RATIO) for p in plain)


def test_runs_that_touch_a_base_span_are_left_to_it():
    e, rng = encode(), random.Random(4)
    for _ in range(300):
        pieces = ["".join(rng.choice(string.ascii_letters + string.digits) for _ in range(rng.randint(5, 40))) for _ in range(4)]
        text = "".join(rng.choice(["", " ", "token=", "secret: ", "/"]) + p for p in pieces)
        base = secrets.base_spans(text)
        expected = [
            (m.start(), 3, m.end())
            for m in secrets.RUN.finditer(text)
            if not any(s < m.end() and m.start() < t for s, _, t in base)
            and not secrets.is_known(m[0])
            and len(m[0]) < secrets.RATIO * len(e(m[0]))
        ]
        assert secrets.random_spans(text, base, e, secrets.RATIO) == expected


def test_wide_ids_beside_a_null(make_docs):
    docs = make_docs([(2**60 + 1, "a"), (2**60 + 2, "b"), (None, "c")])
    assert sorted(r.doc_id or 0 for r in secrets.find_secrets(docs).collect()) == [0, 2**60 + 1, 2**60 + 2]


def test_edge_rows(make_docs):
    empty = hashlib.sha256(b"").hexdigest()
    docs = make_docs([(1, None), (2, ""), (3, "a" * 300_000), (4, "secret=aaaaaaaa"), (4, "secret=aaaaaaaa"), (None, "x")])
    got = sorted(((r.doc_id, r.n_assign, r.n_hex) for r in secrets.find_secrets(docs).collect()), key=str)
    assert got == [(1, 0, 0), (2, 0, 0), (3, 0, 1), (4, 1, 0), (4, 1, 0), (None, 0, 0)]
    assert {r.base_sha256 for r in secrets.find_secrets(docs).filter("doc_id < 3").collect()} == {empty}
    assert secrets.find_secrets(docs.limit(0)).count() == 0
