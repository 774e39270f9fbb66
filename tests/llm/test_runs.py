"""Operator 11 against brute force over all starts and periods."""

import hashlib
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lakestrata.llm import runs as R


def brute_runs(w):
    """All maximal stretches by smallest period, straight from the definition."""
    n, found = len(w), []
    for p in range(1, n // 4 + 1):
        a = 0
        while a < n - p:
            if w[a] != w[a + p]:
                a += 1
                continue
            b = a
            while b + p < n and w[b] == w[b + p]:
                b += 1
            part = w[a : b + p]
            smallest = next(d for d in range(1, p + 1) if all(x == y for x, y in zip(part, part[d:])))
            if smallest == p and b - a + p >= max(6, 4 * p):
                found.append((a, b - a + p, p))
            a = b + 1
    return sorted(found)


def brute_row(doc_id, text):
    words = re.findall("[^ \t-\r]+", text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    kept = " ".join(w for i, w in enumerate(words) if i not in drop)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    head = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *head, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(kept))


def caught(w, step, longest=None):
    catcher = R.SquareCatcher(longest)
    w = np.array(w, np.int64)
    for i in range(0, len(w), step):
        catcher.append(w[i : i + step])
    return catcher.runs()


PARTS = st.lists(st.tuples(st.lists(st.integers(0, 3), max_size=9), st.integers(1, 9)), max_size=8)


@settings(max_examples=300, deadline=None)
@given(PARTS, st.integers(1, 60))
def test_catcher(parts, step):
    """Powers of short blocks side by side, appended one word or many at a time."""
    w = [x for block, times in parts for x in block * times]
    assert caught(w, step) == brute_runs(w) == caught(w, step, len(w) // 4)


@pytest.mark.parametrize("w", [[1] * 700, [1, 2] * 300 + [1] * 9, list(range(150)) * 4 + [7], [0, 1, 2, 3, 4, 5, 6] * 40 + [1, 2, 3] * 50, [*range(60)] * 5 + [*range(30)] * 8, np.random.default_rng(1).integers(0, 2, 900).tolist()])
def test_long_periods(w):
    for step in (1, 7, 1000):
        assert caught(w, step) == brute_runs(w)
    two = R.SquareCatcher()
    for part in (w, [-1], w, [-2]):  # texts side by side, cut by numbers of their own
        two.append(np.array(part, np.int64))
    assert two.runs() == sorted(brute_runs(w) + [(s + len(w) + 1, n, q) for s, n, q in brute_runs(w)])


def test_numbered(monkeypatch):
    text = ("é x\t\x0b日本 " * 50).encode()
    want = R.numbered(text, R.Numbers())
    for size in (1, 5, 37):
        monkeypatch.setattr(R, "SLICE", size)
        assert R.numbered(text, R.Numbers()).tolist() == want.tolist()


def test_brute_force(spark):
    """Null, empty, long and repeated texts, ties, null and repeated ids, other columns."""
    rng = np.random.default_rng(2)
    texts = [None, "", " \t\r\n ", "one", "a a a a a a", "a b a b a b a b", "x x x x x x y y y y y y", "la " * 300, "É\x1c é " * 30, "tab\tnew\nline\x0bv " * 9]
    for i in range(120):
        texts.append(" ".join(rng.choice(list("abc"), int(rng.integers(1, 90)))) + " " + " ".join(map(str, rng.integers(0, 5, int(rng.integers(1, 9))))) * int(rng.integers(1, 7)))
    rows = [(i, t, "s", [1]) for i, t in enumerate(texts)] + [(None, "a " * 9, None, None), (3, "z " * 40, "s", None), (3, "z " * 40, "s", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string, runs array<int>").repartition(3)
    found = R.digests(R.collapse(docs, R.planted_repetition)).drop("n_words").collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, found), key=key) == sorted((brute_row(r[0], r[1]) for r in rows), key=key)
    assert sum(r["n_runs"] > 0 for r in found) > 40
    plain = R.collapse(docs.filter("text = 'a b a b a b a b'")).first()
    assert plain["collapsed"] == "a b" and [tuple(r) for r in plain["runs"]] == [(0, 8, 2)]


def test_empty(spark):
    assert R.digests(R.collapse(spark.createDataFrame([], "doc_id long, text string"))).count() == 0


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("length(text) < 6000").select("doc_id", "text")
    got = {r["doc_id"]: tuple(r) for r in R.op11_runs(spark, sf).drop("n_words").collect()}
    for r in docs.collect():
        assert got[r["doc_id"]] == brute_row(r["doc_id"], r["text"])
