"""Operator 12: base spans against the patterns as they are written, the tagger's gradient and
its accuracy on spans it has not seen, reconciliation against all subsets."""

import hashlib
import re
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lakestrata.llm import pii as P
from lakestrata.llm.tagger import Tagger

PLAIN = {
    0: r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    1: r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    2: r"[0-9]([\x20-]?[0-9])+",
    3: r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_base(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            doubled = [int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(digits[::-1])]
            fits = {0: True, 1: kind == 1 and all(int(p) <= 255 for p in m[0].split(".")), 2: 14 <= len(digits) <= 19 and sum(doubled) % 10 == 0, 3: 10 <= len(digits) <= 15}[kind]
            if fits:
                out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], s[0]))


SAMPLES = ["a@b.c", "x.y+z@mail-1.example.com..", "@a.b", "a@b", "a@b.c@d.e", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "0001.2.3.255", "4111 1111-1111 1111", "4111111111111112", "79927398713", "+1 (499) 555-6503", "+49-", "++12 345 678 901)", "+1234567890123456", "éa@b.de 日本", "4111111111111111.5"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(SAMPLES), st.text("a@.+- ()0159é", max_size=9)), max_size=6).map("".join))
def test_base(text):
    assert P.base_spans(text) == brute_base(text)


def test_base_takes_linear_time():
    for text in ("a" * 400_000 + "@", "1" * 400_000, "1." * 200_000, "+" * 100_000 + "1" * 100_000, "a@" * 200_000, "@" + "a." * 200_000):
        P.base_spans(text)


def test_gradient():
    rng = np.random.default_rng(0)
    model = Tagger(7, 2, hidden=3)
    for k in model.p:
        model.p[k] = model.p[k].astype(np.float64)
    x, y = rng.integers(0, 7, (6, 4)), np.array([[0, 1, 0, 3], [1, 2, 0, 4], [2, 0, 1, 4], [0, 3, 2, 0], [0, 4, 2, 1], [0, 0, 0, 2]])
    _, grad = model.loss_and_gradient(x, y)
    for k, p in model.p.items():
        for _ in range(5):
            i, old = tuple(int(rng.integers(0, n)) for n in p.shape), None
            old = p[i]
            p[i] = old + 1e-4
            more = model.loss_and_gradient(x, y)[0]
            p[i] = old - 1e-4
            less = model.loss_and_gradient(x, y)[0]
            p[i] = old
            assert (more - less) / 2e-4 == pytest.approx(grad[k][i], abs=2e-3)


def test_field():
    """Paths and marginals against all paths of a short row."""
    rng, model = np.random.default_rng(3), Tagger(5, 1, hidden=2, seed=4)
    model.p["step"] = rng.standard_normal((3, 3)).astype(np.float32)
    e = rng.standard_normal((4, 1, 3)).astype(np.float32)
    step, begin = model._weights()
    weigh = lambda p: begin[p[0]] + sum(e[t, 0, c] for t, c in enumerate(p)) + sum(step[a, b] for a, b in zip(p, p[1:]))
    paths = {p: weigh(p) for p in np.ndindex(3, 3, 3, 3)}
    assert tuple(model.best(e)[:, 0].tolist()) == max(paths, key=paths.get)
    total = sum(np.exp(w) for w in paths.values())
    for t in range(4):
        for c in range(3):
            assert model.marginals(e)[t, 0, c] == pytest.approx(sum(np.exp(w) for p, w in paths.items() if p[t] == c) / total, abs=1e-4)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(1, 9), st.integers(1, 50)), max_size=7))
def test_reconciled(found):
    """The set without overlaps of the greatest sum; base spans rule out what they touch."""
    text = "1[.]2.3.4 " * 8
    base = [(3, 20, 25)]
    spots = [(10 * (a // 8), 10 * (a // 8) + 9 + n % 2, float(s)) for a, n, s in found]
    proposed = list({(a, b): (1, a, b, s, False) for a, b, s in spots}.values())
    got = P.reconciled(text, base, proposed)
    free = {}
    for k, a, b, s, _ in proposed:
        b -= text[b - 1] == " "
        if not (a < 25 and b > 20):
            free[k, a, b] = max(s, free.get((k, a, b), 0))
    best = max((sum(free[x] for x in c) for n in range(len(free) + 1) for c in combinations(free, n) if all(x[2] <= y[1] or y[2] <= x[1] for x, y in combinations(c, 2))), default=0)
    assert sum(free[x] for x in got) == best and got == sorted(got, key=lambda s: s[1])


def test_parts_are_joined():
    text = "a" * 30 + "b" * 70 + " [at] " + "c" * 20 + ".com, and"
    assert P.reconciled(text, [], [(0, 30, 96, 60.0, True), (0, 48, 130, 70.0, True)]) == [(0, 30, 130)]


@pytest.fixture(scope="module")
def model(spark):
    return P.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_labelled_windows(spark):
    """The same windows however the rows lie; each base span that stands in one is its own."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text")
    docs = docs.unionByName(spark.createDataFrame([(" ".join(SAMPLES),), (None,)], "text string"))
    one, five = (sorted(map(tuple, P.labelled(docs.repartition(n), 7).collect())) for n in (1, 5))
    assert one == five and {k for k, *_ in one} == {-1, 0, 1, 2, 3} and max(sum(r[0] == k for r in one) for k in range(-1, 4)) <= 7
    for kind, left, span, right in one:
        found = P.base_spans(left + span + right)
        assert (kind, len(left), len(left) + len(span)) in found or kind == -1


def test_unseen_spans(spark, model):
    """Rewritten spans of other seeds in clean texts: found; clean texts: left alone."""
    rng = np.random.default_rng(99)
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("not text rlike '[0-9@]'").limit(160).collect()]
    hits, wrong = [0] * 4, 0
    for i, text in enumerate(texts):
        kind = i % 4
        span, at = P.rewritten(kind, P.made_up(kind, rng), rng), int(rng.integers(0, len(text) + 1))
        holder = f"{text[:at]} {span} {text[at:]}"
        base = P.base_spans(holder)
        added = P.reconciled(holder, base, P.proposals(model, [holder])[0])
        hits[kind] += (kind, at + 1, at + 1 + len(span)) in base + added
        wrong += sum(s[1] >= at + 1 + len(span) or s[2] <= at for s in added)
        assert P.reconciled(text, [], P.proposals(model, [text])[0]) == []
    assert min(hits) >= 0.7 * len(texts) / 4 and sum(hits) >= 0.85 * len(texts) and wrong == 0


def test_windows_without_a_trigger(model):
    """To leave them out changes nothing: all windows of a text are read here."""
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("adtocmxyz"), int(rng.integers(1, 9))))
    for _ in range(12):
        text = " ".join(word() if rng.integers(12) else P.rewritten(k := int(rng.integers(4)), P.made_up(k, rng), rng) for _ in range(60))
        codes, every = P.classes_of(text), []
        for s in range(0, max(1, len(text) - P.WIDTH + P.STRIDE), P.STRIDE):
            own = codes[s : s + P.WIDTH]
            x = np.zeros((P.WIDTH, 1), np.uint8)
            x[: len(own), 0] = own
            e, _ = model.emissions(x)
            for kind, a, b, score in P.spans_of(model.best(e)[: len(own), 0], model.marginals(e)[: len(own), 0]):
                every.append((kind, s + a, s + b, score, (a == 0 and s > 0) or (b == len(own) and s + len(own) < len(text))))
        base = P.base_spans(text)
        assert P.reconciled(text, base, every) == P.reconciled(text, base, P.proposals(model, [text])[0])


def test_table(spark, model):
    """Null, empty, long, tied and repeated rows, null ids, other columns."""
    rows = [(i, t, "b", [1]) for i, t in enumerate([None, "", *SAMPLES, " ".join(SAMPLES), "x " * 50_000 + "a@b.c", "+1 (499) 555-6503 4111 1111 1111 1111"])] + [(None, "a@b.c", None, None), (2, "a@b.c", "b", None), (2, "a@b.c", "b", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, base string, added array<int>").repartition(3)
    got = P.digests(P.find(docs, model)).collect()
    want = []
    for doc_id, text, *_ in rows:
        base = brute_base(text or "")
        want.append((doc_id, *[sum(k == i for k, _, _ in base) for i in range(4)], hashlib.sha256(",".join(f"{P.KINDS[k]}:{a}:{b}" for k, a, b in base).encode()).hexdigest()))
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r)[:6] for r in got), key=key) == sorted(want, key=key)
    for r in got:
        starts = [int(s.split(":")[1]) for s in r["spans"].split(",") if s]
        assert starts == sorted(starts) and len(starts) >= sum(tuple(r)[1:5])
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert P.digests(P.find(empty, model)).count() == 0 and P.labelled(empty).count() == 0
