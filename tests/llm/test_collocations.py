"""Operator 13 against brute force and its SQL; the index of a shard against plain counting."""

import re
import tracemalloc
from collections import Counter

import numpy as np
import oracle
import pyarrow as pa
import pytest
from pyspark import TaskContext

from lakestrata.llm import collocations as C

SF = "/root/testdata/sf0.001"
RNG = np.random.default_rng(5)
WORDS = ["The", "of", "a b", "é", "日本", "x", "y", "z"]


def brute(rows, min_count, top, inside=50):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", text):
            ws = re.findall("[^ \t]+", piece)
            n[lang] += len(ws)
            f.update((lang, *ws[i : i + k]) for k in (1, 2, 3) for i in range(len(ws) - k + 1))
    found = []
    for key, a in f.items():
        lang, *ws = key
        if len(ws) < 2 or a < min_count:
            continue
        if len(ws) == 2 and any(k[0] == lang and len(k) == 4 and tuple(ws) in (k[1:3], k[2:4]) and v >= min_count and 100 * v >= inside * a for k, v in f.items()):
            continue
        cuts = [(1_000_000 * a * a // (f[(lang, *ws[:k])] * f[(lang, *ws[k:])]), k) for k in range(1, len(ws))]
        score, k = min(cuts)
        found.append((lang, -score, -a, " ".join(ws).encode(), f[(lang, *ws[:k])], f[(lang, *ws[k:])]))
    out, rank = [], Counter()
    for lang, score, a, phrase, left, right in sorted(found):
        rank[lang] += 1
        if rank[lang] <= top:
            out.append((lang, rank[lang], phrase.decode(), -a, left, right, n[lang], -score))
    return out


@pytest.fixture(scope="module")
def rows():
    made = []
    for i in range(60):
        words = RNG.choice(WORDS, int(RNG.integers(0, 40)))
        gaps = RNG.choice([" ", "  ", "\t", ". ", ",", "\n", "! "], len(words), p=[0.6, 0.1, 0.1, 0.05, 0.05, 0.05, 0.05])
        made.append((["en", "de", None, "und"][i % 4], "".join(w + g for w, g in zip(words, gaps, strict=True))))
    made += [("en", None), ("en", ""), ("en", "..!"), (None, "  \t"), ("en", "the of x " * 400), ("xx", "only here")]
    return made + made[:5]  # repeated rows


@pytest.mark.parametrize("shard_words", [C.SHARD, 37])
def test_brute_force(spark, rows, shard_words):
    """Ties, repeated rows, and texts that go over many shards."""
    docs = spark.createDataFrame([(i, t, lang, "s") for i, (lang, t) in enumerate(rows)], "shard long, text string, lang string, word string").repartition(3)
    for min_count, top in ((10, 2000), (2, 7)):
        got = C.collocations(docs, min_count, top, shard_words=shard_words).collect()
        assert sorted(map(tuple, got)) == brute(rows, min_count, top)


def test_empty(spark):
    assert C.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0


def test_index():
    """Counts, and numbers of extensions to both sides, by either order of extending."""
    ids = RNG.integers(0, 6, 400)
    index = C.Index(ids)
    plain = {k: Counter(tuple(ids[i : i + k].tolist()) for i in range(len(ids) - k + 1) if ids[i : i + k].all()) for k in (1, 2, 3)}
    level = {1: index.words()}
    for left in (True, False):
        level[2] = index.extended(level[1], left)[0]
        for then in (True, False):
            level[3] = index.extended(level[2], then)[0]
            for k in (1, 2, 3):
                assert dict(zip(map(tuple, level[k].words.tolist()), level[k].counts.tolist(), strict=True)) == plain[k]
        for side in (True, False):
            for words, n in zip(map(tuple, level[2].words.tolist()), index.extensions(level[2], side).tolist(), strict=True):
                assert n == sum((k[1:] if side else k[:-1]) == words for k in plain[3])


def test_memory_of_a_shard():
    """Extending all phrases of a shard takes little beside what it returns."""
    index = C.Index(np.random.default_rng(8).zipf(1.3, 1 << 19) % 5000)
    index.side(True)
    tracemalloc.start()
    level, _ = index.extended(index.words())
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert level.counts.sum() > 1 << 18
    assert most < 35 * len(index.ids)


def test_shards_are_dealt_evenly(spark):
    """As many shards to each task, in the order that a shard's step asks for."""
    shards = [(task << 32) + nth for task in range(8) for nth in range(5)]
    texts = spark.createDataFrame([(s, 9, 0, b"x") for s in shards], "shard long, w1 long, w2 long, ids binary").repartition(3)
    told = spark.createDataFrame([(s, i, 10 * i, None) for s in shards for i in (1, 2)] + [(s, None, 1, 2) for s in shards[:30]], "shard long, local int, w1 long, w2 long").repartition(3)

    def step(shard, words, pairs):
        assert shard["ids"][0].as_py() == b"x" and words["w1"].to_pylist() in ([10, 20], [20, 10])
        return pa.table({"task": pa.array([TaskContext.get().partitionId()]), "n": pa.array([pairs.num_rows])})

    got = C._by_shard(texts, told, 8, step, "task long, n long").collect()
    assert Counter(r["task"] for r in got) == dict.fromkeys(range(4), 10)
    assert sum(r["n"] for r in got) == 30


def test_sql(spark):
    assert oracle.difference(C.op13_collocations(spark, SF), C.op13_sql(), SF) == ""
