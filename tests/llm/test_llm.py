"""The operators of the llm package against brute force on small, awkward tables."""

import hashlib
import re
import zlib

import numpy as np
import oracle
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lakestrata.llm import bagminhash, bpe, licenses, linking, onebit, packing, passages, quality, syncmers, token_files, warc
from lakestrata.llm.common import fresh_path
from lakestrata.llm.tokens import byte_level_encoder, load_tokenizer, word_encoder

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, source string, node string"
RNG = np.random.default_rng(3)
VOCABULARY = ["".join(RNG.choice(list("abcdefghiklmnoprstu"), RNG.integers(3, 9))) for _ in range(3000)]


def prose(n, seed):
    words = np.random.default_rng(seed).choice(VOCABULARY, n)
    return " ".join(w + "." if i % 11 == 10 else w for i, w in enumerate(words))


TEXTS = ["", None, "a", "Hello  world \n\n x\tÉté — it's <|endoftext|> ok", "   ", "日本語 😀 ok. No", "All rights reserved. Licensed under CC BY-NC 4.0, licensed under the Apache License, Version 2.0.", prose(300, 1), prose(300, 1), prose(9000, 2), "x" * 5000]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3 % 29, t, "s", "n") for i, t in enumerate(TEXTS)] + [(None, "no id", None, None), (6, "twice", "s", "n"), (6, "twice", "s", "n")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_op1(spark, docs, none):
    folder = fresh_path(spark, "t")
    got = sorted(token_files.read_shards(token_files.write_shards(docs, BYTE, folder), folder).collect(), key=lambda r: r["start"])
    tokenizer, at, want = load_tokenizer(BYTE), 0, []
    for r in docs.collect():
        ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        packed = np.array(ids, "<u4").tobytes()
        want.append((r["doc_id"], len(ids), zlib.crc32(packed), packed))
    key = lambda r: (r[0] is not None, *(x or 0 for x in r))
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_crc32"], bytes(r["ids"])) for r in got), key=key) == sorted(want, key=key)
    assert [r["doc_id"] or -1 for r in got] == sorted(r["doc_id"] or -1 for r in got)
    for row in got:
        assert row["start"] == at
        at += row["n_tokens"]
    folder = fresh_path(spark, "t")
    assert token_files.read_shards(token_files.write_shards(none, BYTE, folder), folder).count() == 0


def test_op2(docs, none):
    def base(text):
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text.translate(str.maketrans(licenses._UPPER, licenses._LOWER)))
        at = sorted(i for p in licenses.BASE for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
        return len(words), len(at), at[0] if at else None, at[-1] if at else None
    want = sorted((r["doc_id"] or -1, *base(r["text"] or "")) for r in docs.collect())
    key = lambda r: tuple(-1 if x is None else x for x in r)
    got = [(r["doc_id"] or -1, r["n_words"], r["n_base"], r["first_word"], r["last_word"]) for r in licenses.scan(docs).collect()]
    assert sorted(map(key, got)) == sorted(map(key, want))
    found = licenses.scan(docs.filter("text like 'All rights%'")).first()
    assert found["base_labels"] == "cc-by,reserved" and found["labels"] == "apache-2.0,cc-by,cc-by-nc,reserved" and found["score"] == 1.0
    assert licenses.scan(none).count() == 0


def test_op2_sql(spark):
    assert oracle.difference(licenses.op2_licenses(spark, SF), licenses.op2_sql(), SF) == ""


def test_op3(spark):
    long = "ä" * 80
    rows = [(5, "u", long, 1), (2, "u\n2", long, 1), (9, None, None, 1), (7, "u", "short", 1), (8, "u", "short", 1), (None, "u", long, 1), (1, "u", "z" * 200_000, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, record_type int")
    got = {r["page_id"]: r for r in warc.read_archives(warc.write_archives(pages, fresh_path(spark, "w"))).collect()}
    assert len(got) == 7 and got[5]["refers_to"] == 2 and got[None]["refers_to"] == 2 and got[2]["record_type"] == got[7]["record_type"] == got[8]["record_type"] == "response"
    assert got[5]["payload_bytes"] == 160 and got[5]["payload_digest"] == hashlib.sha256(long.encode()).hexdigest() and got[9]["payload_bytes"] == 0
    assert warc.read_archives(warc.write_archives(pages.limit(0), fresh_path(spark, "w"))).count() == 0
    good = warc.record(1, "u", b"abc", hashlib.sha256(b"abc").hexdigest(), None)
    for bad in (good[:-1], good.replace(b"abc", b"abd"), good.replace(b"WARC/1.1", b"HTTP/1.1")):
        with pytest.raises(ValueError):
            warc.parse_record(bad)


def test_op4(docs, none):
    rows = sorted(docs.collect(), key=lambda r: (r["doc_id"] is None, -(r["doc_id"] or 0), r["text"] or ""))
    texts = [r["text"] or "" for r in rows]
    want = []
    for i, r in enumerate(rows):
        a, b = texts[i], texts[(i + 1) % len(rows)]
        cut = len(a) // 3
        want.append((r["doc_id"], len(a), hashlib.sha256((a[: len(a) - cut] + b[:cut]).encode()).hexdigest()))
    got = syncmers.edited_fingerprints(docs).collect()
    key = lambda r: (r[0] or -1, r[1], r[2])
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got), key=key) == sorted(want, key=key)
    codes = syncmers.code_points(prose(200, 5))
    at, hashes = syncmers.anchors(codes)
    far, again = syncmers.anchors(np.concatenate([codes[:7], codes]))  # anchors do not depend on what is around
    assert set(at + 7) <= set(far) and set(hashes) <= set(again) and 0.1 < len(at) / len(codes) < 0.25
    assert syncmers.edited_fingerprints(none).count() == 0


def plain_fingerprint(text):
    """Closed syncmers by their definition, one k-mer at a time."""
    mask, base = (1 << 64) - 1, int(syncmers._B)

    def mixed(x):
        return int(syncmers.mix(np.array([x], np.uint64))[0])

    def value(part):
        total = 0
        for c in part:
            total = (total * base + mixed(ord(c) + 1)) & mask
        return total

    found = set()
    for i in range(len(text) - syncmers.K + 1):
        inner = [mixed(value(text[i + j : i + j + syncmers.S])) for j in range(syncmers.K - syncmers.S + 1)]
        if min(inner) in (inner[0], inner[-1]):
            found.add(mixed(value(text[i : i + syncmers.K])) >> 32)
    if text and not found:
        found = {int.from_bytes(hashlib.sha256(text.encode("utf-32-le")).digest()[:4], "big")}
    return sorted(found)[: syncmers.SKETCH]


def test_op4_fingerprints(spark):
    """Fingerprints and both likenesses against the definition; null, empty, tied, repeated."""
    texts = [prose(60, 1), prose(60, 1), prose(90, 2) + " é日本 " + prose(20, 3), "", None, "short", "a" * 40, prose(150, 4)]
    rows = [(i if i < 7 else 3, t, "s", "n") for i, t in enumerate(texts)]
    ordered = sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (-r[0], r[1]))

    def alike(a, b):
        union = sorted({*a, *b})[: syncmers.SKETCH]
        return float(a == b) if not a or not b else len({*a} & {*b} & {*union}) / len(union)

    want = []
    for i, (doc_id, text) in enumerate(ordered):
        following = ordered[(i + 1) % len(ordered)][1]
        cut = len(text) // 3
        own, edited, other = (plain_fingerprint(t) for t in (text, text[: len(text) - cut] + following[:cut], following))
        want.append((doc_id, "".join(f"{x:08x}" for x in own), "".join(f"{x:08x}" for x in edited), alike(own, edited), alike(own, other)))
    got = syncmers.edited_fingerprints(spark.createDataFrame(rows, SCHEMA)).select("doc_id", "fingerprint", "edited_fingerprint", "near_edited", "near_next").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_op4_positions(spark, monkeypatch):
    """Anchors and their places match in blocks of any size; passages moved, cut and repeated."""
    texts = [prose(400, 6), "", "ab", "a" * 50, prose(30, 7) + " " + prose(400, 6), prose(500, 8)]
    codes = [syncmers.code_points(t) for t in texts]
    alone = [syncmers.anchors(c) for c in codes]
    for block in (1 << 19, 300):
        monkeypatch.setattr(syncmers, "BLOCK", block)
        for (at, hashes), (want_at, want) in zip(syncmers.anchored(codes), alone, strict=True):
            assert at.tolist() == want_at.tolist() and hashes.tolist() == want.tolist()

    def plain(a, b):
        places = [{}, {}]
        for seen, (at, hashes) in zip(places, (a, b), strict=True):
            for p, h in zip(at.tolist(), hashes.tolist(), strict=True):
                seen.setdefault(h, p)
        votes = {}
        for h in places[0].keys() & places[1].keys():
            votes[places[1][h] - places[0][h]] = votes.get(places[1][h] - places[0][h], 0) + 1
        best = min(votes, key=lambda d: (-votes[d], abs(d), d), default=None)
        return best, votes[best] / len(places[0]) if votes else 0.0

    for a in alone:
        for b in alone:
            assert syncmers.aligned(a, b) == plain(a, b)
    assert syncmers.aligned(alone[0], alone[4]) == (len(prose(30, 7)) + 1, 1.0) and syncmers.aligned(alone[0], alone[5])[1] < 0.1
    rows = [(i, t, "s", "n") for i, t in enumerate([*texts, None])]
    got = {r["doc_id"]: r for r in syncmers.edited_fingerprints(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[0]["offset_edited"] == 0 and 0.6 < got[0]["aligned_edited"] < 0.75 and got[6]["offset_edited"] is None and got[6]["aligned_edited"] == 0


def test_op5_parts(spark):
    """Ratios by counting, the dual's optimum by its duality gap, held-out labels unseen."""
    rng = np.random.default_rng(12)
    labels = rng.integers(0, 2, 60)
    rows = [np.unique(np.concatenate([rng.integers(0, 50, 12), rng.integers(100 * y, 100 * y + 40, 4)])) for y in labels]
    ratios = quality.log_ratios(rows, labels)
    counts = [[1 + sum(i in r for r, y in zip(rows, labels, strict=True) if y == c) for i in range(200)] for c in (0, 1)]
    sums = [sum(c) + quality.DIMENSIONS - 200 for c in counts]
    assert np.allclose(ratios[:200], [np.log(b / sums[1] / (a / sums[0])) for a, b in zip(*counts, strict=True)])
    weights = quality.dual_coordinate_descent(rows, ratios, labels)
    w = np.divide(weights, ratios, out=np.zeros_like(weights), where=ratios != 0)
    cost = quality.COST * len(labels) / (2 * np.bincount(labels, minlength=2))[labels]
    x = np.zeros((60, 200))
    for i, r in enumerate(rows):
        x[i, r] = ratios[r] / np.linalg.norm(ratios[r])
    sign = np.where(labels == 1, 1.0, -1.0)
    primal = lambda v: v @ v / 2 + (cost * np.maximum(0, 1 - sign * (x @ v))).sum()
    v, best = np.zeros(200), np.inf
    for step in range(1, 4000):  # plain subgradient descent
        active = sign * (x @ v) < 1
        v = v - (v - (cost * sign * active) @ x) / (step + 5)
        best = min(best, primal(v))
    assert primal(w[:200]) <= 1.02 * best
    rows = [(i, prose(40, i) if i % 3 else prose(30, i).upper(), "s", "n") for i in range(200)] + [(None, "x", "s", "n"), (300, None, "s", "n"), (301, "", "s", "n"), (302, prose(9000, 5), "s", "n"), (1, prose(40, 1), "s", "n")]
    docs = spark.createDataFrame(rows, SCHEMA)
    marks = docs.filter("doc_id < 200").select("doc_id", (F.col("doc_id") % 3 != 0).cast("int").alias("quality")).distinct()
    flipped = marks.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    both = marks.unionByName(marks.filter("doc_id = 5").withColumn("quality", F.lit(0)))  # disagrees: teaches nothing
    scores = [[r["s"] for r in docs.select(quality.score(spark, quality.fit(docs, m), F.col("text")).alias("s")).collect()] for m in (marks, flipped, marks.filter("doc_id != 5"), both)]
    assert scores[0] == scores[1] and scores[2] == scores[3] and all(0 <= s <= 1 for s in scores[0]) and scores[0][201] == scores[0][202]


def test_op5(spark, none):
    rows = [(i, prose(40, i) if i % 3 else " ".join(w.upper() + "!!" for w in prose(30, i).split()), "s", "n") for i in range(600)]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = docs.select("doc_id", (F.col("doc_id") % 3 != 0).cast("int").alias("quality"))
    model = quality.fit(docs, labels)
    got = docs.select("doc_id", quality.score(spark, model, F.col("text")).alias("s")).collect()
    assert all((r["s"] >= 0.7) == (r["doc_id"] % 3 != 0) for r in got)
    assert quality.keep_good(docs, labels.limit(0)).count() == 0 and quality.keep_good(none, labels).count() == 0


def test_op6(spark, none):
    """Passages of 51 words at any offset, with and without punctuation, are removed whole; the
    first stays, and so do texts without one. Columns may have the names used inside."""
    rng, rows, planted = np.random.default_rng(1), [], []
    for g in range(16):
        planted.append(prose(51, 500 + g) if g % 2 else prose(51, 500 + g).replace(".", ""))
        rows += [(len(rows) + k, f"{prose(int(rng.integers(0, 90)), 1000 + 3 * g + k)} {planted[-1]} {prose(int(rng.integers(0, 90)), 2000 + 3 * g + k)}".strip(), g, "c") for k in range(3)]
    rows += [(len(rows) + i, prose(150, 3000 + i), -1, "c") for i in range(10)] + [(None, None, -1, None), (90, "", -1, "c"), (91, prose(60, 3100) + " " + prose(60, 3100), -2, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key int, row string")
    got = {r["doc_id"]: r for r in passages.clean(docs).collect()}
    words = lambda t: [w.strip(".") for w in (t or "").split()]
    for doc_id, text, g, row in rows:
        if g == -1 or (g >= 0 and doc_id % 3 == 0):
            assert got[doc_id]["text"] == text and got[doc_id]["key"] == g and got[doc_id]["row"] == row
        elif g >= 0:
            left = words(got[doc_id]["text"]) if doc_id in got else []
            assert 51 <= len(words(text)) - len(left) <= 56 and not {*words(planted[g])} & {*left} - {w for x in (text.replace(planted[g], ""),) for w in words(x)}
    assert words(got[91]["text"]) == words(prose(60, 3100))  # a passage repeated in one text
    assert passages.clean(none).count() == 0


def test_op6_brute_force(spark):
    """Every run of 51 words that stands earlier is covered by a cut."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    cuts = {}
    for r in passages.repeated(docs).collect():
        cuts.setdefault(r["key"], []).extend((c["first"], c["end"]) for c in r["cuts"])
    rows = sorted((r["doc_id"], r["text"] or "") for r in docs.collect())
    w, seen, repeats, covered = passages.Words([t.encode() for _, t in rows]), set(), 0, 0
    for i, (doc_id, _) in enumerate(rows):
        own = w.hashes[w.first[i] : w.last[i]]
        runs = [own[k : k + 51].tobytes() for k in range(len(own) - 50)]
        again, cut = np.zeros(len(own), bool), np.zeros(len(own), bool)
        for k, run in enumerate(runs):
            again[k : k + 51] |= run in seen
        for a, b in cuts.get(doc_id, []):
            cut[a:b] = True
        seen.update(runs)
        repeats, covered = repeats + again.sum(), covered + (again & cut).sum()
    assert repeats > 500 and covered >= 0.99 * repeats


def test_op6_keeps_own_words(spark):
    """Forms filled in with words of their own, as many in each: the shared parts go, each word
    between them stays. Shorter passages are left alone, or cut where that is asked for."""
    rows = []
    for g in range(40):
        head, tail = prose(70, 7000 + g).replace(".", ""), prose(70, 7100 + g).replace(".", "")
        rows += [(2 * g + k, f"{head} {' '.join(f'own{g}x{k}n{i}' for i in range((3, 8, 14, 20, 28)[g % 5]))} {tail}", "s", "n") for k in (0, 1)]
    short = [(100 + i, f"{prose(40, 7301 + i)} {prose(20, 7300)} {prose(40, 7310 + i)}", "s", "n") for i in range(2)]
    docs = spark.createDataFrame(rows + short, SCHEMA)
    got = {r["doc_id"]: r["text"] for r in passages.clean(docs).collect()}
    for doc_id, text, *_ in rows:
        own = [w for w in text.split() if w.startswith("own")]
        assert got[doc_id].split() == (own if doc_id % 2 else text.split())
    assert [got[100], got[101]] == [short[0][1], short[1][1]]
    assert passages.merged([(0, 20), (23, 43), (60, 90)], 40) == [(0, 20), (23, 43)] and passages.merged([(0, 20), (20, 30)], 30) == [(0, 30)]


HAN = ["".join(chr(0x4E00 + int(c)) for c in np.random.default_rng(n).integers(0, 3000, 25)) + "。" for n in range(80)]


def test_without_blanks(spark):
    """Chinese text: each character is a word, so one changed character among 600 makes a near copy,
    and a shared passage is cut."""
    a, b = "".join(HAN[:24]), "".join(HAN[24:48])
    rows = [(1, a, "s", "n"), (2, a.replace(HAN[3][5], "龥", 1), "s", "n"), (3, b, "s", "n"), (4, "".join(HAN[48:54] + HAN[24:30] + HAN[54:60]), "s", "n")]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = {r["doc_id"]: r["class_id"] for r in bagminhash.near_duplicates(docs).collect()}
    assert found == {1: 1, 2: 1, 3: 3, 4: 4}
    left = {r["doc_id"]: r["text"] for r in passages.clean(docs).collect()}
    assert left[1] == a and left[3] == b and left[4] == "".join(HAN[48:60]) and len(left.get(2, "")) < 30


def test_word_spans():
    from lakestrata.llm.textvec import word_spans

    for text in ("ab c-d\n", "é日本 x日y。z", "。", "日", "กขx", "a、b！c", "한국 어", "", "日" * 5):
        data = np.frombuffer(text.encode(), np.uint8)
        got = [text.encode()[a:b].decode() for a, b in zip(*word_spans(data), strict=True)]
        assert got == re.findall(r"[\u3005-\u3007\u3040-\u30ff\u4e00-\u9fff\u0e00-\u0eff]|[0-9A-Za-z\u0080-\u0dff\uac00-\ud7a3]+", text)


def test_op6_frequent_line(spark):
    """Paragraphs that share a long line, and near copies of them: every link is found."""
    rng, line = np.random.default_rng(61), " ".join(VOCABULARY[:18]) + "."
    tails = [rng.choice(VOCABULARY, 8).tolist() for _ in range(60)]
    rows = [(i, f"{line} {' '.join(w)}.", "s", "n") for i, w in enumerate(tails)]
    rows += [(100 + i, f"{line} {' '.join([*w[:7], f'edit{i}'])}.", "s", "n") for i, w in enumerate(tails)]
    got = {r["key"]: r["start"]["key"] for r in passages.repeated_places(spark.createDataFrame(rows, SCHEMA)).filter("not seed").collect()}
    assert got == {100 + i: i for i in range(60)}


def unpacked(pieces, docs, path):
    """Checks that pieces hold each id of docs once, in order, and windows without gaps;
    returns the lengths of sequences."""
    tokenizer, by_doc, windows = load_tokenizer(path), {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        windows.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    texts = {}
    for r in docs:
        texts.setdefault(r["doc_id"], []).append(np.array([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4"))
    assert texts.keys() == by_doc.keys()
    for doc_id, all_ids in texts.items():
        assert sum(p["length"] for p in by_doc[doc_id]) == sum(map(len, all_ids))
        for p in by_doc[doc_id]:
            assert any(len(x) == p["doc_tokens"] and zlib.crc32(x[p["start"] : p["start"] + p["length"]].tobytes()) == p["ids_crc32"] for x in all_ids)
        if len(all_ids) == 1:
            ends = sorted((p["start"], p["start"] + p["length"]) for p in by_doc[doc_id])
            assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:], strict=False))
    sizes = []
    for parts in windows.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        sizes.append(at)
    assert max(sizes) <= packing.WINDOW
    return sizes


def test_op7(spark, docs, none):
    pieces = packing.pack(docs, WORD).collect()
    unpacked(pieces, docs.collect(), WORD)
    assert packing.pack(none, WORD).count() == 0
    # one range: no sequence but the last is far from full, and the order of doc_id is kept
    rows = [(i, prose(int(n), 900 + i) + ("\x1c" if i % 5 == 0 else ""), "s", "n") for i, n in enumerate(np.random.default_rng(8).integers(1, 2500, 60))]
    rows.append((60, "word " * 12_000, "s", "n"))  # no sentence end
    packer, (ids, lengths, *stops) = packing.Packer(), word_encoder(WORD)(pa.array([r[1] for r in rows]))
    bounds, got = np.concatenate([[0], np.cumsum(lengths)]), []
    for lo in range(0, len(rows), 7):  # several slices give the cuts of one
        hi = min(lo + 7, len(rows))
        inside = (stops[1] >= lo) & (stops[1] < hi)
        if columns := packer.add(list(range(lo, hi)), ids[bounds[lo] : bounds[hi]], lengths[lo:hi], stops[0][inside], stops[1][inside] - lo):
            got.append(columns)
    got.append(packer.give(last=True))
    whole = packing.Packer()
    both = [c for c in (whole.add(list(range(len(rows))), ids, lengths, *stops), whole.give(last=True)) if c]
    parts = [np.concatenate([np.asarray(c[k]) for c in got]) for k in range(7)]
    once = [np.concatenate([np.asarray(c[k]) for c in both]) for k in range(7)]
    assert all((a == b).all() for a, b in zip(parts, once, strict=True))
    names = [x.split()[0] for x in packing.PIECES.split(", ")]
    pieces = [dict(zip(names, map(int, row), strict=True)) for row in zip(*parts, strict=True)]
    sizes = unpacked(pieces, [{"doc_id": r[0], "text": r[1]} for r in rows], WORD)
    assert [p["doc_id"] for p in pieces] == sorted(p["doc_id"] for p in pieces) and len(sizes) <= sum(sizes) / packing.WINDOW + 2


def test_op7_cuts():
    """Windows of a stream that comes in parts, against plain quadratic programming."""
    rng, window = np.random.default_rng(3), 16
    for _ in range(100):
        at, penalty = [0, *np.cumsum(rng.integers(1, 9, 200)).tolist()], [0, *rng.choice([0, 2, 9], 200).tolist()]
        cutter, cuts = packing.Cutter(window), []
        for lo in range(1, 201, 37):
            cutter.add(at[lo : min(lo + 37, 201)], penalty[lo : min(lo + 37, 201)])
            cuts += cutter.give(last=lo + 37 > 200)
        best = [0] + [10**9] * 200
        for j in range(1, 201):
            for i in range(j):
                if at[j] - at[i] <= window:
                    best[j] = min(best[j], best[i] + window - (at[j] - at[i]) + penalty[j])
        edges, of = [0, *cuts], dict(zip(at, penalty, strict=True))
        assert edges[-1] == at[-1] and sum(window - (b - a) + of[b] for a, b in zip(edges, edges[1:], strict=False)) == best[-1]


def test_encoders_against_library():
    """Ids and sentence ends of awkward strings, as the tokenizers library gives them."""
    parts = ["a", "B", "é", "İ", "ß", "word", "Word", "don't", "'s", ",", ".", "...", " ", "  ", "\n", "\n\n", "\t", "\x01", "\x1c", "\x85", "\xa0", "　", "日本", "😀", "<|endoftext|>", "1", "23", "-", "_", "x,", "y.", "\r\n", "Ġ", "ŉ", "ǅ", "ſ", "ﬁ", " a", " word"]
    texts = ["", *("".join(RNG.choice(parts, RNG.integers(0, 14))) for _ in range(3000))]
    for path, encode in ((BYTE, byte_level_encoder(BYTE)), (WORD, word_encoder(WORD))):
        ids, lengths, *_ = encode(pa.array(texts))
        want = [e.ids for e in load_tokenizer(path).encode_batch(texts, add_special_tokens=False)]
        assert [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])] == want


def test_op8(spark, docs, none):
    base = prose(400, 9)
    near = base.replace(base.split()[200], "changed", 1)
    rows = [(1, base, "s", "n"), (2, near, "s", "n"), (3, base.upper(), "s", "n"), (4, prose(400, 10), "s", "n"), (5, "", "s", "n"), (6, None, "s", "n"), (None, base, "s", "n"), (7, "two words", "s", "n"), (7, "two words", "s", "n")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r["doc_id"]: r["class_id"] for r in bagminhash.near_duplicates(docs).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, None: None, 7: 7}
    kept = bagminhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "4", "5", "6", "7", "None"]
    assert bagminhash.keep_one(none).count() == 0
    items, error = RNG.integers(1, 1 << 62, 80).astype(np.uint64), []
    for _ in range(40):
        a, b = RNG.integers(0, 6, 80), RNG.integers(0, 6, 80)
        b = np.where(RNG.random(80) < 0.7, a, b)
        s = [bagminhash.signatures(np.zeros((w > 0).sum(), int), items[w > 0], w[w > 0], 1)[0] for w in (a, b)]
        error.append((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(error)) < 0.03


def brute_classes(sets, similarity):
    """Smallest key of each key's component of the links between all pairs of sets."""
    root = {k: k for k in sets}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(sets)
    for n, i in enumerate(keys):
        for j in keys[n + 1 :]:
            if len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return {k: top(k) for k in keys}


@pytest.mark.parametrize("kind", [linking.WEIGHTED, linking.PLAIN])
def test_buckets_lose_no_link(spark, kind):
    """Sets of one template (0.74 alike, no links) with planted near copies (over 0.8), in a
    small and in a large bucket, against all pairs."""
    rng, sets, bands = np.random.default_rng(41), {}, []
    for key, size in ((1, 8), (2, 60)):
        common = [*range(key * 10**6, key * 10**6 + 170)]
        for i in range(0, size, 2):
            own = [*common, *rng.integers(10**8, 10**12, 30).tolist()]
            edited = [x for x in own if x not in rng.choice(own, 12, replace=False)] + rng.integers(10**8, 10**12, 8).tolist()
            sets |= {key * 1000 + i: own, key * 1000 + i + 1: edited}
        bands += [(key, n) for n in sets if n // 1000 == key]
    pack = lambda x: linking.pack_set(np.sort(x).astype(np.uint64), np.ones(len(x), int)) if kind is linking.WEIGHTED else np.sort(x).astype("<u8").tobytes()
    packed = spark.createDataFrame([(n, pack(x)) for n, x in sets.items()], "node long, items binary")
    want = brute_classes({n: set(x) for n, x in sets.items()}, 0.8)
    assert len(set(want.values())) == len(sets) // 2
    found = linking.classes(spark.createDataFrame(bands, "key long, node long"), lambda wanted: packed.join(wanted, "node"), 0.8, kind)
    assert {r["node"]: r["root"] for r in found.collect()} == want


def test_op9(spark):
    vectors = RNG.standard_normal((600, 24)).astype(np.float32)
    rows = [(i, v.tolist(), "x") for i, v in enumerate(vectors)] + [(1000, None, "x"), (1001, [0.0] * 24, "x"), (1002, [float("nan")] * 24, "x"), (1003, [None] * 24, "x"), (1004, [1.0, 2.0], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank string")
    got = onebit.search(df, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect()
    hit = total = 0
    for q in range(0, 600, 100):
        apart = np.sqrt(((vectors.astype(np.float64) - vectors[q].astype(np.float64)) ** 2).sum(axis=1))
        want = [i for i in np.lexsort((np.arange(600), apart)) if i != q][:10]
        mine = [r for r in got if r["query_id"] == q]
        hit, total = hit + len({r["vec_id"] for r in mine} & set(want)), total + 10
        assert all(abs(r["score"] - apart[r["vec_id"]]) < 1e-12 for r in mine)
    assert hit / total >= 0.98
    assert onebit.search(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_op9_repeated_queries(spark):
    """Copies of a query row, and rows of one id with other vectors, against brute force."""
    vectors = np.random.default_rng(9).standard_normal((400, 16))
    ids = [*range(400), *[100] * 12, 200, 200, 7]
    vectors = np.concatenate([vectors, np.repeat(vectors[100:101], 12, 0), vectors[201:202] + 0.1, vectors[300:301] + 0.1, vectors[7:8]])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, vectors, strict=True)], "vec_id long, embedding array<double>").coalesce(1)
    got = onebit.search(df, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect()
    ids = np.array(ids)
    for q in (0, 100, 200, 300):
        apart = np.min([np.sqrt(((vectors - v) ** 2).sum(axis=1)) for v in vectors[ids == q]], axis=0)
        want = [ids[i] for i in np.lexsort((ids, apart)) if ids[i] != q][:10]
        assert [(r["vec_id"], r["rank"]) for r in got if r["query_id"] == q] == [(i, n + 1) for n, i in enumerate(want)]


def test_op9_grid(spark):
    """Several groups of queries and blocks of two lengths, null ids and tied copies, against
    brute force; no copies of the queries are broadcast, and each cell holds few of them."""
    rng = np.random.default_rng(19)
    vectors = rng.standard_normal((5000, 8)).astype(np.float32)
    vectors[4000:] = vectors[:1000]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(None, vectors[0].tolist())] + [(i, [float(i), 1.0]) for i in range(5000, 5300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = onebit.search(df, F.col("vec_id") % 20 == 0, held=4000)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "Join" not in plan
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert len(got) == 265
    for q, own in got.items():
        ids = np.arange(5000) if q < 5000 else np.arange(5000, 5300)
        apart = np.sqrt(((vectors.astype(np.float64) - vectors[q].astype(np.float64)) ** 2).sum(axis=1)) if q < 5000 else np.abs(ids - q).astype(float)
        want = [(int(ids[i]), apart[i]) for i in np.lexsort((ids, apart)) if ids[i] != q][:10]
        assert own == want
    for tasks, size, asked in ((600, 10**10, 10**8), (12, 10**7, 10**5), (16, 10**9, 10**9), (4, 10**6, 10**9)):
        groups, by = onebit.grid(tasks, size, asked, 16 << 20)
        assert asked / by <= 16 << 20 and groups * by <= max(tasks, by)
    groups, by = onebit.grid(600, 10**10, 10**8, 16 << 20)  # copies of both sides stay a few times the input
    assert by * 10**10 + groups * 10**8 < 10 * 10**10


def test_op10(docs, none):
    tokenizer = load_tokenizer(BYTE)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    want = []
    for r in docs.collect():
        ids = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids
        want.append((r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, bpe.encode_digests(docs, BYTE).collect()), key=key) == sorted(want, key=key)
    assert bpe.encode_digests(none, BYTE).count() == 0


def test_pipeline_stages(spark):
    """Near-duplicates of the supplied documents against all pairs, the stages' columns with
    names used inside, null, empty, long and repeated rows, and empty tables."""
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sets = {}
    for r in docs.collect():
        owner, items, weights, counts = bagminhash.multisets([(r["text"] or "").encode()])
        if counts[0]:
            sets[r["doc_id"]] = {(x, i) for x, n in zip(items.tolist(), weights.tolist(), strict=True) for i in range(n)}
    root = brute_classes(sets, bagminhash.SIMILARITY)
    kept = {r["doc_id"] for r in stages["near_duplicates"](spark, docs, SF).select("doc_id").collect()}
    assert kept == {r["doc_id"] for r in docs.collect()} - {k for k, v in root.items() if k != v}
    odd = [(1, prose(200, 1), "a", "b"), (1, prose(200, 1), "a", "b"), (2, None, None, None), (3, "", "a", "b"), (None, prose(200, 1), "a", "b"), (4, prose(9000, 2), "a", "b"), (5, prose(200, 1), "a", "b")]
    for names in (("key", "content"), ("row", "cuts"), ("stays", "likely"), ("_place", "node")):
        table = spark.createDataFrame(odd, f"doc_id long, text string, {names[0]} string, {names[1]} string")
        got = stages["near_duplicates"](spark, table, SF)
        assert got.columns == table.columns and sorted(map(str, (r[0] for r in got.collect()))) == ["1", "2", "3", "4", "None"]
        if names[0] == "key":
            got = stages["passages"](spark, table, SF)
            assert got.columns == table.columns and sorted(map(str, (r[0] for r in got.collect()))) == ["2", "3", "4", "None"]
            unpacked(stages["packing"](spark, table, SF).collect(), table.collect(), WORD)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0, name


def test_quality_stage(spark):
    """Null, empty, long, repeated and tied rows, null ids, clashing columns: what stays is what
    the model's own scores of the plain texts say."""
    import corpus_pipeline

    stage, labels = dict(corpus_pipeline.STAGES)["quality"], spark.read.parquet(f"{SF}/labels.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", F.lit("x").alias("score"), F.lit(1).alias("quality"), F.lit(None).cast("int").alias("grams"))
    odd = spark.createDataFrame([(900_001, None), (900_002, ""), (None, prose(80, 1)), (900_003, prose(9000, 2)), (900_004, "$$$ ### %%%"), (900_004, "$$$ ### %%%")], "doc_id long, text string")
    table = docs.unionByName(odd, allowMissingColumns=True).unionByName(docs.filter("doc_id % 7 = 0"))
    model = quality.fit(table, labels)
    rows = table.collect()
    scores = model.scores([(r["text"] or "").encode() for r in rows])
    key = lambda r: tuple(map(str, r))
    got = stage(spark, table, SF)
    assert got.columns == table.columns and sorted(map(key, got.collect())) == sorted(key(r) for r, x in zip(rows, scores, strict=True) if x >= quality.THRESHOLD)


def test_pipeline(spark):
    """Stage by stage: what is rejected goes and the rest is as it was, of texts with passages
    words are left out and none moved, packing holds each id once; run() gives the same."""
    import corpus_pipeline

    docs, steps = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        steps[name] = (docs, docs := corpus_pipeline.materialise(stage(spark, docs, SF), f"test-{name}"))
    for name in ("quality", "near_duplicates"):
        before, after = steps[name]
        assert after.columns == before.columns and after.join(before, before.columns, "left_anti").count() == 0 and 0 < after.count() < before.count()
    before, after = (sorted((r["doc_id"], r["text"] or "", r["n_chars"]) for r in df.collect()) for df in steps["passages"])
    left, lost = {i: (t, n) for i, t, n in after}, 0
    words = {i: re.findall("[0-9A-Za-z\x80-\U0010ffff]+", t) for i, t, _ in before}
    for i, own in words.items():
        text, n = left.get(i, ("", 0))
        assert n == len(text)
        kept, at = re.findall("[0-9A-Za-z\x80-\U0010ffff]+", text), 0
        for w in kept:  # what is left stands in the same order
            at = own.index(w, at) + 1
        lost += len(own) - len(kept)
    assert set(left) <= set(words) and lost > 0
    pieces = steps["packing"][1].collect()
    unpacked(pieces, steps["passages"][1].collect(), WORD)
    again = corpus_pipeline.run(spark, SF).collect()
    plain = lambda rows: sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    assert plain(again) == plain(pieces) and len(corpus_pipeline.STAGES) == 4


def test_stages_begin_light(spark, monkeypatch):
    """Before each stage the executors' heaps are collected in full (here the driver's JVM is one),
    and only then does the stage's own work begin."""
    import corpus_pipeline

    beans = [b for b in spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans() if "Old" in b.getName() or "MarkSweep" in b.getName()]
    count = lambda: sum(b.getCollectionCount() for b in beans)
    modules = {"quality": ("quality", "keep_good"), "near_duplicates": ("bagminhash", "keep_one"), "passages": ("passages", "clean"), "packing": ("packing", "pack")}
    for name, stage in corpus_pipeline.STAGES:
        module, function = modules[name]
        full, at_work = count(), []
        monkeypatch.setattr(getattr(corpus_pipeline, module), function, lambda *args: at_work.append(count()))
        stage(spark, None, SF)
        assert at_work[0] > full


def test_large_steps_begin_light(spark, monkeypatch):
    """The executors' heaps are collected between the large steps of passages and of
    near-duplicates too, not only before a stage."""
    from lakestrata.llm import common

    done, collected = [], common.lighten
    monkeypatch.setattr(common, "lighten", lambda s: (collected(s), done.append("light")))
    for module in (passages, bagminhash, linking):
        kept = module.materialise
        monkeypatch.setattr(module, "materialise", lambda df, name, kept=kept: (kept(df, name), done.append(name))[0])
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(200)
    begun = passages._occurrences
    monkeypatch.setattr(passages, "_occurrences", lambda docs: (begun(docs), done.append("occurrences"))[0])
    passages.clean(docs)
    bagminhash.keep_one(docs)
    for name in ("occurrences", "buckets", "repeated-paragraphs", "repeated-seeds", "contexts", "repeated", "nodes", "told"):
        assert done[done.index(name) + 1] == "light", name


def test_release_collects_once(spark, monkeypatch):
    """release() collects the driver's JVM once, and then what Python has let go of is gone there."""
    from lakestrata.llm import common

    monkeypatch.setattr(common, "lighten", lambda s: None)
    jvm = spark.sparkContext._jvm
    beans = [b for b in jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans() if "Old" in b.getName() or "MarkSweep" in b.getName()]
    count = lambda: sum(b.getCollectionCount() for b in beans)
    held = jvm.java.util.ArrayList()
    known = jvm.java.lang.ref.WeakReference(held)
    del held
    full = count()
    common.release(spark)
    assert known.get() is None and count() == full + 1
