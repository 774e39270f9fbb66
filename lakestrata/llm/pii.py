"""Operator 12: personal data by fixed patterns and by a trained tagger.

The patterns find the base spans of whole texts. The tagger, a character-level
bidirectional LSTM with CRF transitions (tagger.py), finds what the patterns miss: mail
addresses with "[at]" or blanks, addresses of machines with "[.]", cards and phone numbers
with other separators. It learns from labelled spans: the base spans of the corpus in what
surrounds them, and the same spans rewritten in such ways, FIT_WINDOWS windows for each
kind at most, those of the smallest hash.

A text is read in windows of WIDTH characters, one from every STRIDE-th. Windows without a
digit, "@", "[" or "(" are left out: no span that passes the checks is without one. Labels
of a window are its likeliest path. Windows are reconciled over the whole text: parts of one
span at the edges of neighbouring windows are joined, what overlaps a base span goes, what
is no address or number once its separators are made plain goes too, and of the others the
set without overlaps that has the greatest sum of marginal probabilities stays.

Defined results. Null or empty text: no spans, the hash of the empty string. Null or
repeated doc_ids: one row for each row. Ties among sets go to the earlier span. Spans longer
than a window are joined of parts; base spans have any length. A corpus without base spans:
the tagger learns from made-up spans alone. Empty table: no rows. Columns other than doc_id
and text are not read.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator
from functools import reduce
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  as pa.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batched, materialise, table
from .tagger import Tagger

KINDS = ("email", "ip", "card", "phone")
# The base patterns, written so that no text takes more than linear time. A
# mail address is found by its "@" and what is behind it; see _emails().
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@\[(]")
_DIGITS = re.compile(r"[^0-9]")

WIDTH, STRIDE = 96, 48
FIT_WINDOWS = 200
STEPS = 160
HIDDEN = 24
#: Classes of characters: 1 beyond ASCII, 2 letters but for those of "at", "dot" and "com", then
#: the others, digits as one.
_OWN = "adtocm0123456789"
CLASS = np.full(129, 1, np.uint8)
_others = [c for c in range(128) if not chr(c).isalnum()]
for _i, _c in enumerate(_others):
    CLASS[_c] = 4 + _i
for _c in range(128):
    if chr(_c).isalpha():
        CLASS[_c] = 4 + len(_others) + _OWN.index(chr(_c).lower()) if chr(_c).lower() in _OWN else 2
    elif chr(_c).isdigit():
        CLASS[_c] = 3
CLASSES = 4 + len(_others) + 6

Span = tuple[int, int, int]  # kind, start, end


def classes_of(text: str, step: int = 1 << 20) -> np.ndarray:
    """Class of each character, one byte for each; step characters at a time."""
    codes = lambda i: np.frombuffer(text[i : i + step].encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.concatenate([CLASS[:0], *(CLASS[np.minimum(codes(i), 128)] for i in range(0, len(text), step))])


# --- base spans ----------------------------------------------------------------------------
def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    free = 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            yield start, m.end()
            free = m.end()


def base_spans(text: str) -> list[Span]:
    """All base spans, by start and then kind."""
    if not _TRIGGER.search(text):
        return []
    found = [(0, a, b) for a, b in _emails(text)] if "@" in text else []
    found += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p) < 256 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(digits := _DIGITS.sub("", m[0])) <= 19 and luhn(digits):
            found.append((2, m.start(), m.end()))
    if "+" in text:
        found += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 10 <= len(_DIGITS.sub("", m[0])) <= 15]
    return sorted(found, key=lambda s: (s[1], s[0]))


# --- what a proposed span has to be, once its separators are plain -----------------------------
_AT = re.compile(r"\s*(?:\[at\]|\(at\)|@)\s*", re.I)
_DOT = re.compile(r"\s*(?:\[dot\]|\(dot\)|\[\.\]|\(\.\)|\.)\s*", re.I)
_PLAIN_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_PLAIN_IP = re.compile(r"[0-9]{1,3}(\.[0-9]{1,3}){3}")
_NUMBER = re.compile(r"[0-9][0-9 ./_-]*[0-9]")
_CALL = re.compile(r"(?:\+|00 ?)?[(]?[0-9][0-9 ()./-]*[0-9]")


def plausible(kind: int, text: str) -> bool:
    if kind == 0:
        return bool(_PLAIN_EMAIL.fullmatch(_DOT.sub(".", _AT.sub("@", text))))
    if kind == 1:
        plain = _DOT.sub(".", text)
        return bool(_PLAIN_IP.fullmatch(plain)) and all(int(p) < 256 for p in plain.split("."))
    digits = _DIGITS.sub("", text)
    if kind == 2:
        return bool(_NUMBER.fullmatch(text)) and 14 <= len(digits) <= 19 and luhn(digits)
    return bool(_CALL.fullmatch(text)) and 10 <= len(digits) <= 15 and len(re.findall("[0-9]+", text)) >= 3


# --- labelled windows ----------------------------------------------------------------------------
def rewritten(kind: int, span: str, rng: np.random.Generator) -> str:
    """The same data in a way that the patterns may miss; the fourth time as it is."""
    pick = lambda *ways: ways[int(rng.integers(len(ways)))]
    if rng.integers(4) == 0:
        return span
    if kind == 0:
        at, dot = pick(("[at]", "."), (" [at] ", "."), ("(at)", "."), (" (at) ", "."), (" @ ", "."), (" @ ", " . "), (" [at] ", " [dot] "), ("@", "[dot]"), ("@", " . "))
        local, _, domain = span.rpartition("@")
        return local + at + domain.replace(".", dot)
    if kind == 1:
        return span.replace(".", pick("[.]", " . ", ". ", "(.)", " [.] "))
    digits = _DIGITS.sub("", span)
    if kind == 2:
        sep = pick(".", "/", "  ", " - ", "_", " / ", " . ")
        return sep.join(digits[i : i + 4] for i in range(0, len(digits), 4))
    head, rest = digits[:-10] or "1", digits[-10:]
    sep = pick(" ", "-", ".", "/")
    return pick(f"({rest[:3]}) {rest[3:6]}{sep}{rest[6:]}", f"{rest[:3]}{sep}{rest[3:6]}{sep}{rest[6:]}", f"+{head}/{rest[:3]}/{rest[3:6]}/{rest[6:]}", f"00{head} {rest[:3]} {rest[3:6]}{sep}{rest[6:]}", f"{head}{sep}({rest[:3]}){sep}{rest[3:6]}{sep}{rest[6:]}")


def made_up(kind: int, rng: np.random.Generator) -> str:
    letters = lambda n: "".join(chr(97 + int(x)) for x in rng.integers(0, 26, n))
    digits = lambda n: "".join(str(int(x)) for x in rng.integers(0, 10, n))
    if kind == 0:
        return f"{letters(int(rng.integers(2, 9)))}{['', '.', '_'][int(rng.integers(3))]}{digits(int(rng.integers(0, 3)))}{letters(3)}@{letters(int(rng.integers(3, 9)))}.{['com', 'org', 'net', 'de', 'example.com'][int(rng.integers(5))]}"
    if kind == 1:
        return ".".join(str(int(x)) for x in rng.integers(0, 256, 4))
    if kind == 2:
        body = digits(int(rng.integers(14, 17)) - 1)
        number = next(body + str(d) for d in range(10) if luhn(body + str(d)))
        return number if rng.integers(2) else "-".join(number[i : i + 4] for i in range(0, len(number), 4))
    return f"+{1 + int(rng.integers(9))} ({digits(3)}) {digits(3)}-{digits(4)}"


_WINDOW = "kind int, hash binary, left string, span string, right string"


def _smallest(rows: list[tuple], n: int) -> list[tuple]:
    """The n rows of the smallest hashes of each kind; equal rows count once."""
    own: dict[int, list[tuple]] = {}
    for row in sorted(set(rows)):
        own.setdefault(row[0], []).append(row)
    return [row for kind in own.values() for row in kind[:n]]


def labelled(docs: DataFrame, per_kind: int = FIT_WINDOWS) -> DataFrame:
    """kind, left, span, right: base spans in what surrounds them, and, as kind -1, places with a
    digit or sign that no base span touches; of each kind the per_kind windows of the smallest
    hash. One pass: a task hands on no more than per_kind windows of a kind."""

    def windows(text: str) -> Iterator[tuple]:
        spans = base_spans(text)
        for k, a, b in spans:
            if b - a <= WIDTH // 2:
                yield k, text[max(0, a - WIDTH) : a], text[a:b], text[b : b + WIDTH]
        ends, last = [b for _, _, b in spans], -WIDTH
        for m in _TRIGGER.finditer(text):
            at = m.start()
            i = bisect.bisect_left(ends, at - WIDTH)
            if at >= last + WIDTH and (i == len(spans) or spans[i][1] > at + WIDTH):
                yield -1, text[max(0, at - WIDTH) : at], text[at : at + 1], text[at + 1 : at + WIDTH]
                last = at

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batched(batches, "text"):
            for text in batch.column("text").to_pylist():
                rows += [(k, hashlib.sha256("\n".join(parts).encode("utf-8", "surrogatepass")).digest(), *parts) for k, *parts in windows(text)]
            if len(rows) > 20 * per_kind:
                rows = _smallest(rows, per_kind)
        rows = _smallest(rows, per_kind)
        kinds = [pa.int32(), pa.binary(), pa.string(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["kind", "hash", "left", "span", "right"])

    found = materialise(docs.filter(F.col("text").rlike(r"[0-9@]")).select("text").mapInArrow(run, _WINDOW), "windows").distinct()
    kinds = [found.filter(F.col("kind") == k).orderBy("hash").limit(per_kind).drop("hash") for k in range(-1, len(KINDS))]
    return reduce(DataFrame.unionByName, kinds)


def training_set(windows: list[tuple[int, str, str, str]], seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Classes and labels (windows, WIDTH). Each labelled span stands once as it is and once
    rewritten; with them made-up spans, and numbers that are none, in the same surroundings."""
    rng, rows = np.random.default_rng(seed), []
    around = [(left, right) for _, left, _, right in windows] or [("the ", " end"), ("", ""), ("x: ", ".")]
    for kind, left, span, right in windows:
        if kind < 0:
            rows.append((left, [(-1, span)], right))
        else:
            rows += [(left, [(kind, s)], right) for s in (span, rewritten(kind, span, rng))]
    for i in range(4 * 200):
        left, right = around[int(rng.integers(len(around)))]
        rows.append((left[-int(rng.integers(1, WIDTH)) :], [(i % 4, rewritten(i % 4, made_up(i % 4, rng), rng))], " " + right))
    for i in range(300):
        left, right = around[int(rng.integers(len(around)))]
        number = "".join(str(int(x)) for x in rng.integers(0, 10, int(rng.integers(1, 9))))
        rows.append((left + " ", [(-1, [number, f"{number}.{number[:2]}", f"(see {number})", f"[{number}]", f"{number}, {number[:3]}", f"{number}@", f"v{number}.1.2"][i % 7])], " " + right))
    x, y = np.zeros((len(rows), WIDTH), np.uint8), np.zeros((len(rows), WIDTH), np.uint8)
    for i, (left, middle, right) in enumerate(rows):
        kind, span = middle[0]
        before = int(rng.integers(0, max(1, min(len(left), WIDTH - len(span)) + 1)))
        left = left[len(left) - before :] if before else ""
        # what stands around may hold other spans, which are labelled as well
        text = left + span + right
        codes = classes_of(text)[:WIDTH]
        x[i, : len(codes)] = codes
        for k, a, b in [*base_spans(text), *([(kind, before, before + len(span))] if kind >= 0 else [])]:
            y[i, a:b] = 2 * k + 2
            if a < WIDTH:
                y[i, a] = 2 * k + 1
    return x, y


def fit(docs: DataFrame, per_kind: int = FIT_WINDOWS, steps: int = STEPS) -> Tagger:
    """The tagger, trained on labelled(docs): 5 per_kind windows at most come to the driver."""
    found = [tuple(r) for r in labelled(docs, per_kind).collect()]
    x, y = training_set(sorted(found))
    model = Tagger(CLASSES, len(KINDS), HIDDEN)
    model.fit(x, y, steps)
    return model


# --- reading -------------------------------------------------------------------------------------
Proposed = tuple[int, int, int, float, bool]  # kind, start, end, score, touches an edge


def spans_of(path: np.ndarray, marginal: np.ndarray) -> list[tuple[int, int, int, float]]:
    """(kind, start, end, sum of marginals) of the spans in one window's labels."""
    out, at, n = [], 0, len(path)
    chosen = marginal[np.arange(n), path]
    for at in np.flatnonzero((path % 2 == 1) & (path > 0)).tolist():
        end = at + 1
        while end < n and path[end] == path[at] + 1:
            end += 1
        out.append(((int(path[at]) - 1) // 2, at, end, float(chosen[at:end].sum())))
    return out


def reconciled(text: str, base: list[Span], proposed: list[Proposed]) -> list[Span]:
    """Spans beyond the base ones; see the module's head."""
    joined: list[list] = []
    for kind, a, b, score, edge in sorted(proposed, key=lambda s: (s[0], s[1], s[2])):
        last = joined[-1] if joined else None
        if last and last[0] == kind and a <= last[2] and (edge or last[4]):
            last[2], last[3], last[4] = max(last[2], b), max(last[3], score), edge if b >= last[2] else last[4]
        else:
            joined.append([kind, a, b, score, edge])
    taken = sorted((a, b) for _, a, b in base)
    furthest = list(accumulate((b for _, b in taken), max))
    free = []
    for kind, a, b, score, _ in joined:
        while b > a and text[b - 1] in " .,;:":
            b -= 1
        while a < b and text[a] == " ":
            a += 1
        before = bisect.bisect_left(taken, (b, 0))
        if (not before or furthest[before - 1] <= a) and plausible(kind, text[a:b]):
            free.append((b, a, kind, score))
    free = sorted(set(free))
    ends, best = [s[0] for s in free], [(0.0, ())]
    for i, (b, a, kind, score) in enumerate(free):
        without, kept = best[-1], best[bisect.bisect_right(ends, a, 0, i)]
        best.append((kept[0] + score, (kept[1], (kind, a, b))) if kept[0] + score > without[0] else without)
    out, chain = [], best[-1][1]
    while chain:
        chain, span = chain
        out.append(span)
    return out[::-1]


def proposals(model: Tagger, texts: list[str]) -> list[list[Proposed]]:
    """What the tagger proposes for each text, over all its windows with a trigger."""
    where, rows = [], []
    for i, text in enumerate(texts):
        if not _TRIGGER.search(text):
            continue
        codes = classes_of(text)
        marks = np.flatnonzero(np.isin(codes, _TRIGGERS))
        first = np.unique(np.concatenate([marks // STRIDE - d for d in range(WIDTH // STRIDE)]))
        last = max(0, -(-(len(codes) - WIDTH) // STRIDE))
        for s in first[(first >= 0) & (first <= last)].tolist():
            where.append((i, s * STRIDE))
            rows.append(codes[s * STRIDE : s * STRIDE + WIDTH])
    out: list[list[Proposed]] = [[] for _ in texts]
    for at in range(0, len(rows), 1024):
        own = rows[at : at + 1024]
        x = np.zeros((WIDTH, len(own)), np.uint8)
        for j, codes in enumerate(own):
            x[: len(codes), j] = codes
        e, _ = model.emissions(x)
        path = model.best(e)
        hit = np.flatnonzero(path.any(0))
        if not len(hit):
            continue
        marginal = model.marginals(e[:, hit])
        for h, j in enumerate(hit.tolist()):
            i, start = where[at + j]
            n = len(own[j])
            for kind, a, b, score in spans_of(path[:n, j], marginal[:n, h]):
                edge = (a == 0 and start > 0) or (b == n and start + n < len(texts[i]))
                out[i].append((kind, start + a, start + b, score, edge))
    return out


_TRIGGERS = np.unique(CLASS[[ord(c) for c in "0@[("]])
FOUND = "doc_id long, base array<struct<kind:int,start:int,end:int>>, added array<struct<kind:int,start:int,end:int>>"


def find(docs: DataFrame, model: Tagger) -> DataFrame:
    """doc_id, base and added spans of every row: kind (a place in KINDS), start, end."""
    kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
    named = lambda spans: [{"kind": k, "start": a, "end": b} for k, a, b in spans]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batched(batches, "text"):
            texts = batch.column("text").to_pylist()
            base = [base_spans(t) for t in texts]
            added = [reconciled(*x) for x in zip(texts, base, proposals(model, texts), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(map(named, base), kind), pa.array(map(named, added), kind)], ["doc_id", "base", "added"])

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, FOUND)


def digests(found: DataFrame) -> DataFrame:
    """Counts of base spans by kind, their digest, and all spans."""
    names = F.array(*[F.lit(k) for k in KINDS])
    by_place = lambda a, b: F.when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1)).when(a["kind"] != b["kind"], F.when(a["kind"] < b["kind"], -1).otherwise(1)).otherwise(F.when(a["end"] < b["end"], -1).when(a["end"] > b["end"], 1).otherwise(0))
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return found.select("doc_id", *[n(k) for k in range(len(KINDS))], F.sha2(said(F.col("base")).cast("binary"), 256).alias("base_sha256"), said(F.array_sort(F.concat("base", "added"), by_place)).alias("spans"))


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return digests(find(docs, fit(docs)))
