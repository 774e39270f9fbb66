"""Operator 11: runs of words that repeat with a period, found online by dyadic square
catching.

Words are appended to a catcher. For each power of two B it keeps the hashes of all rows of
B words, and each completed block of B words (at a multiple of B) watches for its own words
to come again 2B-1 to 4B-2 words later: what repeats with such a period p (a square) has a
whole block in its first half, whose copy stands p words on. A block that is followed by
its copy is a catch; catches of neighbouring blocks at one distance are one streak, which
is the middle of a stretch of words equal to those p later. At both ends of a streak less
than B words are left to compare, word by word. So squares are reported as the words come,
and merge into runs, which are longer than any streak that is seen of them.

A run of period p and at least 4p words has 3p words in a row that are equal to those p
later, so a streak of MIN_STREAK blocks: shorter ones are not looked at. Each level of B
compares 2 hashes for a word; hashes only propose, all ends and whole stretches are
compared by the words' numbers.

Defined results. Null or empty text, or no words: no runs, nulls, the hash of the empty
string for both texts. Null doc_id: the text is taken as it is, without the planted
repetition. Repeated rows and doc_ids: one row each. Ties are settled by start and period.
Texts of any length are appended in slices; a task holds about 40 bytes for each word of
the text at hand. Empty table: no rows. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  as pa.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batched, table
from .syncmers import mix

#: A run has at least so many words, and so many periods.
MIN_LENGTH, MIN_EXPONENT = 6, 4
#: A run of four periods of 2B-1 words or more holds three in which each word is equal to
#: that a period later: 6B-3 words, and so four blocks of B at least; for B = 1, of the six
#: words of a run five or more.
MIN_STREAK = 4
#: Words that are appended, and bytes that are split into words, at once.
APPEND, SLICE = 1 << 18, 1 << 20
_ODD = np.uint64(0x9FB21C651E98DF25)


class Level:
    """Catchers of the blocks of size B = 2^k: their streaks at each distance."""

    def __init__(self, k: int):
        self.size = 1 << k
        self.low = max(1, 2 * self.size - 1)
        self.distances = np.arange(self.low, 4 * self.size - 1)
        self.hashes = np.empty(0, np.uint64)  # of rows of B words from self.base on
        self.base = 0
        self.block = 0  # the first that is still watched
        self.streak = np.zeros(len(self.distances), np.int64)

    def take(self, hashes: np.ndarray, last: bool) -> list[np.ndarray]:
        """Hashes of more rows; streaks that have ended: (first block, blocks, distance).
        A block is settled when its last distance has come, or no more words will."""
        self.hashes = np.concatenate([self.hashes, hashes])
        size, ended = self.size, []
        have = self.base + len(self.hashes)
        reach = self.low + len(self.distances)
        done = have // size + 1 if last else (have - reach) // size + 1 if have >= reach else 0
        step = max(1, (1 << 20) // len(self.distances))
        while self.block < done:
            rows = min(step, done - self.block)
            at = self.block * size - self.base
            need = at + (rows - 1) * size + reach
            own = self.hashes[at:need]
            padded = own if len(own) >= need - at else np.concatenate([own, np.zeros(need - at - len(own), np.uint64)])
            rows_of = np.lib.stride_tricks.as_strided(padded[self.low :], (rows, len(self.distances)), (size * 8, 8))
            equal = (rows_of == padded[: rows * size : size, None]) & (rows_of != 0)
            ended.append(self._streaks(equal))
            self.block += rows
        if last:
            ended.append(self._streaks(np.zeros((1, len(self.distances)), bool)))
        keep = max(0, self.block * size - self.base)
        self.hashes, self.base = self.hashes[keep:], self.base + keep
        return [e for e in ended if len(e)]

    def _streaks(self, equal: np.ndarray) -> np.ndarray:
        """Streaks that end within these rows, with those that were open before; the others
        stay open."""
        rows, width = equal.shape
        row, column = np.nonzero(equal)
        if not len(row) and not self.streak.any():
            return np.empty((0, 3), np.int64)
        order = np.lexsort((row, column))
        row, column = row[order], column[order]
        # an open streak is a row before the first one
        opened = np.flatnonzero(self.streak)
        row, column = np.concatenate([np.full(len(opened), -1), row]), np.concatenate([opened, column])
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        first = np.flatnonzero(np.concatenate([[True], (np.diff(column) != 0) | (np.diff(row) != 1)]))
        last = np.append(first[1:], len(row)) - 1
        begun, end, where = row[first], row[last], column[first]
        before = np.where(begun < 0, self.streak[where], 0)
        start = np.where(begun < 0, -before, begun)
        length = end + 1 - start
        self.streak = np.zeros(width, np.int64)
        still = end == rows - 1
        self.streak[where[still]] = length[still]
        closed = ~still & (length >= MIN_STREAK)
        return np.column_stack([start[closed] + self.block, length[closed], self.distances[where[closed]]])


class SquareCatcher:
    """Words, as numbers, are appended; runs() are found when all have come. A negative
    number is different from any other word and cuts runs. No run need be found of a period
    over longest_period."""

    def __init__(self, longest_period: int | None = None):
        self.longest_period = longest_period
        self.words = np.empty(0, np.int64)
        self.levels: list[Level] = []
        self.rows: list[np.ndarray] = []  # the last hashes of each level, for the next one
        self.found: list[np.ndarray] = []

    def append(self, words: np.ndarray, last: bool = False) -> None:
        self.words = np.concatenate([self.words, words])
        hashes = mix(words.astype(np.uint64)) | np.uint64(1)
        whole = len(words) == len(self.words)  # whether hashes are those of all words so far
        k = 0
        while True:
            if k == len(self.levels):
                # a run of period 2B-1 has four of them: no shorter text needs the level
                if (1 << k) * 8 - 4 > len(self.words) or (self.longest_period is not None and 2 << k > self.longest_period + 1):
                    break
                self.levels.append(Level(k))
                self.rows.append(np.empty(0, np.uint64))
                hashes, whole = hashes if whole else self._again(k), True  # all words are new to it
            self.found += [np.column_stack([e, np.full(len(e), k)]) for e in self.levels[k].take(hashes, last)]
            half = 1 << k
            both = np.concatenate([self.rows[k], hashes])
            hashes = mix(both[:-half] * _ODD + both[half:]) | np.uint64(1) if len(both) > half else np.empty(0, np.uint64)
            self.rows[k] = both[-half:]
            k += 1

    def _again(self, k: int) -> np.ndarray:
        """Hashes of all rows of 2^k words."""
        hashes = mix(self.words.astype(np.uint64)) | np.uint64(1)
        for i in range(k):
            half = 1 << i
            hashes = mix(hashes[:-half] * _ODD + hashes[half:]) | np.uint64(1)
        return hashes

    def _new(self, first: np.ndarray, end: np.ndarray, q: int, known: np.ndarray) -> np.ndarray:
        """Which streaks at distance q are not the middle of a run whose period divides q: such
        a run cannot go on further at distance q than at its own period."""
        known = known[q % known[:, 2] == 0]
        known = known[np.argsort(known[:, 0])]
        at = np.searchsorted(known[:, 0], first, "right")
        reach = np.concatenate([[-1], np.maximum.accumulate(known[:, 1])]) if len(known) else np.array([-1])
        return reach[at] < end + q

    def _stretch(self, a: int, b: int, q: int, size: int) -> tuple[int, int]:
        """A streak at distance q, with the words to both sides that are equal too."""
        w = self.words
        lo = max(0, a - size)
        left = np.flatnonzero(w[lo:a] != w[lo + q : a + q])
        right = np.flatnonzero(w[b : b + size][: max(0, len(w) - q - b)] != w[b + q : b + q + size])
        return (lo + int(left[-1]) + 1 if len(left) else lo), (b + int(right[0]) if len(right) else min(b + size, len(w) - q))

    def runs(self) -> list[tuple[int, int, int]]:
        """(start, length, period) of all runs, sorted; no more words may come."""
        self.append(np.empty(0, np.int64), last=True)
        known = np.empty((0, 3), np.int64)  # start, end, period
        if not self.found:
            return []
        blocks, count, p, k = np.concatenate(self.found).T
        first, end, w = blocks << k, (blocks + count) << k, self.words
        order = np.lexsort((first, p))
        for own in np.split(order, np.flatnonzero(np.diff(p[order])) + 1):
            q, more = int(p[own[0]]), []
            for i in own[self._new(first[own], end[own], q, known)].tolist():
                a, b = self._stretch(int(first[i]), int(end[i]), q, 1 << int(k[i]))
                if b - a + q >= max(MIN_LENGTH, MIN_EXPONENT * q) and (w[a:b] == w[a + q : b + q]).all():
                    more.append((a, b + q, q))
            known = np.concatenate([known, np.array(more, np.int64).reshape(-1, 3)])
        return sorted((a, b - a, q) for a, b, q in known.tolist())


# --- documents -------------------------------------------------------------------------------
class Numbers(dict):
    """Numbers of words, given out as they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def numbered(text: bytes, known: Numbers) -> np.ndarray:
    """The words of a text by number, split SLICE bytes at a time; new words join known."""
    parts, at = [], 0
    while at < len(text):
        end = at + SLICE
        while end < len(text) and text[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        words = text[at:end].split()
        parts.append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)))
        at = end
    return np.concatenate(parts) if parts else np.empty(0, np.int64)


def planted_repetition(doc_id: int | None, n: int) -> np.ndarray | None:
    """Places of the words of a tenth of the documents, so that their tails repeat."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(b"%d" % doc_id)
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    return np.where(at < a, at, a + (at - a) % p)


RUNS = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def collapse(docs: DataFrame, places: Callable[[int | None, int], np.ndarray | None] | None = None) -> DataFrame:
    """doc_id, n_words, runs, and the text with each run cut to its first period, words
    joined by one blank. places may give other places of a text's words to read it by."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batched(batches, "text", SLICE):
            known = Numbers()
            ids, own = batch.column("doc_id").to_pylist(), []
            for doc_id, text in zip(ids, batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                words = numbered(text, known)
                at = places(doc_id, len(words)) if places else None
                own.append(words if at is None else words[at])
            catcher = SquareCatcher(max(map(len, own)) // MIN_EXPONENT)
            # texts side by side, cut by numbers of their own
            line = np.concatenate([x for i, words in enumerate(own) for x in (words, [-1 - i])])
            for j in range(0, len(line), APPEND):
                catcher.append(line[j : j + APPEND])
            starts = np.cumsum([0] + [len(w) + 1 for w in own])
            of: list[list[dict]] = [[] for _ in own]
            keep = [np.ones(len(w), bool) for w in own]
            for start, length, period in catcher.runs():
                i = int(np.searchsorted(starts, start, "right")) - 1
                start -= int(starts[i])
                of[i].append({"start": start, "length": length, "period": period})
                keep[i][start + period : start + length] = False
            table_of = list(known)
            texts = [b" ".join(map(table_of.__getitem__, w[k].tolist())) for w, k in zip(own, keep, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(list(map(len, own)), pa.int64()), pa.array(of, kind), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, RUNS)


def digests(found: DataFrame) -> DataFrame:
    """Numbers of the run of the greatest exponent, and digests of all runs and of the text."""
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    # the greatest length / period by cross products; sorted by start and period, the first of equals
    best = F.aggregate("runs", F.element_at("runs", 1), lambda x, r: F.when(r["length"] * x["period"] > x["length"] * r["period"], r).otherwise(x))
    best = F.when(F.size("runs") > 0, best)
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.floor(F.col("best.length") * 1000 / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.concat_ws("", F.transform(line, lambda x: F.concat(x, F.lit("\n")))).cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"), "n_words",
    )


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(collapse(table(spark, sf_dir, "documents"), planted_repetition))
