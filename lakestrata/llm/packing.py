"""Operator 7: order-preserving packing. Documents, in the order of doc_id, make one
stream of ids; dynamic programming chooses where windows of at most 4096 ids end, at
document or sentence ends if it can, so that padding plus penalties for cut documents is
smallest. A monotone queue finds the best start of each window in constant time, so the
work grows with the number of boundaries only.

Every sequence counts as padded to the window, so short ones never pay; one whose length
happens to be a power of two is not padded in fact. Cuts are given out as soon as all
paths that can still be the best share them, so they are those of the whole stream of a
range, and a task holds only what lies behind the last shared cut.

Defined results. Null or empty text: the end id alone. Null doc_id: first. Repeated
doc_ids: separate documents, side by side, by the hash of their texts. A sentence longer
than a window may be cut at any id, at the highest penalty. Empty table: no rows. Other
columns are not read.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  as pa.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batched, in_ranges, table
from .tokens import SLICE, word_encoder

WINDOW = 4096
END_ID = 2
#: What a cut costs, in ids of padding.
SENTENCE_PENALTY, HARD_PENALTY = 24, 256


class Cutter:
    """Takes boundaries of a stream in order and gives the ends of windows. With cost(i) the
    least cost up to boundary i, a window that ends at p(j) starts best where cost(i) + p(i)
    is least among those within reach; ties go to the latest, so that paths soon meet."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.positions, self.value, self.before = [0], [0], [0]
        self.queue = deque([0])  # boundaries within reach, of rising value

    def add(self, positions: list[int], penalties: list[int]) -> None:
        """Boundaries: ascending, no two neighbours over a window apart."""
        known, value, before, queue, window = self.positions, self.value, self.before, self.queue, self.window
        for j, (p, penalty) in enumerate(zip(positions, penalties, strict=True), len(known)):
            known.append(p)
            while known[queue[0]] < p - window:
                queue.popleft()
            i = queue[0]
            v = value[i] + window + penalty
            value.append(v)
            before.append(i)
            while queue and value[queue[-1]] >= v:
                queue.pop()
            queue.append(j)

    def settled(self) -> int:
        """The last boundary that all paths to boundaries within reach of the end share."""
        at = len(self.positions) - 1
        reach = self.positions[at] - self.window
        paths = {at}
        while at and self.positions[at] >= reach:
            paths.add(at)
            at -= 1
        while len(paths) > 1:
            last = max(paths)
            paths.remove(last)
            paths.add(self.before[last])
        return paths.pop()

    def give(self, last: bool = False) -> list[int]:
        """Ends of the windows that are certain by now; all of them, if no boundary follows."""
        at = upto = len(self.positions) - 1 if last else self.settled()
        cuts = []
        while at:
            cuts.append(self.positions[at])
            at = self.before[at]
        self.positions, self.value = self.positions[upto:], self.value[upto:]
        self.before = [max(i - upto, 0) for i in self.before[upto:]]
        self.queue = deque(i - upto for i in self.queue if i >= upto)
        return cuts[::-1]


class Packer:
    """Takes documents in order and gives pieces as columns: doc_id, start, length,
    ids_crc32, doc_tokens, sequence number, offset."""

    def __init__(self, window: int = WINDOW):
        self.window, self.cutter = window, Cutter(window)
        self.ids = np.empty(0, "<u4")  # of the stream, from base on
        self.base = self.end = self.sequence = 0
        self.doc_ids: list = []  # documents not given out in full, and where they end
        self.starts, self.ends = np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, doc_ids: list, ids: np.ndarray, lengths: np.ndarray, stops: np.ndarray, text_of: np.ndarray) -> list:
        """Documents: their ids without the end id, and the ends of sentences inside them."""
        totals = lengths + 1
        ends = self.end + np.cumsum(totals)
        starts = ends - totals
        inner = stops < lengths[text_of]
        marks = np.concatenate([starts[text_of[inner]] + stops[inner], ends])
        penalties = np.repeat([SENTENCE_PENALTY, 0], [inner.sum(), len(ends)])
        order = np.argsort(marks, kind="stable")
        marks, penalties = marks[order], penalties[order]
        gaps = np.diff(marks, prepend=self.end)
        if (wide := np.flatnonzero(gaps > self.window)).size:
            hard = np.concatenate([np.arange(marks[i] - gaps[i] + 1, marks[i]) for i in wide])
            place = np.searchsorted(marks, hard)
            marks, penalties = np.insert(marks, place, hard), np.insert(penalties, place, HARD_PENALTY)
        self.cutter.add(marks.tolist(), penalties.tolist())
        self.ids = np.concatenate([self.ids, np.insert(ids, np.cumsum(lengths), END_ID)])
        self.doc_ids += doc_ids
        self.starts, self.ends = np.concatenate([self.starts, starts]), np.concatenate([self.ends, ends])
        self.end = int(ends[-1])
        return self.give(last=False)

    def give(self, last: bool) -> list:
        cuts = np.array(self.cutter.give(last), np.int64)
        if not len(cuts):
            return []
        upto = cuts[-1]
        edges = np.union1d(cuts, self.ends[self.ends < upto])
        begin = np.concatenate([[self.base], edges[:-1]])
        doc = np.searchsorted(self.ends, begin, "right")
        window = np.searchsorted(cuts, begin, "right")
        data = memoryview(np.ascontiguousarray(self.ids[: upto - self.base], "<u4")).cast("B")
        sums = [zlib.crc32(data[4 * i : 4 * j]) for i, j in zip((begin - self.base).tolist(), (edges - self.base).tolist(), strict=True)]
        columns = [[self.doc_ids[i] for i in doc.tolist()], begin - self.starts[doc], edges - begin, sums, (self.ends - self.starts)[doc], self.sequence + window, begin - np.concatenate([[self.base], cuts[:-1]])[window]]
        left = int(np.searchsorted(self.ends, upto, "right"))
        self.ids, self.base, self.sequence = self.ids[upto - self.base :], int(upto), self.sequence + len(cuts)
        self.doc_ids, self.starts, self.ends = self.doc_ids[left:], self.starts[left:], self.ends[left:]
        return columns


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer: str) -> DataFrame:
    """One row per piece of a document; see PIECES. Each task packs a range of doc_ids, so
    that order is kept and a range wastes at most one window. The ids of a task's
    sequences start at its number times 2^40."""
    names = [x.split()[0] for x in PIECES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer, number = word_encoder(tokenizer), Packer(), TaskContext.get().partitionId() << 40

        def rows(columns: list) -> pa.RecordBatch:
            columns[5] += number
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

        for batch in batched(batches, "text", SLICE):
            if columns := packer.add(batch.column("doc_id").to_pylist(), *encode(batch.column("text"))):
                yield rows(columns)
        if columns := packer.give(last=True):
            yield rows(columns)

    return in_ranges(docs).mapInArrow(run, PIECES)


def sequences(pieces: DataFrame) -> DataFrame:
    """Length and padding of each sequence, for reports."""
    n = F.sum("length")
    return pieces.groupBy("sequence_id").agg(n.alias("n_tokens"), F.when(n.bitwiseAND(n - 1) == 0, 0).otherwise(WINDOW - n).alias("padding"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
