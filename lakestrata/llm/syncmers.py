"""Operator 4: document fingerprints from closed syncmers. A k-mer of code points is an
anchor if the smallest of its inner s-mers, by hash, is its first or its last. Whether it
is depends on the k-mer alone, so equal passages have equal anchors in any text. A
fingerprint is the SKETCH smallest anchor hashes; the share of common ones among the
smallest of both estimates how alike the anchor sets are. Positions of all anchors, not of
the sketch alone, are matched between a text and its edited form: what most common anchors
are moved by, and the share of the text's distinct anchors that stand in that line.

Defined results. Null or empty text: the empty fingerprint, like (1) only another empty
one, offset null and share 0. A text without an anchor (all shorter than K, some shorter than 2K - S): one hash of
the whole text. Order for "next": descending doc_id, null last, equal ids by text; after
the last comes the first, and a lone document is its own next. Very long texts are taken
in overlapping blocks of BLOCK code points. Empty table: no rows. Other columns are not
read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  as pa.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batched, partitions, table

K, S = 20, 8
SKETCH = 128
BLOCK = 1 << 19
_B = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads all bits."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xA24BAED4963EE407)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_B), n, 1 << 64))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def anchors(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and 32-bit hashes of the closed syncmers of an array of code points."""
    n = len(codes) - K + 1
    if n < 1:
        return np.empty(0, np.int64), np.empty(0, np.uint32)
    h1 = mix(codes.astype(np.uint64) + np.uint64(1))
    h2 = h1[:-1] * _power(1) + h1[1:]
    h4 = h2[:-2] * _power(2) + h2[2:]
    h8 = h4[:-4] * _power(4) + h4[4:]
    order = mix(h8)
    low = order
    for step in (1, 2, 4):
        low = np.minimum(low[:-step], low[step:])
    low = np.minimum(low[:n], low[K - S - 7 :][:n])  # of the K - S + 1 = 13 inner s-mers
    at = np.flatnonzero((low == order[:n]) | (low == order[K - S :][:n]))
    hashes = (h8[at] * _power(8) + h8[at + 8]) * _power(4) + h4[at + 16]
    return at, (mix(hashes) >> np.uint64(32)).astype(np.uint32)


def anchored(texts: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Positions, ascending, and hashes of the anchors of several texts, worked out together
    in blocks."""
    out: list[tuple[np.ndarray, np.ndarray]] = []
    group: list[np.ndarray] = []

    def flush() -> None:
        if not group:
            return
        at, hashes = anchors(np.concatenate(group))
        ends = np.cumsum([len(g) for g in group])
        whole = at + K <= ends[np.searchsorted(ends, at, "right")]  # not across two texts
        at, hashes = at[whole], hashes[whole]
        cuts = np.searchsorted(at, ends)
        for first, lo, hi in zip([0, *ends[:-1]], [0, *cuts[:-1]], cuts, strict=True):
            out.append((at[lo:hi] - first, hashes[lo:hi]))
        group.clear()

    for codes in texts:
        if len(codes) > BLOCK:
            flush()
            parts = [(i, *anchors(codes[i : i + BLOCK + K - 1])) for i in range(0, len(codes), BLOCK)]
            out.append((np.concatenate([i + at for i, at, _ in parts]), np.concatenate([h for _, _, h in parts])))
            continue
        group.append(codes)
        if sum(map(len, group)) > BLOCK:
            flush()
    flush()
    return out


def sketch_of(codes: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The sorted fingerprint of a text with these anchor hashes."""
    if len(codes) and not len(hashes):
        return np.frombuffer(hashlib.sha256(codes.tobytes()).digest()[:4], ">u4").astype(np.uint32)
    return np.unique(hashes)[:SKETCH]


def aligned(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[int | None, float]:
    """Positional matching of two texts' anchors, each at its first place: the offset (place
    in b less place in a) that most common anchors have, the nearest to 0 of several, and
    the share of a's anchors that stand at it. Without common anchors: null and 0."""
    one, first = np.unique(a[1], return_index=True)
    other, second = np.unique(b[1], return_index=True)
    common, x, y = np.intersect1d(one, other, assume_unique=True, return_indices=True)
    if not len(common):
        return None, 0.0
    offsets, votes = np.unique(b[0][second[y]] - a[0][first[x]], return_counts=True)
    best = min(zip(-votes, np.abs(offsets), offsets, strict=True))
    return int(best[2]), float(-best[0] / len(one))


def to_string(sketch: np.ndarray) -> str:
    return sketch.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard similarity of the anchor sets of two fingerprints."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = np.union1d(a, b)[:SKETCH]
    return float(np.isin(union, np.intersect1d(a, b, assume_unique=True), assume_unique=True).sum() / len(union))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, fingerprint of every row: no exchange."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batched(batches, "text"):
            codes = [code_points(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array([len(c) for c in codes], pa.int64()), pa.array([to_string(sketch_of(c, h)) for c, (_, h) in zip(codes, anchored(codes), strict=True)], pa.string())], ["doc_id", "n_chars", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


def with_next(docs: DataFrame) -> DataFrame:
    """docs dealt into ranges of doc_id, each in descending order, with the columns range,
    carried, key, doc_id, text. The last row of a range is carried: a copy of the document
    that follows it. The cuts between ranges are quantiles, one number for each range."""
    spark = docs.sparkSession
    keyed = docs.select(F.coalesce("doc_id", F.lit(-(2**63))).alias("key"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = 2 * partitions(spark)
    cuts = np.array(sorted(set(keyed.approxQuantile("key", [i / n for i in range(1, n)], 0.2 / n))), dtype=np.float64)

    @F.arrow_udf("int")
    def range_of(key: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(cuts, key.to_numpy(zero_copy_only=False).astype(np.float64), "left").astype(np.int32))

    ranges = keyed.select("key").withColumn("range", range_of("key")).groupBy("range").agg(F.max("key").alias("key")).orderBy("range").collect()
    if not ranges:
        return keyed.select(F.lit(0).alias("range"), F.lit(False).alias("carried"), "key", "doc_id", "text")
    # the first document of a range follows the last one of the range above
    above = {r["key"]: ranges[(i + 1) % len(ranges)]["range"] for i, r in enumerate(ranges)}
    heads = keyed.filter(F.col("key").isin(list(above))).groupBy("key").agg(F.min("text").alias("text"))
    target = F.create_map(*[F.lit(x) for pair in above.items() for x in pair])
    carried = heads.select(target[F.col("key")].alias("range"), F.lit(True).alias("carried"), "key", F.col("key").alias("doc_id"), "text")
    own = keyed.select(range_of("key").alias("range"), F.lit(False).alias("carried"), "key", "doc_id", "text")
    return own.unionByName(carried).repartition(n, "range").sortWithinPartitions("range", "carried", F.desc("key"), "text")


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, offset_edited long, aligned_edited double"


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited form; see RESULT and the module."""
    names = [x.split()[0] for x in RESULT.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # range, doc_id, text, code points, anchors, sketch of the row before
        for batch in batched(batches, "text", 4 << 20):
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("range", "carried", "doc_id", "text")), strict=True))
            codes = [code_points(r[3]) for r in rows]
            pairs = []
            for (number, is_carried, doc_id, text), code, own in zip(rows, codes, anchored(codes), strict=True):
                now = (number, doc_id, text, code, own, sketch_of(code, own[1]))
                if held and held[0] == number:
                    pairs.append((held, now))
                held = None if is_carried else now
            cut = [len(a[3]) // 3 for a, _ in pairs]
            edits = [np.concatenate([a[3][: len(a[3]) - r], b[3][:r]]) for (a, b), r in zip(pairs, cut, strict=True)]
            out = []
            for (a, b), r, edit, found in zip(pairs, cut, edits, anchored(edits), strict=True):
                text, sketch = a[2][: len(a[2]) - r] + b[2][:r], sketch_of(edit, found[1])
                out.append((a[1], len(a[3]), hashlib.sha256(text.encode()).hexdigest(), to_string(a[5]), to_string(sketch), likeness(a[5], sketch), likeness(a[5], b[5]), *aligned(a[4], found)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return with_next(docs).mapInArrow(run, RESULT)


def op4_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))
