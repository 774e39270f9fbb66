"""Operator 8: near-duplicates by BagMinHash. A document is the multiset of its five-word
shingles. Each shingle and weight level drives Poisson processes over the registers: the
axis of discrete weights is a hierarchy of intervals [0,1), [1,2), [2,4), [4,8) ..., each
with a process of its own, whose points come at a rate in proportion to its length. Only
intervals that the weight reaches into are run; in the last of them, which the weight may
cover in part, a point counts if its place, drawn evenly, lies below the weight (points
are thinned there; intervals are not split further). A register keeps its earliest point,
so two registers agree with probability of exactly the weighted Jaccard similarity. Points
later than the last register's need not be made. Signatures are banded; candidates are
verified by exact multiset overlap of five-word shingles, at least SIMILARITY.

Defined results. Texts without a word, null ones too: no signature, a class of their own
doc_id. Texts of 1 to 4 words: one shingle of all. Copies, and texts that differ in case
or punctuation only, are one node. Null doc_id: its row is kept, class null. Repeated
doc_ids: a row each; a class is named by its smallest doc_id. Very long texts: taken whole.
Empty table: no rows. Other columns are not read, and keep_one() hands them on, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  as pa.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batched, materialise, release, table
from .linking import WEIGHTED, classes, pack_set, tune_bands, with_likely
from .syncmers import mix
from .textvec import shingles, word_hashes

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = tune_bands(SIMILARITY, 0.9995, 160)
REGISTERS = BANDS * ROWS
#: Salts that the rows of a class are spread over when it is named.
SALTS = 16
_STEP, _PLACE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def multisets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text: text, shingle, weight (sorted by text and shingle),
    and the number of shingles of each text."""
    items, counts = shingles(*word_hashes(texts), WORDS)
    owner = np.repeat(np.arange(len(texts)), counts)
    order = np.lexsort((items, owner))
    items = items[order]
    new = np.ones(len(items), bool)
    new[1:] = (items[1:] != items[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    return owner[at], items[at], np.diff(np.append(at, len(items))), counts


def signatures(owner: np.ndarray, items: np.ndarray, weights: np.ndarray, n: int, registers: int = REGISTERS) -> np.ndarray:
    """n x registers times of the earliest points, infinite for empty multisets."""
    first = np.full(n * registers, np.inf)
    # one process for each interval of the axis that a weight reaches into
    low, length = 0, 1
    parts = []
    while len(reach := np.flatnonzero(weights > low)):
        parts.append((reach, np.full(len(reach), low), np.full(len(reach), length)))
        low, length = low + length, max(low + length, 1)
    if not parts:
        return first.reshape(n, registers)
    which, low, length = (np.concatenate(c) for c in zip(*parts, strict=True))
    doc, weight = owner[which], weights[which]
    seed = mix(items[which] + low.astype(np.uint64) * _PLACE)
    time, rate = np.zeros(len(which)), length * float(registers)
    while len(doc):
        seed = mix(seed + _STEP)
        time = time - np.log1p(-((seed >> np.uint64(11)).astype(np.float64) * 2.0**-53)) / rate
        last = first.reshape(n, registers).max(axis=1)
        alive = time <= last[doc]
        if not alive.all():
            seed, time, rate, doc, weight, low, length = (x[alive] for x in (seed, time, rate, doc, weight, low, length))
        draw = mix(seed ^ _PLACE)
        register = ((draw >> np.uint64(40)) * np.uint64(registers)) >> np.uint64(24)
        place = low + ((draw & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32) * length
        inside = place < weight
        np.minimum.at(first, doc[inside] * registers + register[inside].astype(np.int64), time[inside])
    return first.reshape(n, registers)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """n x bands keys: hashes of the band's number and its registers."""
    bits = np.ascontiguousarray(signature).view(np.uint64).reshape(-1, bands, rows)
    key = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64)), bits.shape[:2])
    for r in range(rows):
        key = mix(key * _STEP + bits[:, :, r])
    return key.astype(np.int64)


def identities(owner: np.ndarray, items: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """One 64-bit hash of each multiset."""
    total = np.zeros(n, np.uint64)
    np.add.at(total, owner, mix(items ^ _PLACE) * weights.astype(np.uint64))
    return mix(total).astype(np.int64)


def _doc_key():
    return F.coalesce("doc_id", F.lit(-(2**63)))


def _content():
    """Names a text within its doc_id."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, content (hash of the text), node (hash of its multiset, null without words)
    and band keys of every row, stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batched(batches, "text"):
            texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
            owner, items, weights, counts = multisets(texts)
            keys = band_keys(signatures(owner, items, weights, len(texts)), BANDS, ROWS)
            empty = counts == 0
            keys = [None if e else k for e, k in zip(empty, keys, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("content"), pa.array(identities(owner, items, weights, len(texts)), mask=empty), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "content", "node", "keys"])

    own = docs.select("doc_id", _content().alias("content"), "text")
    return materialise(own.mapInArrow(run, "doc_id long, content long, node long, keys array<long>"), "signatures")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, content, root, class_id, first_content of every row of docs: class_id is the
    smallest doc_id of the near-duplicates that the row belongs to, first_content the text
    that it stands for, root the class's own number."""
    spark = docs.sparkSession
    rows = signed(docs)
    nodes = rows.filter("node is not null").groupBy("node").agg(F.min(F.struct(_doc_key().alias("key"), "content")).alias("rep"), F.first("keys").alias("keys"))
    nodes = materialise(nodes.select("node", "rep.key", "rep.content", "keys"), "nodes")
    release(spark)
    bands = nodes.select("node", F.explode("keys").alias("key"))

    def sets_of(wanted: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batched(batches, "text"):
                texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
                owner, items, weights, _ = multisets(texts)
                cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
                yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([pack_set(items[i:j], weights[i:j]) for i, j in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())], ["node", "items"])

        reps = materialise(nodes.drop("keys").join(wanted, "node"), "wanted")
        texts = with_likely(docs.select(_doc_key().alias("key"), _content().alias("content"), "text"), reps, "content").filter("likely")
        return materialise(texts.join(reps, ["key", "content"]).select("node", "text").mapInArrow(run, "node long, items binary").dropDuplicates(["node"]), "sets")

    labels = classes(bands, sets_of, SIMILARITY, WEIGHTED)
    release(spark)
    # nodes without a link are classes of their own
    known = rows.join(labels, "node", "left").select("doc_id", "content", F.coalesce("root", "node").alias("root"))
    # rows of large classes are spread over salts; classes of one row need no join
    salt = F.pmod(F.xxhash64("doc_id", "content"), F.lit(SALTS)).cast("int")
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "content"))).alias("first")
    named = known.filter("root is not null").groupBy("root").agg(first, F.count("*").alias("n")).filter("n > 1").select("root", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    joined = known.withColumn("salt", salt).join(named, ["root", "salt"], "left")
    return joined.select("doc_id", "content", "root", F.when(F.col("doc_id").isNotNull(), F.coalesce("first.doc_id", "doc_id")).alias("class_id"), F.coalesce("first.content", "content").alias("first_content"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, without near-duplicates: of each class one row, with
    its smallest doc_id, stays. Rows without doc_id or words all stay."""
    found = near_duplicates(docs).filter(F.col("doc_id").isNotNull() & F.col("root").isNotNull())
    is_first = (F.col("doc_id") == F.col("class_id")) & (F.col("content") == F.col("first_content"))
    # what goes, and what stays but stands in several rows
    told = found.groupBy(_doc_key().alias("key"), "content").agg(F.bool_and(is_first).alias("stays"), F.count("*").alias("n")).filter("not stays or n > 1")
    told = materialise(told.select("key", "content", "stays"), "told")
    release(docs.sparkSession)
    # the user's columns travel in one struct, so that no name clashes
    rows = with_likely(docs.select(_doc_key().alias("key"), _content().alias("content"), F.struct("*").alias("row")), told, "content")
    met = rows.filter("likely").join(told, ["key", "content"], "left")
    kept = rows.filter("not likely").select("row").unionByName(met.filter("stays is null").select("row"))
    kept = kept.unionByName(met.filter("stays").dropDuplicates(["key", "content"]).select("row"))
    return kept.select([F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op8_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("is_first"))
