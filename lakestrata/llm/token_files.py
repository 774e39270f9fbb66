"""Operator 1: token-id files. Ids of each document are compressed on their own with a
zstandard dictionary that all shards share, and an offset index leads to any document.

A shard, one per range of doc_id: MAGIC, the dictionary's SHA-256 (32 bytes), one
zstandard frame of little-endian unsigned 32-bit ids per document, then the index
(doc_id, is_null, frame offset, frame length, ids: arrays of n), n and the index's offset
(two unsigned 64-bit integers). The dictionary lies beside the shards.

Defined results. Null or empty text: the end id alone. Null doc_id: first of all, doc_id
stays null. Repeated doc_ids: all kept, side by side, by the hash of their texts. Empty
table: no shard, no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  as pa.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batched, filesystem, fresh_path, in_ranges, materialise, partitions, write_atomically
from .tokens import SLICE, byte_level_encoder

MAGIC = b"TOKSHRD1"
#: Documents that the dictionary is trained on, ids of each that are used, and its bytes.
SAMPLE_DOCUMENTS = 400
SAMPLE_IDS = 2048
DICTIONARY_BYTES = 65_536
END_ID = 0


def train_dictionary(docs: DataFrame, tokenizer: str) -> bytes:
    """A zstandard dictionary of at most DICTIONARY_BYTES from the SAMPLE_DOCUMENTS whose
    hashed doc_id is smallest. Too few documents to train on: an empty one."""
    import zstandard

    chosen = [r["doc_id"] for r in docs.select("doc_id").filter("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCUMENTS).collect()]
    # a few rows come to the driver, each cut to what the dictionary can use
    rows = docs.filter(F.col("doc_id").isin(chosen)).select(F.substring("text", 1, 4 * SAMPLE_IDS).alias("t"), F.xxhash64("doc_id").alias("h")).orderBy("h", "t").limit(SAMPLE_DOCUMENTS).collect()
    ids, lengths = byte_level_encoder(tokenizer)(pa.array([r["t"] or "" for r in rows], pa.string()))
    samples = [ids[end - n : end][:SAMPLE_IDS].tobytes() for n, end in zip(lengths.tolist(), np.cumsum(lengths).tolist(), strict=True) if n]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=200, d=8, level=3).as_bytes()
    except zstandard.ZstdError:
        return b""


class ShardWriter:
    """Collects one shard: add() documents in order, then write() the file."""

    def __init__(self, dictionary: bytes):
        import zstandard

        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        if shared:
            shared.precompute_compress(level=3)  # digested once, not for each document
        extra = {"dict_data": shared} if shared else {}
        self.compress = zstandard.ZstdCompressor(level=3, write_content_size=True, **extra).compress
        self.head = MAGIC + hashlib.sha256(dictionary).digest()
        self.at, self.tokens = len(self.head), 0
        self.index: list[tuple[int, int, int, int, int]] = []

    def add(self, doc_id: int | None, ids: bytes) -> bytes:
        frame = self.compress(ids)
        self.index.append((doc_id or 0, doc_id is None, self.at, len(frame), len(ids) // 4))
        self.at += len(frame)
        self.tokens += len(ids) // 4
        return frame

    def tail(self) -> bytes:
        columns = np.array(self.index, dtype="<i8").reshape(-1, 5).T.copy()
        return columns.tobytes() + struct.pack("<QQ", len(self.index), self.at)


class ShardReader:
    """Random access to the documents of a shard by its offset index."""

    def __init__(self, uri: str, dictionary: bytes):
        import zstandard

        store, path = filesystem(uri)
        self.file = store.open_input_file(path)
        head = self.file.read_at(len(MAGIC) + 32, 0)
        if head[: len(MAGIC)] != MAGIC or head[len(MAGIC) :] != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{uri}: not a shard of this dictionary")
        size = self.file.size()
        n, at = struct.unpack("<QQ", self.file.read_at(16, size - 16))
        self.doc_id, self.is_null, self.offset, self.length, self.n_ids = np.frombuffer(self.file.read_at(n * 40, at), "<i8").reshape(5, n)
        extra = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
        self.decompress = zstandard.ZstdDecompressor(**extra).decompress

    def __len__(self) -> int:
        return len(self.doc_id)

    def ids(self, i: int) -> bytes:
        """Ids of the i-th document, as bytes; only its own frame is read."""
        ids = self.decompress(self.file.read_at(int(self.length[i]), int(self.offset[i])))
        if len(ids) != 4 * self.n_ids[i]:
            raise ValueError(f"document {i}: {len(ids) // 4} ids, index says {self.n_ids[i]}")
        return ids

    def find(self, doc_id: int) -> list[int]:
        """Places of a doc_id's documents: the index is sorted, nulls come first."""
        nulls = int(self.is_null.sum())
        return list(range(*(nulls + np.searchsorted(self.doc_id[nulls:], doc_id, side) for side in ("left", "right"))))


def write_shards(docs: DataFrame, tokenizer: str, folder: str) -> DataFrame:
    """Write docs as shards in ascending doc_id order under folder; returns the manifest:
    shard number, uri, documents and ids of each, already stored."""
    dictionary = train_dictionary(docs, tokenizer)
    write_atomically(f"{folder}/dictionary", lambda out: out.write(dictionary))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, shard = byte_level_encoder(tokenizer), ShardWriter(dictionary)
        end = struct.pack("<I", END_ID)
        number = TaskContext.get().partitionId()
        uri = f"{folder}/shard-{number:06d}"

        def body(out) -> None:
            out.write(shard.head)
            for batch in batched(batches, "text", SLICE):
                ids, lengths = encode(batch.column("text"))
                for doc_id, n, to in zip(batch.column("doc_id").to_pylist(), lengths.tolist(), np.cumsum(lengths).tolist(), strict=True):
                    out.write(shard.add(doc_id, ids[to - n : to].tobytes() + end))
            out.write(shard.tail())

        write_atomically(uri, body)
        if shard.index:
            yield pa.RecordBatch.from_pydict({"shard": [number], "uri": [uri], "n_docs": [len(shard.index)], "n_ids": [shard.tokens]})

    return materialise(in_ranges(docs).mapInArrow(write, "shard long, uri string, n_docs long, n_ids long"), "manifest")


def read_shards(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and ids (bytes) of all documents, from the files.
    start comes from the manifest, which has a row for each shard, and each shard's index."""
    from pyspark.sql import Window

    spark = manifest.sparkSession
    based = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = filesystem(f"{folder}/dictionary")
        dictionary = store.open_input_stream(path, compression=None).read()
        for batch in batches:
            for uri, base in zip(batch.column("uri").to_pylist(), batch.column("base").to_pylist(), strict=True):
                shard = ShardReader(uri, dictionary)
                starts = base + np.cumsum(shard.n_ids) - shard.n_ids
                for at in range(0, len(shard), 512):
                    end = min(at + 512, len(shard))
                    ids = [shard.ids(i) for i in range(at, end)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(shard.doc_id[at:end], mask=shard.is_null[at:end] != 0), pa.array(starts[at:end]), pa.array(shard.n_ids[at:end]), pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                        ["doc_id", "start", "n_tokens", "ids_crc32", "ids"],
                    )

    return based.select("uri", "base").repartition(partitions(spark), "uri").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .common import table

    folder = fresh_path(spark, "token-shards")
    manifest = write_shards(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), folder)
    return read_shards(manifest, folder).drop("ids")
