"""Operator 3: WARC archives in Zstandard. An archive is a leading skippable frame that
holds the dictionary, then one Zstandard frame per record.

Records of equal payloads of at least MIN_REVISIT bytes: the one with the smallest page_id
is a response, the others are revisit records that name it and carry no payload. Payloads
below that size are always responses.

Defined results. Null html: an empty payload, a response. Null page_id: kept; it is the
response only where all ids of its group are null. Several rows with the group's smallest
page_id: responses all. Null url: about:blank. Line breaks in a url are percent-encoded.
Very long payloads: one record each. Empty table: no archive, no rows. Other columns are
not read.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401  as pa.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batched, filesystem, fresh_path, materialise, partitions, table, write_atomically

MIN_REVISIT = 100
#: Fixed values of the formats: magic of a skippable frame, of a dictionary, of a frame.
SKIPPABLE, DICTIONARY, FRAME = 0x184D2A5D, 0xEC30A437, 0xFD2FB528
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DICTIONARY_BYTES, SAMPLE_RECORDS, SAMPLE_BYTES = 16_384, 128, 4096
#: Salts that a payload's pages are spread over, so that a hot payload meets in no one task.
SALTS = 32
#: Uncompressed bytes after which a task begins its next archive.
ARCHIVE_BYTES = 64 << 20


def mark_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, html and payload_digest, record_type, refers_to. The smallest page_id
    of a digest is found with partial aggregates; only digests of several pages are joined
    back, once for each salt, so a digest with a third of all rows is spread evenly."""
    html = F.coalesce("html", F.lit(""))
    own = pages.select("page_id", "url", html.alias("html"), F.sha2(html.cast("binary"), 256).alias("payload_digest"))
    large = F.octet_length("html") >= MIN_REVISIT
    first = own.filter(large).groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1").drop("n")
    salts = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = own.withColumn("salt", F.when(large, F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS))).cast("int"))
    joined = salted.join(salts, ["payload_digest", "salt"], "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("first_id").eqNullSafe(F.col("page_id"))
    return joined.select("page_id", "url", "html", "payload_digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first_id")).alias("refers_to"))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; refers_to makes it a revisit, which has the HTTP head alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {(url or 'about:blank').replace(chr(13), '%0D').replace(chr(10), '%0A')}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head[2:2] = [f"WARC-Profile: {IDENTICAL}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archive(uri: str, records: list[bytes]) -> None:
    """An archive of the records; its dictionary is trained on at most SAMPLE_RECORDS of
    them, evenly chosen. Too few records to train on: an archive without a dictionary."""
    import zstandard

    chosen = [r[:SAMPLE_BYTES] for r in records[:: max(1, len(records) // SAMPLE_RECORDS)][:SAMPLE_RECORDS]]
    try:
        dictionary = zstandard.train_dictionary(DICTIONARY_BYTES, chosen, k=200, d=8, level=3).as_bytes() if len(chosen) > 7 else b""
    except zstandard.ZstdError:
        dictionary = b""
    shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    if shared:
        shared.precompute_compress(level=3)
    extra = {"dict_data": shared} if shared else {}
    compress = zstandard.ZstdCompressor(level=3, write_content_size=True, write_checksum=True, **extra).compress

    def body(out) -> None:
        if dictionary:
            packed = zstandard.ZstdCompressor(level=3).compress(dictionary)
            out.write(struct.pack("<II", SKIPPABLE, len(packed)) + packed)
        for r in records:
            out.write(compress(r))

    write_atomically(uri, body)


def read_archive(uri: str, chunk: int = 1 << 16) -> Iterator[bytes]:
    """The records of an archive, frame by frame, in bounded memory. The dictionary in the
    leading skippable frame may itself be compressed."""
    import zstandard

    store, path = filesystem(uri)
    with store.open_input_stream(path, compression=None, buffer_size=chunk) as file:
        extra, rest = {}, file.read(8)
        if len(rest) == 8 and struct.unpack("<I", rest[:4])[0] == SKIPPABLE:
            packed = file.read(struct.unpack("<I", rest[4:])[0])
            if packed[:4] == struct.pack("<I", FRAME):
                packed = zstandard.ZstdDecompressor().decompress(packed)
            if packed[:4] != struct.pack("<I", DICTIONARY):
                raise ValueError(f"{uri}: the leading frame holds no dictionary")
            extra, rest = {"dict_data": zstandard.ZstdCompressionDict(packed)}, b""
        decompressor = zstandard.ZstdDecompressor(**extra)
        while rest or (rest := file.read(chunk)):
            frame, parts = decompressor.decompressobj(), []
            while True:
                parts.append(frame.decompress(rest))
                if frame.eof:
                    rest = frame.unused_data
                    break
                if not (rest := file.read(chunk)):
                    raise ValueError(f"{uri}: it ends within a frame")
            yield b"".join(parts)


def parse_record(raw: bytes) -> dict:
    """Headers of a record in lower case, its block as "block"; raises ValueError where
    version, mandatory headers, lengths or digests do not hold."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not gap or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("not a WARC record")
    fields: dict = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or name.strip().lower() in fields:
            raise ValueError(f"bad header {line!r}")
        fields[name.strip().lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise ValueError(f"{name} is missing")
    n = int(fields["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError(f"content-length is {n}, the block has {len(rest) - 4} bytes")
    fields["block"] = rest[:n]
    if fields.get("warc-block-digest", "").removeprefix("sha256:") not in ("", hashlib.sha256(rest[:n]).hexdigest()):
        raise ValueError("the block's digest does not match")
    return fields


def page_of(fields: dict) -> tuple[int | None, int, str, str, int | None]:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of a parsed record."""
    number = lambda x: int(x.removeprefix("<urn:page:").rstrip(">")) if x != "<urn:page:>" else None
    http, _, payload = fields["block"].partition(b"\r\n\r\n")
    n = next(int(h.split(b":")[1]) for h in http.split(b"\r\n") if h.lower().startswith(b"content-length:"))
    digest = fields["warc-payload-digest"].removeprefix("sha256:")
    if fields["warc-type"] == "response":
        if len(payload) != n or hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError("the payload's length or digest does not match")
    elif payload or "warc-refers-to" not in fields:
        raise ValueError("a revisit has a payload or names no record")
    return number(fields["warc-record-id"]), n, digest, fields["warc-type"], number(fields["warc-refers-to"]) if "warc-refers-to" in fields else None


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write pages as archives under folder; the stored manifest has uri and n_records."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, made, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> pa.RecordBatch:
            nonlocal made, held, size
            uri = f"{folder}/pages-{number:06d}-{made:04d}.warc.zst"
            write_archive(uri, held)
            row = pa.RecordBatch.from_pydict({"uri": [uri], "n_records": [len(held)]})
            made, held, size = made + 1, [], 0
            return row

        for batch in batched(batches, "html"):
            for page_id, url, html, digest, _, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(record(page_id, url, html.encode(), digest, refers_to))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield flush()
        if held:
            yield flush()

    return materialise(mark_revisits(pages).mapInArrow(write, "uri string, n_records long"), "manifest")


PAGE = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_archives(manifest: DataFrame) -> DataFrame:
    """A row per record of the archives, all of them validated; see PAGE."""
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    names = [x.split()[0] for x in PAGE.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, n in zip(batch.column("uri").to_pylist(), batch.column("n_records").to_pylist(), strict=True):
                found, rows = 0, []
                for raw in read_archive(uri):
                    rows.append(page_of(parse_record(raw)))
                    found += 1
                    if len(rows) == 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows = []
                if found != n:
                    raise ValueError(f"{uri}: {found} records, the manifest says {n}")
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return manifest.repartition(partitions(manifest.sparkSession), "uri").mapInArrow(read, PAGE)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_archives(write_archives(table(spark, sf_dir, "pages"), fresh_path(spark, "warc")))


OP3_SQL = f"""
WITH own AS (SELECT page_id, encode(coalesce(html, '')) AS payload, sha256(encode(coalesce(html, ''))) AS payload_digest FROM pages),
     sized AS (SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, payload_digest FROM own),
     firsts AS (SELECT payload_digest AS d, min(page_id) AS first_id FROM sized WHERE payload_bytes >= {MIN_REVISIT} GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first_id IS NOT NULL AND first_id IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_id IS DISTINCT FROM page_id THEN first_id END AS refers_to
FROM sized LEFT JOIN firsts ON d = payload_digest AND payload_bytes >= {MIN_REVISIT}
"""
