"""Operator 10: byte-pair encoding by a trie of the distinct words. Words that start alike
share their trie path, so each shared prefix is encoded once: the state of a node is the
last token of its prefix's encoding, and a word's ids are read off by walking back.

Why one token is enough: the encoding of a prefix p ends in the only token t for which t
may follow the last token of the encoding of p without t, that is, for which the two of
them, merged as a text of their own, stay these two.

Defined results. Null or empty text: no ids, the hashes of the empty string. Special
tokens in a text become their ids, as in the library. Null or repeated doc_ids: one row
for each row. Empty table: no rows. Other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  as pa.compute
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import batched, table
from .tokens import BYTE_ALPHABET, SLICE, ByteLevelEncoder, Ids

#: Fixed value: the words of the byte-level vocabulary.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


class TrieEncoder:
    """Byte-level BPE from a tokenizers file: encode(words) by the trie, decode(ids)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        back = {chr(c): b for b, c in BYTE_ALPHABET.items()}
        unspell = lambda s: bytes(back[c] for c in s)
        self.id_of = {unspell(s): i for s, i in spec["model"]["vocab"].items() if all(c in back for c in s)}
        self.bytes_of = {i: s for s, i in self.id_of.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for text, i in self.special.items():
            self.id_of.pop(text.encode(), None)
            self.bytes_of[i] = text.encode()
        self.at_special = regex.compile("(" + "|".join(regex.escape(s) for s in self.special) + ")") if self.special else None
        pairs = [p if isinstance(p, list) else p.split(" ") for p in spec["model"]["merges"]]
        ids = spec["model"]["vocab"]
        self.rank = {(ids[a], ids[b]): (r, ids[a + b]) for r, (a, b) in enumerate(pairs)}
        #: ids that a byte string may end in, longest first, by its last bytes
        self.longest = max(map(len, self.id_of))
        self.follows: dict[tuple[int, int], bool] = {}

    def merge(self, data: bytes) -> list[int]:
        """Plain merging, pair of least rank first."""
        ids = [self.id_of[data[i : i + 1]] for i in range(len(data))]
        while len(ids) > 1:
            best = min((self.rank[p][0], i) if (p := (ids[i], ids[i + 1])) in self.rank else (1 << 60, i) for i in range(len(ids) - 1))
            if best[0] == 1 << 60:
                break
            pair = (ids[best[1]], ids[best[1] + 1])
            out, i = [], 0
            while i < len(ids):
                if i + 1 < len(ids) and (ids[i], ids[i + 1]) == pair:
                    out.append(self.rank[pair][1])
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return ids

    def may_follow(self, a: int, b: int) -> bool:
        known = self.follows.get((a, b))
        if known is None:
            known = self.follows[a, b] = self.merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
            if len(self.follows) > 2_000_000:
                self.follows = {}
        return known

    def encode(self, words: list[bytes]) -> list[list[int]]:
        """Ids of distinct words. In sorted order a depth-first walk of their trie keeps
        one path: states[i] is the last token of the path's first i bytes."""
        out: list[list[int]] = [[]] * len(words)
        states: list[int] = [-1]
        path = b""
        id_of, follows, bytes_of = self.id_of, self.may_follow, self.bytes_of
        for k in sorted(range(len(words)), key=words.__getitem__):
            word = words[k]
            shared = 0
            for x, y in zip(path, word):
                if x != y:
                    break
                shared += 1
            del states[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                for start in range(max(0, end - self.longest), end):
                    token = id_of.get(word[start:end])
                    if token is not None and (not start or follows(states[start], token)):
                        if start or end == 1 or self.whole(token):
                            states.append(token)
                            break
            path = word
            ids, at = [], len(word)
            while at:
                ids.append(states[at])
                at -= len(bytes_of[ids[-1]])
            out[k] = ids[::-1]
        return out

    def whole(self, token: int) -> bool:
        """Whether merging a token's bytes gives the token itself."""
        known = self.follows.get((-1, token))
        if known is None:
            known = self.follows[-1, token] = self.merge(self.bytes_of[token]) == [token]
        return known

    def chunks(self, blank: np.ndarray, strings: pa.Array) -> Ids:
        """Ids of strings, for ByteLevelEncoder: words, by the trie, and specials."""
        cut: list[list] = []
        words: dict[bytes, int] = {}
        for behind, text in zip(blank.tolist(), strings.to_pylist(), strict=True):
            own: list = []
            text = " " + text if behind else text
            for i, part in enumerate(self.at_special.split(text) if self.at_special and "<|" in text else [text]):
                own += [self.special[part]] if i % 2 else [w.encode() for w in WORDS.findall(part)]
            for w in own:
                if isinstance(w, bytes):
                    words.setdefault(w, len(words))
            cut.append(own)
        ids = self.encode(list(words))
        flat, ends = array("I"), array("q", [0])
        for own in cut:
            for w in own:
                flat.extend([w] if isinstance(w, int) else ids[words[w]])
            ends.append(len(flat))
        return np.frombuffer(flat, np.uint32), np.diff(np.frombuffer(ends, np.int64))

    def decode(self, ids) -> str:
        """Text of ids, special ones included; bytes that are not UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@functools.lru_cache(1)
def trie_encoder(path: str) -> tuple[TrieEncoder, ByteLevelEncoder]:
    """The trie and the chunk cache over it, kept for all tasks of a Python worker."""
    trie = TrieEncoder(path)
    return trie, ByteLevelEncoder(path, trie.chunks)


def joined(table: pa.Array, ids: np.ndarray, bounds: np.ndarray) -> list:
    """The table's entries for ids, one after the other, cut at bounds."""
    if not len(ids):
        return [b""] * (len(bounds) - 1)
    _, offsets, data = table.take(pa.array(ids)).buffers()
    at, data = np.frombuffer(offsets, np.int64)[bounds].tolist(), memoryview(data)
    return [data[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]


def encode_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, ids (array<int>) and decoded text of every row; the general interface."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, encode = trie_encoder(tokenizer)
        for batch in batched(batches, "text", SLICE):
            flat, lengths = encode(pa.compute.fill_null(batch.column("text"), ""))
            ids = np.split(flat.astype(np.int32), np.cumsum(lengths)[:-1])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array([trie.decode(x.tolist()) for x in ids], pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of the ids and of the decoded text. The strings
    are hashed where they are made, so no ids leave the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, encode = trie_encoder(tokenizer)
        last = max(trie.bytes_of)
        digits = pa.array([b"%d," % i for i in range(last + 1)], pa.large_binary())
        spelled = pa.array([trie.bytes_of.get(i, b"") for i in range(last + 1)], pa.large_binary())
        for batch in batched(batches, "text", SLICE):
            ids, counts = encode(pa.compute.fill_null(batch.column("text"), ""))
            bounds = np.concatenate([[0], np.cumsum(counts)])
            of_ids = [hashlib.sha256(x[:-1]).hexdigest() for x in joined(digits, ids, bounds)]
            of_text = [hashlib.sha256(str(x, "utf-8", "replace").encode()).hexdigest() for x in joined(spelled, ids, bounds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
