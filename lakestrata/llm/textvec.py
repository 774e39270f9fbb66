"""Hashes of the words and shingles of many texts at once, by numpy."""

from __future__ import annotations

import numpy as np

from .syncmers import mix

_BASE = 0x9E3779B97F4A7C15
#: Byte classes: letters and digits of ASCII and all beyond it make words; blanks cut tokens.
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = True
WORD[128:] = True
TOKEN = np.ones(256, bool)
TOKEN[[9, 10, 11, 12, 13, 32]] = False
#: Value of each byte in hashes; A-Z as a-z in the second.
EXACT = mix(np.arange(1, 257, dtype=np.uint64))
FOLDED = EXACT.copy()
FOLDED[65:91] = FOLDED[97:123]
#: Shape of bytes: upper case, lower case and all beyond ASCII, digits; others stand for themselves.
SHAPE = np.arange(256, dtype=np.uint8)
SHAPE[65:91], SHAPE[97:123], SHAPE[128:], SHAPE[48:58] = 65, 97, 97, 48

_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(n: int, way: str = "up") -> np.ndarray:
    """B^0, B^1 ... modulo 2^64, or of its inverse."""
    if len(_powers[way]) < n:
        b = _BASE if way == "up" else pow(_BASE, -1, 1 << 64)
        step = np.full(max(n, 1 << 16), b, np.uint64)
        step[0] = 1
        _powers[way] = np.multiply.accumulate(step)
    return _powers[way][:n]


def join(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts in one array, a line feed behind each, and where each ends."""
    ends = np.cumsum([len(t) + 1 for t in texts])
    return np.frombuffer(b"\n".join(texts) + b"\n", np.uint8), ends


def spans(data: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that inside[] allows."""
    edge = np.diff(inside[data].astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _wide(data: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Of scripts that are written without blanks: the first bytes of their characters (Chinese
    characters, kana, Thai and Lao), and of their punctuation; None if there are none."""
    if not len(data) or data.max() < 0xE0:
        return None
    after = np.append(data[1:], 0)
    third = np.append(data[2:], [0, 0])[: len(data)]
    mark = (data == 0xE3) & (after == 0x80) & ((third < 0x83) | ((third >= 0x88) & (third < 0xA0)))
    mark |= (data == 0xEF) & (after == 0xBC) & np.isin(third, [0x81, 0x88, 0x89, 0x8C, 0x8E, 0x9A, 0x9B, 0x9F])
    letter = (data >= 0xE3) & (data <= 0xE9) | (data == 0xE0) & (after >= 0xB8) & (after <= 0xBB)
    return np.flatnonzero(letter & ~mark), np.flatnonzero(mark)


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words: runs of letters and digits; in scripts without blanks each
    character is a word."""
    if (wide := _wide(data)) is None:
        return spans(data, WORD)
    letters, marks = wide
    inside = WORD[data]
    for i in range(3):
        inside[marks + i] = False
    alone = np.zeros(len(data) + 3, bool)  # a word begins, or one has ended
    alone[letters] = alone[letters + 3] = True
    before = np.concatenate([[False], inside[:-1]])
    begins = inside & (~before | alone[: len(data)])
    ends = np.flatnonzero(before & (~inside | begins))
    return np.flatnonzero(begins), np.append(ends, len(data)) if inside[-1] else ends


def sentence_ends(data: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Where a sentence ends: bytes that marks[] has, and the full stops of scripts without
    blanks."""
    found = marks[data]
    if (wide := _wide(data)) is not None:
        at = wide[1]
        full = np.isin(data[at + 2], [0x81, 0x8E, 0x9F]) & (data[at] == 0xEF) | (data[at + 2] == 0x82) & (data[at] == 0xE3)
        found[at[full]] = True
    return found


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each span of an array of 64-bit values: differences of one running sum."""
    if not len(starts):
        return np.empty(0, np.uint64)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * _power(len(values)), dtype=np.uint64)])
    return mix((total[ends] - total[starts]) * _power(len(values), "down")[starts])


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, A-Z folded, and the number of words of each text."""
    data, at = join(texts)
    starts, ends = word_spans(data)
    counts = np.diff(np.searchsorted(starts, at), prepend=0)
    return span_hashes(FOLDED[data], starts, ends), counts


def shingles(hashes: np.ndarray, counts: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words of each text, in order, and their numbers. A text of
    1 to k - 1 words has one shingle of all its words."""
    room = np.where(counts > 0, np.maximum(counts, k), 0)
    padded = np.zeros(int(room.sum()), np.uint64)
    offset = np.cumsum(room) - room
    padded[np.repeat(offset - (np.cumsum(counts) - counts), counts) + np.arange(len(hashes))] = hashes
    n = len(padded) - k + 1
    if n < 1:
        return np.empty(0, np.uint64), np.zeros(len(counts), np.int64)
    total = np.zeros(n, np.uint64)
    for i in range(k):
        total = total * np.uint64(0xF1357AEA2E62A9C5) + padded[i : i + n]
    made = np.maximum(room - k + 1, 0)
    at = np.repeat(offset - (np.cumsum(made) - made), made) + np.arange(int(made.sum()))
    return mix(total[at]), made
