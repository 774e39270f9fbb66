"""Token ids of whole texts by the tokenizers library, with each distinct chunk between
white space encoded once per worker and held in a bounded cache."""

from __future__ import annotations

import functools
import itertools
import os
import re
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  as pa.compute

#: Chunks that a worker's cache may hold after a slice (about 150 bytes each), and how many
#: of the last used ones stay when there are more.
CACHE_ENTRIES, CACHE_KEPT = 400_000, 200_000
#: Bytes of text that are encoded together.
SLICE = 2 << 20
#: Chunks with which a sentence ends, marks behind it included.
SENTENCE_END = "[.!?…。][\"')\\]»”]*$"
#: Stands before a text, so that its first chunk, which follows no blank, is told apart.
HEAD = "\x01"
#: White space besides blank and line feed, and controls that Python alone takes for it.
_RARE = "\t\r\x0b\x0c\x1c-\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
_NOT_PLAIN = f"  |\n\n| \n|\n |[{HEAD}{_RARE}]"
#: White space as tokenizers see it, which those controls are not.
_WHITE = re.compile("[ \t\n\r\x0b\x0c\x85\xa0  -     　]+")
#: Letters of Latin, but for a dotted I: no marks to compose and one lower-case letter for
#: each, so that a chunk of them is one word to every tokenizer here.
_ONE_WORD = r"^[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{12f}\x{131}-\x{24f}]+$"
_MARKS = pa.array([",", "."])
#: Ids one after the other, and the number of ids of each string.
Ids = tuple[np.ndarray, np.ndarray]


def _byte_alphabet() -> dict[int, int]:
    """Byte to the printable character that stands for it in byte-level vocabularies:
    printable Latin-1 stands for itself, the others follow from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {b: b if b in plain else next(others) for b in range(256)}


BYTE_ALPHABET = _byte_alphabet()


def spell(word: str) -> str:
    return word if word.isascii() else word.encode().decode("latin-1").translate(BYTE_ALPHABET)


def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def _mask(flags: pa.Array) -> np.ndarray:
    return flags.to_numpy(zero_copy_only=False)


def _put(out: np.ndarray, starts: np.ndarray, flat: np.ndarray, lengths: np.ndarray) -> None:
    """Parts of flat, of those lengths, to those places of out."""
    out[np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(len(flat))] = flat


def library_ids(tokenizer, blank: np.ndarray, strings: pa.Array) -> Ids:
    """Ids of strings, those where blank is true behind a blank. A string of Latin letters
    is one word and goes straight to the library's BPE model, so does one with a comma or
    full stop behind it. All others take the library's whole way."""
    model, compute = tokenizer.model.tokenize, pa.compute
    marked = compute.is_in(compute.utf8_slice_codeunits(strings, -1), value_set=_MARKS)
    core = compute.if_else(marked, compute.utf8_slice_codeunits(strings, 0, -1), strings)
    simple = _mask(compute.match_substring_regex(core, _ONE_WORD))
    if tokenizer.normalizer is not None:  # it makes lower case
        core = compute.utf8_lower(core)
    flat, counts = array("I"), array("q")
    for word, behind in zip(core.filter(pa.array(simple)).to_pylist(), blank[simple].tolist(), strict=True):
        tokens = model("Ġ" + spell(word) if behind else spell(word))
        flat.extend([t.id for t in tokens])
        counts.append(len(tokens))
    others = compute.if_else(pa.array(blank), compute.binary_join_element_wise(" ", strings, ""), strings).filter(pa.array(~simple)).to_pylist()
    rest = [e.ids for e in tokenizer.encode_batch_fast(others, add_special_tokens=False)] if others else []
    counts, marked = np.frombuffer(counts, np.int64), _mask(marked)
    lengths = np.empty(len(strings), np.int64)
    lengths[simple] = counts + marked[simple]
    lengths[~simple] = np.fromiter(map(len, rest), np.int64, len(rest))
    starts = np.cumsum(lengths) - lengths
    out = np.empty(int(lengths.sum()), "<u4")
    _put(out, starts[simple], np.frombuffer(flat, np.uint32), counts)
    _put(out, starts[~simple], np.fromiter(itertools.chain.from_iterable(rest), np.uint32), lengths[~simple])
    ends = simple & marked
    of_mark = np.array([model(m)[0].id for m in _MARKS.to_pylist()], np.uint32)
    out[(starts + lengths)[ends] - 1] = of_mark[compute.index_in(compute.utf8_slice_codeunits(strings.filter(pa.array(ends)), -1), value_set=_MARKS).to_numpy()]
    return out, lengths


class ChunkIds:
    """Ids of the distinct chunks met so far: chunk i has ids[starts[i] : starts[i + 1]]."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.ids, self.starts, self.used, self.turn = np.empty(0, "<u4"), np.zeros(1, np.int64), np.empty(0, np.int32), 0

    def numbers(self, chunks: pa.Array, encode: Callable[[pa.Array], Ids]) -> np.ndarray:
        """Numbers of distinct chunks; encode gives the ids of those not met before."""
        names, n = chunks.to_pylist(), len(self.number)
        which = np.fromiter(map(self.number.get, names, itertools.repeat(-1)), np.int64, len(names))
        new = np.flatnonzero(which < 0)
        self.turn += 1
        if len(new):
            ids, lengths = encode(chunks.take(pa.array(new)))
            which[new] = np.arange(n, n + len(new))
            self.number.update(zip([names[i] for i in new.tolist()], range(n, n + len(new)), strict=True))
            self.ids = np.concatenate([self.ids, ids])
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(lengths)])
            self.used = np.concatenate([self.used, np.zeros(len(new), np.int32)])
        self.used[which] = self.turn
        return which

    def take(self, which: np.ndarray) -> Ids:
        """The ids of those chunks, one after the other, and the number of ids of each."""
        found = pa.LargeListArray.from_arrays(pa.array(self.starts), pa.array(self.ids)).take(pa.array(which))
        return found.values.to_numpy(), np.diff(found.offsets.to_numpy())

    def trim(self) -> None:
        """Where there are more than CACHE_ENTRIES, keep the CACHE_KEPT last used at most."""
        if len(self.number) <= CACHE_ENTRIES:
            return
        kept = np.flatnonzero(self.used > np.partition(self.used, -CACHE_KEPT)[-CACHE_KEPT])
        names = list(self.number)
        self.ids, lengths = self.take(kept)
        self.starts, self.used = np.concatenate([[0], np.cumsum(lengths)]), self.used[kept]
        self.number = {names[k]: i for i, k in enumerate(kept.tolist())}


def _in_order(texts: pa.Array, odd: np.ndarray, even_lists: pa.Array, odd_lists: list) -> pa.Array:
    """Lists of all texts in their order, from those of the odd ones and of the others."""
    if not len(odd):
        return even_lists
    place = np.argsort(np.concatenate([np.setdiff1d(np.arange(len(texts)), odd), odd]))
    return pa.concat_arrays([even_lists, pa.array(odd_lists, pa.list_(pa.string()))]).take(pa.array(place))


class ByteLevelEncoder:
    """Ids of texts for byte-level BPE. encode_chunks(blank, strings), blank telling which
    stand behind one, gives ids for what was not seen before; the default asks the library."""

    def __init__(self, path: str, encode_chunks: Callable[[np.ndarray, pa.Array], Ids] | None = None):
        self.encode_chunks = encode_chunks or functools.partial(library_ids, load_tokenizer(path))
        self.known = ChunkIds()

    def _spelled(self, chunks: pa.Array) -> Ids:
        """Ids of chunks as they stand in a text: behind a blank, but for line feeds and for
        the first of a text, which is marked."""
        head = pa.compute.starts_with(chunks, HEAD)
        blank = ~_mask(pa.compute.or_(head, pa.compute.starts_with(chunks, "\n")))
        return self.encode_chunks(blank, pa.compute.if_else(head, pa.compute.utf8_slice_codeunits(chunks, 1), chunks))

    def __call__(self, texts: pa.Array) -> Ids:
        """Byte-level pre-tokenization cuts a text at every single blank between other
        characters, which belongs to the chunk behind it, and at every single line feed."""
        compute = pa.compute
        plain = compute.invert(compute.match_substring_regex(texts, _NOT_PLAIN))
        odd = np.flatnonzero(~_mask(plain))
        marked = compute.binary_join_element_wise(HEAD, texts, "")
        even = compute.split_pattern(compute.replace_substring(marked.filter(plain) if len(odd) else marked, "\n", " \n"), " ")
        whole = [t if HEAD in t[1:] else None for t in marked.take(pa.array(odd)).to_pylist()]
        cut = [[w] if w else re.split(r"(?<=\S) (?=\S)", t) for w, t in zip(whole, marked.take(pa.array(odd)).to_pylist(), strict=True)]
        lists = _in_order(texts, odd, even, cut)
        bounds, chunks = lists.offsets.to_numpy(), lists.values.dictionary_encode()
        ids, lengths = self.known.take(self.known.numbers(chunks.dictionary, self._spelled)[chunks.indices.to_numpy()])
        ends = np.concatenate([[0], np.cumsum(lengths)])[bounds]
        self.known.trim()
        return ids, np.diff(ends)


class WordEncoder:
    """The same for tokenizers that drop white space: texts are cut at any of it. Also
    gives the ends of sentences, as numbers of ids of the text up to there, and their text."""

    def __init__(self, path: str):
        self.tokenizer = load_tokenizer(path)
        self.known = ChunkIds()

    def _spelled(self, chunks: pa.Array) -> Ids:
        return library_ids(self.tokenizer, np.zeros(len(chunks), bool), chunks)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        compute = pa.compute
        rare = compute.match_substring_regex(texts, f"[{_RARE}]")
        odd = np.flatnonzero(_mask(rare))
        even = compute.split_pattern(compute.replace_substring(texts.filter(compute.invert(rare)) if len(odd) else texts, "\n", " "), " ")
        lists = _in_order(texts, odd, even, [_WHITE.split(t) for t in texts.take(pa.array(odd)).to_pylist()])
        bounds, chunks = lists.offsets.to_numpy(), lists.values.dictionary_encode()
        at = chunks.indices.to_numpy()
        ids, lengths = self.known.take(self.known.numbers(chunks.dictionary, self._spelled)[at])
        total = np.concatenate([[0], np.cumsum(lengths)])
        stops = np.flatnonzero(_mask(compute.match_substring_regex(chunks.dictionary, SENTENCE_END))[at])
        text_of = np.searchsorted(bounds, stops, "right") - 1
        self.known.trim()
        return ids, np.diff(total[bounds]), total[stops + 1] - total[bounds[text_of]], text_of


@functools.lru_cache(1)
def byte_level_encoder(path: str) -> ByteLevelEncoder:
    """One encoder for all tasks that a Python worker runs, so that its cache stays warm."""
    return ByteLevelEncoder(path)


@functools.lru_cache(1)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)
