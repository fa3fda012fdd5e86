"""Words, shingles and their hashes, vectorised over a chunk of texts.

A chunk is the UTF-8 bytes of some texts back to back.  A span of bytes (or of
word hashes) hashes as a polynomial modulo 2**64, so the hashes of any number of
spans come from one running sum, whatever their lengths.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa

# White space is the space and U+0009 to U+000D.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_NEWLINE = 0x0A
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[list(string.punctuation.encode())] = True

_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
CHUNK_BYTES = 1 << 18
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers_to(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get(which)
    if have is None or len(have[0]) < n + 1:
        size = max(n + 1, CHUNK_BYTES + CHUNK_BYTES // 2)
        tables = []
        for base in (_BASES[which], pow(_BASES[which], -1, 1 << 64)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            tables.append(np.multiply.accumulate(table))
        have = _powers[which] = (tables[0], tables[1])
    return have


class Spans:
    """Hashes of spans of `values`, for one base."""

    def __init__(self, values: np.ndarray, which: int = 0):
        up, self._down = _powers_to(len(values), which)
        self._sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[: len(values)], out=self._sums[1:])
        self._salt = np.uint64(_BASES[which])

    def hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        sums = (self._sums[ends] - self._sums[starts]) * self._down[starts]
        return mix(sums + (ends - starts).astype(np.uint64) * self._salt)


@dataclass
class Chunk:
    """Texts `first` to `first + len(self)` of an array, as bytes and offsets."""

    first: int
    data: np.ndarray
    offsets: np.ndarray
    separators: np.ndarray = field(default_factory=lambda: _SPACE)

    def __len__(self) -> int:
        return len(self.offsets) - 1

    @cached_property
    def _tokens(self) -> tuple[np.ndarray, np.ndarray]:
        inside = ~self.separators[self.data]
        before, after = np.zeros_like(inside), np.zeros_like(inside)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        opens, closes = self.offsets[:-1], self.offsets[1:] - 1
        before[opens[opens < len(inside)]] = False
        after[closes[closes >= 0]] = False
        return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1

    @property
    def starts(self) -> np.ndarray:
        return self._tokens[0]

    @property
    def ends(self) -> np.ndarray:
        return self._tokens[1]

    @cached_property
    def bounds(self) -> np.ndarray:
        """Words of text i: bounds[i] to bounds[i + 1]."""
        return np.searchsorted(self.starts, self.offsets)

    @cached_property
    def n_words(self) -> np.ndarray:
        return np.diff(self.bounds)

    @cached_property
    def word_text(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), self.n_words)

    def bytes_spans(self, which: int = 0) -> Spans:
        return Spans(self.data, which)

    def word_hashes(self, which: int = 0) -> np.ndarray:
        return self.bytes_spans(which).hash(self.starts, self.ends)

    def window_starts(self, words: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, text) of every run of so many words within one text."""
        counts = np.maximum(self.n_words - words + 1, 0)
        first, text = ranges(self.bounds[:-1], counts)
        return first, text

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def ranges(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """start, start + 1, ... for each start, counts of them; and which start each is from."""
    which = np.repeat(np.arange(len(counts)), counts)
    total = int(counts.sum())
    skipped = np.cumsum(counts) - counts
    return np.arange(total) - np.repeat(skipped, counts) + np.repeat(starts, counts), which


def chunks(texts: pa.Array, lower: bool = False, size: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The texts in chunks of about `size` bytes; a longer text is a chunk of
    its own.  A null counts as an empty text."""
    first = 0
    for piece in texts.chunks if isinstance(texts, pa.ChunkedArray) else [texts]:
        for chunk in _chunks(piece.cast(pa.large_binary()).fill_null(b""), size):
            if lower:
                chunk.data = _LOWER[chunk.data]
            chunk.first += first
            yield chunk
        first += len(piece)


def _chunks(texts: pa.LargeBinaryArray, size: int) -> Iterator[Chunk]:
    n = len(texts)
    if not n:
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
        last = min(max(last, first + 1), n)
        yield Chunk(first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last


def per_text(chunk: Chunk, flags: np.ndarray) -> np.ndarray:
    """Sums of a value per byte, for each text."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[chunk.offsets[1:]] - sums[chunk.offsets[:-1]]


def repeated(groups: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """For each hash, how often it is in its group."""
    keys = mix(hashes ^ mix(groups.astype(np.uint64) + np.uint64(1)))
    _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    return counts[inverse] if len(keys) else np.zeros(0, np.int64)


def lines(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text) of every line; a text with n line feeds has n + 1 lines."""
    feeds = np.flatnonzero(chunk.data == _NEWLINE)
    starts = np.sort(np.concatenate([chunk.offsets[:-1], feeds + 1]), kind="stable")
    ends = np.sort(np.concatenate([chunk.offsets[1:], feeds]), kind="stable")
    counts = np.searchsorted(feeds, chunk.offsets[1:]) - np.searchsorted(feeds, chunk.offsets[:-1]) + 1
    return starts, ends, np.repeat(np.arange(len(chunk)), counts)


def shingles(chunk: Chunk, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every shingle; a text with fewer words is one shingle,
    and a text without words has none."""
    spans = Spans(chunk.word_hashes())
    first, text = chunk.window_starts(words)
    short = np.flatnonzero((chunk.n_words > 0) & (chunk.n_words < words))
    first = np.concatenate([first, chunk.bounds[short]])
    text = np.concatenate([text, short])
    last = np.minimum(first + words, chunk.bounds[text + 1])
    return spans.hash(first, last), text


def distinct_sets(chunk: Chunk, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The sets of shingles: hashes sorted within each text, and bounds."""
    hashes, text = shingles(chunk, words)
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    hashes, text = hashes[new], text[new]
    return hashes, np.searchsorted(text, np.arange(len(chunk) + 1))


def split_punctuation(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, bounds per text) of the words, where ASCII punctuation that
    follows an ASCII letter up to the word's end is a piece of its own.  A-Z become
    lower case in words of ASCII only: elsewhere they may compose with what follows."""
    starts, ends = chunk.starts, chunk.ends
    wide = np.concatenate([[0], np.cumsum(chunk.data >= 0x80)])
    beyond = wide[ends] > wide[starts]
    edges = np.zeros(len(chunk.data) + 1, np.int8)
    edges[starts[beyond]] += 1
    edges[ends[beyond]] -= 1
    as_is = np.cumsum(edges[:-1], dtype=np.int8) > 0
    chunk.data = np.where(as_is, chunk.data, _LOWER[chunk.data])
    places = np.arange(len(chunk.data), dtype=np.int32)
    places[_PUNCTUATION[chunk.data]] = -1
    cuts = np.maximum.accumulate(places)[ends - 1] + 1 if len(ends) else ends
    before = _LOWER[chunk.data[np.maximum(cuts, 1) - 1]] if len(ends) else ends
    split = (cuts > starts) & (cuts < ends) & (before >= ord("a")) & (before <= ord("z"))
    per_word = 1 + split
    first = np.cumsum(per_word) - per_word
    out_starts = np.empty(int(per_word.sum()), np.int64)
    out_ends = np.empty_like(out_starts)
    out_starts[first], out_ends[first] = starts, np.where(split, cuts, ends)
    out_starts[first[split] + 1], out_ends[first[split] + 1] = cuts[split], ends[split]
    bounds = np.concatenate([first, [len(out_starts)]])[chunk.bounds]
    return out_starts, out_ends, bounds
