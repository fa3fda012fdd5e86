"""Re-Pair grammar compression of id sequences, and its shard file.

A shard holds whole documents.  Layout, little-endian: MAGIC; header of HEADER
(counts of documents, ids, symbols and rules, first nonterminal, bit planes);
document ids (int64) and whether each is null (uint8); where documents start in
symbols and in ids (uint64, one more than documents); the rules' left and right
sides and expansion lengths (uint32); the symbols' low halves (uint16), then one
packed plane for each higher bit.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

MAGIC = b"RPAIR001"
HEADER = "<6Q"

# A rule is stored as three numbers of 4 bytes and pays from so many places on.
LEAST = 8
# So many rules are made in the first round, twice as many in each further one.
FIRST_RULES = 2048
_BUCKETS = 1 << 20
_AT_ONCE = 1 << 19


@dataclass
class Grammar:
    symbols: np.ndarray
    left: np.ndarray
    right: np.ndarray
    lengths: np.ndarray
    first: int


def _slices(n: int) -> list[slice]:
    return [slice(i, i + _AT_ONCE) for i in range(0, n, _AT_ONCE)]


def _counted(numbers: np.ndarray) -> np.ndarray:
    counts = np.zeros(_BUCKETS, np.int64)
    for part in _slices(len(numbers)):
        counts += np.bincount(numbers[part], minlength=_BUCKETS)
    return counts


def _pairs_at(symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
    pairs = symbols[places].astype(np.uint64)
    pairs <<= np.uint64(32)
    pairs |= symbols[places + 1]
    return pairs


def _by_bucket(
    symbols: np.ndarray, buckets: np.ndarray, often: np.ndarray, closes: np.ndarray, others: bool
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the buckets that are counted `often`: the first pair of each, its places and
    their buckets; and, with `others`, the places of all other pairs there."""
    first = np.zeros(_BUCKETS, np.uint64)
    places = [np.zeros(0, np.int32)]
    for part in _slices(len(buckets)):
        found = np.flatnonzero(often[buckets[part]] & ~closes[symbols[:-1][part]]) + part.start
        places.append(found.astype(np.int32))
    for found in reversed(places):
        first[buckets[found[::-1]]] = _pairs_at(symbols, found[::-1])
    firsts, numbers, rest = [], [], [np.zeros(0, np.int32)]
    for found in places:
        at = buckets[found]
        same = first[at] == _pairs_at(symbols, found)
        firsts.append(found[same])
        numbers.append(at[same])
        if others:
            rest.append(found[~same])
    return first, np.concatenate(firsts), np.concatenate(numbers), np.concatenate(rest)


def _frequent_pairs(
    symbols: np.ndarray, closes: np.ndarray, limit: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(up to `limit` of the most frequent pairs; the places of all of them, and which
    pair each is).  No pair starts with a symbol that ends a document (`closes`).

    Places are counted by a hash of the pair; of the pairs that share a frequent hash
    the first one is taken, and counted.  Where that finds few, all pairs with a
    frequent hash are counted, so none is missed in the end.  The passes are made in
    slices: of the temporary arrays few are as long as the shard."""
    buckets = symbols[1:] * np.uint32(0x85EBCA77)
    for part in _slices(len(buckets)):
        buckets[part] ^= symbols[:-1][part] * np.uint32(0x9E3779B1)
    buckets >>= np.uint32(12)
    counts = _counted(buckets)
    bar = max(LEAST, int(np.partition(counts, -limit)[-limit])) if limit < _BUCKETS else LEAST
    distinct, places, numbers, rest = _by_bucket(symbols, buckets, counts >= bar, closes, False)
    often = _counted(numbers)
    if np.count_nonzero(often >= LEAST) < FIRST_RULES:
        distinct, places, numbers, rest = _by_bucket(symbols, buckets, counts >= LEAST, closes, True)
        often = _counted(numbers)
    del buckets, counts
    if len(rest):
        more, number, count = np.unique(_pairs_at(symbols, rest), return_inverse=True, return_counts=True)
        distinct, often = np.concatenate([distinct, more]), np.concatenate([often, count])
        places = np.concatenate([places, rest])
        numbers = np.concatenate([numbers, (_BUCKETS + number).astype(np.uint32)])
        order = np.argsort(places, kind="stable")
        places, numbers = places[order], numbers[order]
    best = np.flatnonzero(often >= LEAST)
    best = best[np.lexsort((distinct[best], -often[best]))][:limit]
    place_of = np.full(len(distinct), -1, np.int32)
    place_of[best] = np.arange(len(best))
    for_place = [place_of[numbers[part]] for part in _slices(len(numbers))]
    numbers = np.concatenate([np.zeros(0, np.int32), *for_place])
    return distinct[best], places[numbers >= 0], numbers[numbers >= 0]


def compress(ids: np.ndarray, vocabulary: int, end_id: int) -> Grammar:
    """Replace the most frequent pairs of neighbours by new symbols, in rounds, until
    no pair is found in LEAST places.

    `vocabulary` is more than any id.  Of overlapping places the first is
    replaced.  A symbol never reaches over the end of a document."""
    symbols = ids.astype(np.uint32)
    lengths = np.ones(vocabulary, np.int64)
    closes = np.arange(vocabulary) == end_id
    sides: list[np.ndarray] = []
    limit = FIRST_RULES
    while len(symbols) > 1:
        pairs, places, numbers = _frequent_pairs(symbols, closes, limit)
        if not len(pairs):
            break
        limit *= 2
        # Where the run of neighbouring places starts that each is in.
        run = places.copy()
        run[1:][places[1:] == places[:-1] + 1] = 0
        np.maximum.accumulate(run, out=run)
        use = (places - run) % 2 == 0
        places, numbers = places[use], numbers[use]
        left, right = (pairs >> np.uint64(32)).astype(np.int64), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)
        keep = np.ones(len(symbols), bool)
        for part in _slices(len(places)):
            symbols[places[part]] = len(lengths) + numbers[part]
            keep[places[part] + 1] = False
        symbols = symbols[keep]
        sides.append(np.stack([left, right]))
        lengths = np.concatenate([lengths, lengths[left] + lengths[right]])
        closes = np.concatenate([closes, closes[right]])
    left, right = np.concatenate(sides, axis=1) if sides else np.zeros((2, 0), np.int64)
    return Grammar(symbols, left, right, lengths[vocabulary:], vocabulary)


class Decoder:
    """Turns symbols into ids; expansions of the rules are laid out once."""

    def __init__(self, left: np.ndarray, right: np.ndarray, lengths: np.ndarray, first: int):
        self.first = first
        self.lengths = lengths.astype(np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.zeros(int(self.lengths.sum()), np.uint32)
        for rule, sides in enumerate(zip(left.tolist(), right.tolist())):
            at = int(self.starts[rule])
            for side in sides:
                if side < first:
                    self.flat[at] = side
                    at += 1
                else:
                    n, begin = int(self.lengths[side - first]), int(self.starts[side - first])
                    self.flat[at : at + n] = self.flat[begin : begin + n]
                    at += n
        # Every symbol, terminal or not, as a slice of one array.
        self._all = np.concatenate([np.arange(first, dtype=np.uint32), self.flat])
        self._counts = np.concatenate([np.ones(first, np.int64), self.lengths])
        self._begin = np.concatenate([np.arange(first), first + self.starts])

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        counts = self._counts[symbols]
        ends = np.cumsum(counts)
        places = np.arange(int(ends[-1]) if len(ends) else 0)
        return self._all[places - np.repeat(ends - counts - self._begin[symbols], counts)]


def shard_bytes(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray, vocabulary: int, end_id: int) -> list[bytes]:
    """The file of a shard whose documents have `counts` ids each."""
    grammar = compress(ids, vocabulary, end_id)
    id_starts = np.concatenate([[0], np.cumsum(counts)])
    lengths = np.concatenate([np.ones(vocabulary, np.int64), grammar.lengths])[grammar.symbols]
    symbol_starts = np.searchsorted(np.concatenate([[0], np.cumsum(lengths)]), id_starts)
    planes = max(int(grammar.first + len(grammar.left) - 1).bit_length() - 16, 0)
    header = (len(doc_ids), len(ids), len(grammar.symbols), len(grammar.left), grammar.first, planes)
    return [
        MAGIC,
        struct.pack(HEADER, *header),
        np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes(),
        np.array([d is None for d in doc_ids], "u1").tobytes(),
        symbol_starts.astype("<u8").tobytes(),
        id_starts.astype("<u8").tobytes(),
        grammar.left.astype("<u4").tobytes(),
        grammar.right.astype("<u4").tobytes(),
        grammar.lengths.astype("<u4").tobytes(),
        grammar.symbols.astype("<u2").tobytes(),
        *[np.packbits((grammar.symbols >> np.uint32(16 + p)).astype(np.uint8) & 1).tobytes() for p in range(planes)],
    ]


class ShardFile:
    """Reads a shard: the index and the rules at once, symbols where asked for."""

    def __init__(self, source):
        self.source = source
        if source.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError("not a token shard")
        head = struct.unpack(HEADER, source.read_at(struct.calcsize(HEADER), len(MAGIC)))
        self.n_docs, self.n_ids, self.n_symbols, n_rules, first, self.planes = head
        self._at = len(MAGIC) + struct.calcsize(HEADER)
        values, missing = self._next("<i8", self.n_docs), self._next("u1", self.n_docs)
        self.doc_ids = [None if m else int(v) for v, m in zip(values, missing)]
        self.symbol_starts = self._next("<u8", self.n_docs + 1).astype(np.int64)
        self.id_starts = self._next("<u8", self.n_docs + 1).astype(np.int64)
        left, right, lengths = (self._next("<u4", n_rules) for _ in range(3))
        self.decoder = Decoder(left, right, lengths, first)

    def _next(self, kind: str, n: int) -> np.ndarray:
        size = np.dtype(kind).itemsize * n
        data = self.source.read_at(size, self._at)
        self._at += size
        return np.frombuffer(data, kind)

    def _symbols(self, begin: int, end: int) -> np.ndarray:
        low = np.frombuffer(self.source.read_at(2 * (end - begin), self._at + 2 * begin), "<u2")
        symbols = low.astype(np.uint32)
        plane_bytes = -(-self.n_symbols // 8)
        for p in range(self.planes):
            at = self._at + 2 * self.n_symbols + p * plane_bytes
            packed = np.frombuffer(self.source.read_at(-(-end // 8) - begin // 8, at + begin // 8), np.uint8)
            bits = np.unpackbits(packed)[begin % 8 : begin % 8 + end - begin]
            symbols |= bits.astype(np.uint32) << np.uint32(16 + p)
        return symbols

    def documents(self, first: int, last: int) -> np.ndarray:
        """The ids of documents first to last - 1, by reading their symbols only."""
        return self.decoder.expand(self._symbols(int(self.symbol_starts[first]), int(self.symbol_starts[last])))

    def document(self, i: int) -> np.ndarray:
        return self.documents(i, i + 1)
