"""Finding benchmark items in documents by SimHash, and checking them exactly."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadmill.llm.common import free_names, settled, small_side
from threadmill.llm.words import Chunk, Spans, chunks, mix, ranges

SHINGLE = 5
PERCENT = 75
# Fingerprints have 8 blocks of 16 bits.  Within RADIUS = 8 * 4 + 7 bits of each
# other, two of them differ in at most 4 bits of some block: items are listed at
# the values up to 3 bits from theirs, windows are looked up at those 1 bit away.
BLOCKS, BLOCK_BITS, FLIPS, LOOKUP_FLIPS = 8, 16, 3, 1
FINGERPRINT_BITS = BLOCKS * BLOCK_BITS
RADIUS = BLOCKS * (FLIPS + LOOKUP_FLIPS + 1) - 1
# Items are looked for so many at a time; the documents are read once for each lot.
ITEMS_AT_ONCE = 2000
_WINDOWS_AT_ONCE = 1 << 12


def _signs(hashes: np.ndarray) -> np.ndarray:
    """Each shingle's vote, +1 or -1, on each bit of a fingerprint."""
    halves = [mix(hashes ^ np.uint64(0x5851F42D4C957F2D * (i + 1) & 0xFFFFFFFFFFFFFFFF)) for i in range(FINGERPRINT_BITS // 64)]
    raw = np.stack(halves, axis=1).astype("<u8").view(np.uint8).reshape(len(hashes), -1)
    return np.unpackbits(raw, axis=1).astype(np.int8) * 2 - 1


def _features(hashes: np.ndarray, earlier: np.ndarray) -> np.ndarray:
    """Shingles told apart by how often they came before: on these features the
    similarity, which counts repeats, is a plain Jaccard similarity of sets."""
    return mix(hashes ^ mix(earlier.astype(np.uint64)))


class _Shingles:
    """Hashes of consecutive shingles, and how often each is in a stretch of them."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes

    @cached_property
    def _ranks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.argsort(self.hashes, kind="stable")
        changes = np.diff(self.hashes[order]) != 0
        group = np.cumsum(np.concatenate([[0], changes])) * (len(order) + 1)
        rank, base = np.empty_like(order), np.empty_like(order)
        rank[order], base[order] = np.arange(len(order)), group
        return group + order, rank, base

    def between(self, shingle: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How many equals of a shingle lie from it to before a later place, without
        itself; or, as a negative number, from an earlier place to before it."""
        keys, rank, base = self._ranks
        n = np.searchsorted(keys, base[shingle] + place) - rank[shingle]
        return np.where(place > shingle, n - 1, n)


def _window_votes(shingles: _Shingles, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Sums of the votes of the features of each window, whose starts ascend;
    windows that overlap have the same length.

    A window that begins close to the one before takes over its sums, without
    the features of the shingles that leave and with those of the ones that enter.
    """
    step = np.diff(begin, prepend=begin[0])
    anew = np.ones(len(begin), bool)
    anew[1:] = step[1:] > length[:-1] // 2
    out_of, leaving = np.where(anew, 0, begin - step), np.where(anew, 0, step)
    left, window = ranges(out_of, leaving)
    left_before = shingles.between(left, (out_of + length)[window])
    came, to = ranges(np.where(anew, begin, out_of + length), np.where(anew, length, step))
    came_before = -shingles.between(came, begin[to])
    events, which = np.concatenate([left, came]), np.concatenate([window, to])
    signs = _signs(_features(shingles.hashes[events], np.concatenate([left_before, came_before])))
    np.negative(signs[: len(left)], out=signs[: len(left)])
    by_window = np.argsort(which, kind="stable")
    starts = np.searchsorted(which[by_window], np.arange(len(begin)))
    sums = np.cumsum(np.add.reduceat(signs[by_window], starts, axis=0, dtype=np.int32), axis=0, dtype=np.int32)
    # what had been summed up before the last window that was counted anew
    base = np.maximum.accumulate(np.where(anew, np.arange(len(begin)), 0))
    return sums - np.where((base > 0)[:, None], sums[base - 1], 0)


def _fingerprints(votes: np.ndarray) -> np.ndarray:
    """Sums of votes as rows of BLOCKS 16-bit numbers; a tie is a zero."""
    return np.packbits(votes > 0, axis=1).view(">u2").astype(np.uint16)


def _masks(flips: int) -> np.ndarray:
    """All changes of a block by at most so many bits."""
    bits = [c for k in range(flips + 1) for c in combinations(range(BLOCK_BITS), k)]
    return np.array([sum(1 << b for b in c) for c in bits], np.uint16)


@dataclass
class ItemIndex:
    """Benchmark items with their fingerprints in a multi-index.

    `shingles`, `items` and `weights`: the distinct shingles of every item and how
    often each is in it, sorted by shingle."""

    item_ids: np.ndarray
    n_words: np.ndarray
    fingerprints: np.ndarray
    shingles: np.ndarray
    items: np.ndarray
    weights: np.ndarray
    _tables: tuple | None = field(default=None, repr=False)

    @classmethod
    def of(cls, item_ids: list[int], texts: list[str | None]) -> ItemIndex:
        ids, sizes, prints, shingles, items, weights = [], [], [], [], [], []
        for chunk in chunks(pa.array(texts, pa.string()), lower=True):
            n = chunk.n_words
            count = np.where(n > 0, np.maximum(n - SHINGLE + 1, 1), 0)
            first, text = ranges(chunk.bounds[:-1], count)
            last = np.minimum(first + SHINGLE, chunk.bounds[text + 1])
            hashes = Spans(chunk.word_hashes()).hash(first, last)
            for i in np.flatnonzero(n > 0).tolist():
                distinct, often = np.unique(hashes[text == i], return_counts=True)
                items.append(np.full(len(distinct), len(ids)))
                ids.append(item_ids[chunk.first + i])
                sizes.append(n[i])
                earlier, of = ranges(np.zeros(len(often), np.int64), often)
                votes = _signs(_features(distinct[of], earlier)).sum(axis=0, keepdims=True, dtype=np.int64)
                prints.append(_fingerprints(votes)[0])
                shingles.append(distinct)
                weights.append(often)
        empty = np.zeros(0, np.int64)
        s, i, w = (np.concatenate(x) if x else empty for x in (shingles, items, weights))
        order = np.lexsort((i, s))
        return cls(
            np.array(ids, np.int64),
            np.array(sizes, np.int64),
            np.array(prints, np.uint16).reshape(-1, BLOCKS),
            s.astype(np.uint64)[order],
            i[order],
            w[order],
        )

    @cached_property
    def window_sizes(self) -> np.ndarray:
        return np.unique(self.n_words)

    @cached_property
    def _filter(self) -> tuple[np.ndarray, np.ndarray]:
        table = np.zeros(1 << 20, bool)
        table[self.shingles >> np.uint64(44)] = True
        return table, np.unique(self.shingles)

    @cached_property
    def named_weights(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted names of (shingle, item), their counts, and the items' sizes."""
        names = mix(self.shingles ^ mix(self.items.astype(np.uint64) + np.uint64(1)))
        order = np.argsort(names)
        sizes = np.bincount(self.items, weights=self.weights, minlength=len(self.item_ids))
        return names[order], self.weights[order], sizes.astype(np.int64)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        """Whether each hash is a shingle of an item."""
        table, known = self._filter
        found = table[hashes >> np.uint64(44)]
        maybe = hashes[found]
        found[found] = known[np.minimum(np.searchsorted(known, maybe), len(known) - 1)] == maybe
        return found

    def _multi_index(self) -> tuple[np.ndarray, np.ndarray]:
        """For each block and value, the items whose block is at most FLIPS bits from it."""
        if self._tables is None:
            near = (self.fingerprints[:, :, None] ^ _masks(FLIPS)).astype(np.int64)
            keys = near + (np.arange(BLOCKS) << BLOCK_BITS)[None, :, None]
            owners = np.broadcast_to(np.arange(len(self.item_ids), dtype=np.int32)[:, None, None], keys.shape).ravel()
            order = np.argsort(keys.ravel(), kind="stable")
            starts = np.searchsorted(keys.ravel()[order], np.arange((BLOCKS << BLOCK_BITS) + 1))
            self._tables = (starts, owners[order])
        return self._tables

    def near(self, fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (row of `fingerprints`, item) within RADIUS bits: the multi-index
        lists every one of them, and the full distance is checked."""
        starts, owners = self._multi_index()
        values = (fingerprints[:, :, None] ^ _masks(LOOKUP_FLIPS)).astype(np.int64)
        keys = (values + (np.arange(BLOCKS) << BLOCK_BITS)[None, :, None]).ravel()
        at, which = ranges(starts[keys], starts[keys + 1] - starts[keys])
        lookups = values.shape[1] * values.shape[2]
        pairs = np.unique((which // lookups) * len(self.item_ids) + owners[at])
        row, item = pairs // len(self.item_ids), pairs % len(self.item_ids)
        distance = np.bitwise_count(fingerprints[row] ^ self.fingerprints[item]).sum(axis=1)
        return row[distance <= RADIUS], item[distance <= RADIUS]


def _matches(chunk: Chunk, index: ItemIndex) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, first word, words, item, shared, union) of similar windows.

    Windows have the size of some item, so both have n shingles, and are similar
    only if they share 6 n / 7 of them; a text with fewer words than an item is one
    window itself.  A window with fewer shingles of all items together is passed
    over; the others are fingerprinted, and those near an item's fingerprint are
    compared shingle by shingle, counting repeats: shared is the sum of the smaller
    counts, union that of the larger.
    """
    for whole, shingles, begin, of, first_word, per_window, words in _candidates(chunk, index):
        for at in range(0, len(begin), _WINDOWS_AT_ONCE):
            part = slice(at, at + _WINDOWS_AT_ONCE)
            some, owner, first, length, size = begin[part], of[part], first_word[part], per_window[part], words[part]
            row, item = index.near(_fingerprints(_window_votes(shingles, some, length)))
            wanted = index.n_words[item]
            fits = wanted > size[row] if whole else wanted == size[row]
            row, item = row[fits], item[fits]
            if not len(row):
                continue
            shared, union = _overlaps(shingles.hashes, some[row], length[row], item, index)
            good = 100 * shared >= PERCENT * union
            row, item = row[good], item[good]
            yield owner[row], first[row], size[row], item, shared[good], union[good]


def _candidates(chunk: Chunk, index: ItemIndex) -> Iterator[tuple[np.ndarray, ...]]:
    """(whether the windows are whole texts, for the items longer than them; all
    shingles; and per window: its first shingle, text, first word, number of
    shingles, number of words) of windows with enough shingles of all items."""
    spans, last_width = Spans(chunk.word_hashes()), 0
    sizes = index.window_sizes
    for size in sizes.tolist():
        width = min(SHINGLE, size)
        per_window = size - width + 1
        if width != last_width:
            last_width = width
            first, text = chunk.window_starts(width)
            hashes = spans.hash(first, first + width)
            hits, shingles = index.holds(hashes), _Shingles(hashes)
            seen = np.concatenate([[0], np.cumsum(hits)])
            # shingle numbers of a text are consecutive, so its windows are runs of them
            shingle_at = np.searchsorted(text, np.arange(len(chunk)))
            hit_texts = np.unique(text[hits])
        n_windows = np.maximum(chunk.n_words[hit_texts] - size + 1, 0)
        begin, of = ranges(shingle_at[hit_texts], n_windows)
        holds = (100 + PERCENT) * (seen[begin + per_window] - seen[begin]) >= 2 * PERCENT * per_window
        begin, of = begin[holds], hit_texts[of[holds]]
        at = first[begin] - chunk.bounds[of]
        yield False, shingles, begin, of, at, np.full(len(begin), per_window), np.full(len(begin), size)
    if last_width == SHINGLE:  # shorter items share no shingle with a text that is shorter still
        n = chunk.n_words[hit_texts]
        longer = np.searchsorted(sizes, n, "right")
        of, n, longer = (x[longer < len(sizes)] for x in (hit_texts, n, longer))
        begin, per_window = shingle_at[of], n - SHINGLE + 1
        least = per_window + sizes[longer] - SHINGLE + 1
        holds = (100 + PERCENT) * (seen[begin + per_window] - seen[begin]) >= PERCENT * least
        begin, of, per_window, n = begin[holds], of[holds], per_window[holds], n[holds]
        yield True, shingles, begin, of, np.zeros(len(of), np.int64), per_window, n


def _overlaps(hashes, begin, per_window, item, index: ItemIndex) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the smaller and the larger counts of each window and item."""
    shingle, pair = ranges(begin, per_window)
    keys = np.stack([pair.astype(np.uint64), hashes[shingle]])
    (pair, value), often = np.unique(keys, axis=1, return_counts=True)
    pair = pair.astype(np.int64)
    names, weights, sizes = index.named_weights
    wanted = mix(value ^ mix(item[pair].astype(np.uint64) + np.uint64(1)))
    at = np.minimum(np.searchsorted(names, wanted), len(names) - 1)
    theirs = np.where(names[at] == wanted, weights[at], 0)
    shared = np.bincount(pair, weights=np.minimum(often, theirs), minlength=len(begin)).astype(np.int64)
    return shared, per_window + sizes[item] - shared


def contaminated(docs: DataFrame, benchmark: DataFrame, items_at_once: int = ITEMS_AT_ONCE) -> DataFrame:
    """Which `docs` (doc_id, text) hold which items of `benchmark` (item_id, text).

    Returns a row per document and item with a window of the item's size in words
    (the whole text, if it has fewer) that is similar to it: doc_id, text_key (hash of the text), item_id,
    similarity (of weighted shingles, 0.75 to 1), first_word and n_words of the
    best window; ties go to the first.  A-Z counts as lower case.  An item of
    fewer than five words is one shingle; items and texts without words, null or
    not, match nothing.  Equal rows give one row each time they differ in doc_id;
    items with a null id are found with a null item_id.  Other columns are ignored.

    The items are the queries: they are taken in lots of `items_at_once`, and
    each lot's index, of bounded size, is sent to all tasks.
    """
    spark = docs.sparkSession
    schema = "doc_id long, text_key long, item int, similarity double, first_word int, n_words int"
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    out = None
    for lot in _lots(benchmark, items_at_once):
        shipped = spark.sparkContext.broadcast(ItemIndex.of(list(range(len(lot))), [r.text for r in lot]))

        def search(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            index = shipped.value
            for batch in batches:
                for chunk in chunks(batch.column(2), lower=True):
                    found = list(_matches(chunk, index)) if len(index.item_ids) else []
                    if not found:
                        continue
                    text, first, size, item, shared, union = map(np.concatenate, zip(*found))
                    order = np.lexsort((first, -shared / union, item, text))
                    pairs = text[order] * len(index.item_ids) + item[order]
                    best = order[np.unique(pairs, return_index=True)[1]]
                    rows = pa.array(chunk.first + text[best])
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(rows),
                            batch.column(1).take(rows),
                            pa.array(index.item_ids[item[best]].astype(np.int32)),
                            pa.array(shared[best] / union[best]),
                            pa.array(first[best].astype(np.int32)),
                            pa.array(size[best].astype(np.int32)),
                        ],
                        ["doc_id", "text_key", "item", "similarity", "first_word", "n_words"],
                    )

        named = T.StructType([T.StructField("item", T.IntegerType()), T.StructField("item_id", T.LongType())])
        names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(lot)], named)
        part = keyed.mapInArrow(search, schema).join(F.broadcast(names), "item").drop("item")
        out = part if out is None else out.unionByName(part)
    return out.select("doc_id", "text_key", "item_id", "similarity", "first_word", "n_words").distinct()


def _lots(benchmark: DataFrame, size: int) -> Iterator[list]:
    """The items in lots of `size`, in a fixed order; one empty lot if there are none."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").orderBy("item_id", "text")
    lot, any_lot = [], False
    for row in rows.toLocalIterator():
        lot.append(row)
        if len(lot) == size:
            any_lot = True
            yield lot
            lot = []
    if lot or not any_lot:
        yield lot


def without_items(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """`docs` without those that hold an item of `benchmark`."""
    id_, key, text_key = free_names(docs, 3)
    found = settled(
        contaminated(docs, benchmark).select(F.col("doc_id").alias(id_), F.col("text_key").alias(key)).distinct()
    )
    keyed = docs.withColumn(text_key, F.xxhash64("text"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (F.col(text_key) == F.col(key))
    return keyed.join(small_side(found), same, "left_anti").select(*docs.columns)
