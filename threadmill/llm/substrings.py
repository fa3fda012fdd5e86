"""Removing word sequences that occur more than once, by super-k-mers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadmill.llm.common import partitions, settled
from threadmill.llm.hashcounts import Bitmap, frequent
from threadmill.llm.words import Chunk, Spans, chunks, ranges

WINDOW = 35
MINIMISER = 8
# A minimiser that starts so many super-k-mers gives way to rarer ones.
HOT = 1000
# Equal super-k-mers within so many bytes of text travel once.
SENT_BYTES = 1 << 20

_SENT = "bucket long, text_key binary, at int, stop int, packed string"
_SPANS = "text_key binary, span long"


def _leftmost_minima(keys: np.ndarray, width: int) -> np.ndarray:
    """For each place, where the first smallest of the `width` keys from it is."""
    n = len(keys) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    values, places, have = keys, np.arange(len(keys), dtype=np.int32), 1
    while have < width:
        step = min(have, width - have)
        right = values[step:] < values[:-step]
        places = np.where(right, places[step:], places[:-step])
        values = np.where(right, values[step:], values[:-step])
        have += step
    return places


class _Windows:
    """The windows of a chunk and their minimisers."""

    def __init__(self, chunk: Chunk, window: int, minimiser: int):
        self.first, self.text = chunk.window_starts(window)
        self.words = chunk.word_hashes()
        self.spans = Spans(self.words)
        n = max(len(self.words) - minimiser + 1, 0)
        self.mers = self.spans.hash(np.arange(n), np.arange(n) + minimiser)
        self.width = window - minimiser + 1

    def minimisers(self, hot: Bitmap | None = None) -> np.ndarray:
        """The place of each window's minimiser; hot ones only if there is no other."""
        keys = self.mers >> np.uint64(1)
        if hot is not None:
            keys = keys | (hot.has(self.mers).astype(np.uint64) << np.uint64(63))
        return _leftmost_minima(keys, self.width)[self.first]

    def runs(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the first and last window of each super-k-mer: consecutive
        windows of a text with the same minimiser in the same place."""
        new = np.ones(len(places), bool)
        new[1:] = (places[1:] != places[:-1]) | (self.text[1:] != self.text[:-1])
        begin = np.flatnonzero(new)
        return begin, np.append(begin[1:], len(places))[: len(begin)] - 1


def _span(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    return (start.astype(np.int64) << 32) | stop.astype(np.int64)


def repeated_spans(docs: DataFrame, window: int = WINDOW, minimiser: int = MINIMISER) -> DataFrame:
    """Words of each text that are covered by repeated windows: text_key (MD5 of
    the text) and spans, each start * 2**32 + stop in words.

    Which words go depends on a text and the counts alone, so equal texts share a
    row, and a task looks at a text it met twice only once.

    First the minimisers of super-k-mers are counted.  Windows with equal words
    have equal minimisers; so a super-k-mer whose minimiser starts no other one
    has no repeated window and stays where it is.  The others travel, as their
    words joined by a space, to the bucket of their minimiser, where the
    hashes of their windows are sorted and counted.  Super-k-mers that are equal
    within a chunk are known to be repeated and travel once.
    """
    spark = docs.sparkSession

    def started(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for chunk in chunks(batch.column(0)):
            windows = _Windows(chunk, window, minimiser)
            places = windows.minimisers()
            yield windows.mers[places[windows.runs(places)[0]]]

    known = frequent(docs.select("text"), started, [2, HOT])
    shipped = spark.sparkContext.broadcast(known)
    buckets = 4 * partitions(spark)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeated, hot = shipped.value
        any_hot = hot.any()

        def rows(bucket, keys, at, stop, packed) -> pa.RecordBatch:
            arrays = [pa.array(bucket, pa.int64()), pa.array(keys, pa.binary()), pa.array(at, pa.int32())]
            arrays += [pa.array(stop, pa.int32()), pa.array(packed, pa.large_string()).cast(pa.string())]
            return pa.RecordBatch.from_arrays(arrays, ["bucket", "text_key", "at", "stop", "packed"])

        for batch in batches:
            all_keys = batch.column(0).to_pylist()
            for chunk in chunks(batch.column(1), size=SENT_BYTES):
                keys = all_keys[chunk.first : chunk.first + len(chunk)]
                _, once, copies = np.unique(np.array(keys, object).astype("S16"), return_index=True, return_counts=True)
                windows = _Windows(chunk, window, minimiser)
                copied = once[(copies > 1) & (chunk.n_words[once] >= window)]
                own = [keys[i] for i in copied]
                yield rows(np.arange(len(own)) % buckets, own, np.zeros(len(own)), chunk.n_words[copied], [None] * len(own))
                plain = windows.minimisers()
                places = windows.minimisers(hot) if any_hot else plain
                begin, end = windows.runs(places)
                wanted = repeated.has(windows.mers[places[begin]])
                if any_hot and len(begin):
                    wanted |= np.maximum.reduceat((places != plain).astype(np.int8), begin) > 0
                single = np.zeros(len(chunk), bool)
                single[once] = True
                wanted &= single[windows.text[begin]]
                begin, end = begin[wanted], end[wanted]
                first, last = windows.first[begin], windows.first[end] + window
                text = windows.text[begin]
                hashes = windows.spans.hash(first, last)
                _, one, inverse, often = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
                here = np.flatnonzero(often[inverse] > 1) if len(hashes) else np.zeros(0, np.int64)
                at, stop = first - chunk.bounds[text], last - chunk.bounds[text]
                minimisers = windows.mers[places[begin]]
                target = (minimisers % np.uint64(buckets)).astype(np.int64)
                # what is known to be repeated only passes through, in any bucket
                anywhere = np.arange(len(here)) % buckets
                yield rows(anywhere, [keys[i] for i in text[here]], at[here], stop[here], [None] * len(here))
                packed = _joined(chunk, first[one], last[one])
                yield rows(target[one], [keys[i] for i in text[one]], at[one], stop[one], packed)

    def count(table: pa.Table) -> pa.Table:
        local = table.filter(table.column("packed").is_null())
        keys = local.column("text_key").to_pylist()
        spans = [_span(local.column("at").to_numpy(), local.column("stop").to_numpy())]
        sent = table.filter(table.column("packed").is_valid())
        sent_keys = sent.column("text_key")
        at = sent.column("at").to_numpy().astype(np.int64)
        firsts, seconds, rows, places = [], [], [], []
        for chunk in chunks(sent.column("packed")):
            first, row = chunk.window_starts(window)
            firsts.append(Spans(chunk.word_hashes()).hash(first, first + window))
            seconds.append(Spans(chunk.word_hashes(1), 1).hash(first, first + window))
            rows.append(row + chunk.first)
            places.append(first - chunk.bounds[row])
        if firsts:
            a, b, row, place = map(np.concatenate, (firsts, seconds, rows, places))
            order = np.lexsort((b, a))
            same = np.zeros(len(order) + 1, bool)
            same[1:-1] = (a[order][1:] == a[order][:-1]) & (b[order][1:] == b[order][:-1])
            twice = np.zeros(len(order), bool)
            twice[order] = same[1:] | same[:-1]
            hit = np.flatnonzero(twice)
            if len(hit):
                new = np.ones(len(hit), bool)
                new[1:] = (hit[1:] != hit[:-1] + 1) | (row[hit[1:]] != row[hit[:-1]])
                begin = hit[new]
                last = hit[np.append(np.flatnonzero(new)[1:], len(hit)) - 1]
                start = at[row[begin]] + place[begin]
                keys += sent_keys.take(pa.array(row[begin])).to_pylist()
                spans.append(_span(start, start + last - begin + window))
        return pa.table({"text_key": pa.array(keys, pa.binary()), "span": pa.array(np.concatenate(spans))})

    keyed = docs.select(F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))).alias("text_key"), "text")
    found = keyed.mapInArrow(send, _SENT).groupBy("bucket").applyInArrow(count, _SPANS)
    return found.distinct().groupBy("text_key").agg(F.array_sort(F.collect_list("span")).alias("spans"))


def _joined(chunk: Chunk, first: np.ndarray, last: np.ndarray) -> list[str]:
    """The words first to last - 1 joined by a space, for each pair."""
    word, which = ranges(first, last - first)
    starts, ends = chunk.starts[word], chunk.ends[word]
    flat, cuts = _words_and_spaces(chunk, starts, ends)
    per = np.searchsorted(which, np.arange(len(first) + 1))
    bounds = np.concatenate([[0], cuts])[per].tolist()
    raw = flat.tobytes()
    return [raw[a : b - 1].decode("utf-8", "replace") for a, b in zip(bounds[:-1], bounds[1:])]


def _words_and_spaces(chunk: Chunk, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words' bytes, each followed by a space, and where each then ends."""
    sizes = ends - starts + 1
    cuts = np.cumsum(sizes)
    total = int(cuts[-1]) if len(cuts) else 0
    index = np.arange(total) + np.repeat(starts - (cuts - sizes), sizes)
    flat = np.append(chunk.data, np.uint8(0x20))[index]
    flat[cuts - 1] = 0x20
    return flat, cuts


def remove_repeated(
    docs: DataFrame, window: int = WINDOW, carry: tuple[str, ...] = ("doc_id",), with_text: bool = False
) -> DataFrame:
    """`docs` (text) without each word covered by a window of `window` words whose
    sequence starts anywhere else too, in the same text included.

    Windows are judged on the input.  Returns the columns `carry`, n_words,
    n_removed, kept_sha256 (of the kept words joined by a space), and with
    `with_text` these as kept_text.  Null texts, empty ones and those shorter than
    a window keep all their words; equal rows are repeats of each other; an empty
    table gives an empty one.  Other columns are ignored.

    Spans grow with the texts, so both sides are sorted once and merged, at every size."""
    spans = settled(repeated_spans(docs, window))
    key = F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    joined = docs.select("text", *carry).withColumn("text_key", key).join(spans.hint("merge"), "text_key", "left")
    carried = docs.select(*carry).schema.fields
    extra = [("n_words", T.LongType()), ("n_removed", T.LongType()), ("kept_sha256", T.StringType())]
    extra += [("kept_text", T.StringType())] * with_text
    schema = T.StructType(
        [T.StructField(f.name, f.dataType) for f in carried] + [T.StructField(n, t) for n, t in extra]
    )

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            filled = lists.is_valid().to_numpy(zero_copy_only=False)
            sizes = np.zeros(len(batch), np.int64)
            sizes[filled] = np.diff(lists.drop_null().offsets.to_numpy()) if filled.any() else []
            at = np.concatenate([[0], np.cumsum(sizes)])
            flat = lists.flatten().to_numpy()
            for chunk in chunks(batch.column(0)):
                n = len(chunk)
                part = slice(chunk.first, chunk.first + n)
                own = flat[at[chunk.first] : at[chunk.first + n]]
                base = np.repeat(chunk.bounds[:-1], sizes[part])
                edges = np.zeros(len(chunk.starts) + 1, np.int64)
                np.add.at(edges, base + (own >> 32), 1)
                np.add.at(edges, base + (own & 0xFFFFFFFF), -1)
                kept = np.cumsum(edges)[:-1] == 0
                starts, ends = chunk.starts[kept], chunk.ends[kept]
                raw, cuts = _words_and_spaces(chunk, starts, ends)
                raw, cuts = raw.tobytes(), np.concatenate([[0], cuts])
                before = np.concatenate([[0], np.cumsum(kept)])[chunk.bounds]
                bounds = cuts[before].tolist()
                texts = [raw[a : max(b - 1, a)] for a, b in zip(bounds[:-1], bounds[1:])]
                columns = [batch.column(2 + i).slice(chunk.first, n) for i in range(len(carried))]
                columns += [pa.array(chunk.n_words.astype(np.int64)), pa.array(chunk.n_words - np.diff(before))]
                columns.append(pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()))
                if with_text:
                    columns.append(pa.array([t.decode("utf-8", "replace") for t in texts], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return joined.select("text", "spans", *carry).mapInArrow(remove, schema)
