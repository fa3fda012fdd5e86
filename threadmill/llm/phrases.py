"""Phrases of words that belong together, mined from sorted occurrence relations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadmill.llm.common import partitions, settled
from threadmill.llm.files import task_number
from threadmill.llm.words import Chunk, chunks, mix

MIN_COUNT = 10
MAX_WORDS = 3
TOP = 2000
# A phrase goes if a longer one with its words has so many percent of its count.
INSIDE_PERCENT = 50
SCALE = 1_000_000

# Text that makes up a block of occurrences, and packed keys that are counted together.
BLOCK_BYTES = 4 << 20
BUCKET_BYTES = 4 << 20
_MOST_BUCKETS = 1 << 16

# What ends a piece, and what separates words within it.
_ENDS = np.zeros(256, bool)
_ENDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_SEPARATORS = _ENDS.copy()
_SEPARATORS[[0x20, 0x09]] = True

_WORDS = "block long, lang string, n_words long, places binary, codes binary, words binary, counts binary, hashes binary"
_STATE = "block long, word_places binary, words binary, places binary, phrases binary"
_SENT = "bucket long, block long, lang string, words binary, first binary, next binary, counts binary"
_COUNTED = "bucket long, block long, ids binary, lang string, word string, first long, next long, f long, id long"


def _pack(values: np.ndarray, ascending: bool = False) -> bytes:
    """Whole numbers, byte by byte: the high bytes are equal and take no room."""
    steps = np.diff(values, prepend=0) if ascending else values
    return zstandard.compress(np.ascontiguousarray(steps.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _unpack(data: bytes, ascending: bool = False) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1)
    values = np.ascontiguousarray(planes.T).view("<i8").ravel()
    return np.cumsum(values) if ascending else values


def _gather(chunk: Chunk) -> pa.Array:
    """The words of a chunk, one after the other."""
    inside = ~chunk.separators[chunk.data]
    offsets = np.concatenate([[0], np.cumsum(chunk.ends - chunk.starts)]).astype(np.int64)
    data = pa.py_buffer(np.ascontiguousarray(chunk.data[inside]))
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(chunk.starts), [None, pa.py_buffer(offsets), data])


def _places(chunk: Chunk) -> np.ndarray:
    """Numbers of the words, one is left out between pieces: neighbours differ by 1."""
    ended = np.concatenate([[0], np.cumsum(_ENDS[chunk.data])])[chunk.starts]
    new = np.zeros(len(chunk.starts), np.int64)
    new[1:] = (ended[1:] != ended[:-1]) | (chunk.word_text[1:] != chunk.word_text[:-1])
    return np.arange(len(new)) + np.cumsum(new)


def _occurrences(block: int, lang: str, chunk: Chunk) -> tuple:
    """The first relation of a block: places and words, these as numbers in a list
    of its distinct words, which is sorted by their hashes."""
    coded = _gather(chunk).dictionary_encode()
    codes = coded.indices.to_numpy()
    first = np.full(len(coded.dictionary), len(codes))
    np.minimum.at(first, codes, np.arange(len(codes)))
    hashes = chunk.bytes_spans().hash(chunk.starts[first], chunk.ends[first]) >> np.uint64(48)
    order = np.argsort(hashes, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    words = zstandard.compress(b" ".join(coded.dictionary.take(pa.array(order)).to_pylist()), 1)
    counts = np.bincount(codes, minlength=len(order))[order]
    places = _pack(_places(chunk), ascending=True)
    return block, lang, len(codes), places, _pack(rank[codes]), words, _pack(counts), _pack(hashes[order].astype(np.int64), True)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _schema(ddl: str) -> pa.Schema:
    types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(name, types[kind]) for name, kind in (c.split() for c in ddl.split(", "))])


def first_relation(docs: DataFrame) -> DataFrame:
    """Blocks of the occurrences of words in `docs` (text, lang), written, sorted by piece and place."""
    schema = _schema(_WORDS)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = task_number(), 0
        for batch in batches:
            langs = batch.column(1).dictionary_encode()
            codes = langs.indices.to_numpy()
            for code, lang in enumerate(langs.dictionary.to_pylist()):
                texts = batch.column(0).take(pa.array(np.flatnonzero(codes == code)))
                for chunk in chunks(texts, lower=True, size=BLOCK_BYTES):
                    chunk.separators = _SEPARATORS
                    if len(chunk.starts):
                        yield _batch([_occurrences((part << 32) + number, lang, chunk)], schema)
                        number += 1

    chosen = docs.select("text", F.coalesce("lang", F.lit("und")).alias("lang"))
    return settled(chosen.mapInArrow(read, _WORDS))


def _keys(places: np.ndarray, phrases: np.ndarray, word_places: np.ndarray, words: np.ndarray, length: int):
    """The merge join that extends phrases of `length` - 1 words by the next one:
    (places, first, next), where the phrase that begins a word later is frequent too."""
    if not len(places):
        return (np.zeros(0, np.int64),) * 3
    at = np.minimum(np.searchsorted(word_places, places + length - 1), len(word_places) - 1)
    later = np.minimum(np.arange(len(places)) + 1, len(places) - 1)
    keep = (word_places[at] == places + length - 1) & (places[later] == places + 1)
    return places[keep], phrases[keep], words[at[keep]]


def _groups(first: np.ndarray, following: np.ndarray, buckets: int):
    """Distinct keys in order of their buckets: (first, next, bucket, group of each key given, counts)."""
    bucket = (mix(first.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + following.astype(np.uint64)) % np.uint64(buckets))
    order = np.lexsort((following, first, bucket))
    a, b = first[order], following[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    return a[new], b[new], bucket[order][new].astype(np.int64), group, np.diff(np.append(np.flatnonzero(new), len(order)))


def _cuts(bucket: np.ndarray, buckets: int) -> Iterator[tuple[int, int, int]]:
    bounds = np.searchsorted(bucket, np.arange(buckets + 1))
    for i in np.flatnonzero(np.diff(bounds)).tolist():
        yield i, int(bounds[i]), int(bounds[i + 1])


def _numbered(counts: np.ndarray, least: int, buckets: int, bucket: int) -> np.ndarray:
    """An id for every frequent key, small ones for the most frequent; -1 for others."""
    frequent = np.flatnonzero(counts >= least)
    ids = np.full(len(counts), -1)
    ids[frequent[np.argsort(-counts[frequent], kind="stable")]] = np.arange(len(frequent)) * buckets + bucket
    return ids


def _answers(table: pa.Table, bucket: int, group: np.ndarray, sizes: list[int], ids: np.ndarray) -> list[tuple]:
    """What each block is told: the ids of the keys it sent, in its order."""
    ends = np.cumsum([0, *sizes])
    blocks = table.column("block").to_pylist()
    return [
        (bucket, block, _pack(ids[group[a:b]]), None, None, None, None, None, None)
        for block, a, b in zip(blocks, ends, ends[1:])
    ]


class _Miner:
    def __init__(self, least: int):
        self.least = least
        self.sent, self.counted, self.state = _schema(_SENT), _schema(_COUNTED), _schema(_STATE)

    def buckets(self, table: DataFrame, *columns: str) -> int:
        """So many that what a bucket gets stays bounded."""
        total = table.agg(F.sum(sum((F.length(c) for c in columns), F.lit(0)))).first()[0] or 0
        wanted = max(total // BUCKET_BYTES + 1, partitions(table.sparkSession))
        return min(1 << (wanted - 1).bit_length(), _MOST_BUCKETS)

    def count_words(self, relation: DataFrame) -> tuple[DataFrame, int]:
        buckets = self.buckets(relation, "words")
        sent_schema, counted_schema, least = self.sent, self.counted, self.least

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    words = zstandard.decompress(row["words"]).split(b" ")
                    counts = _unpack(row["counts"])
                    bucket = _unpack(row["hashes"], True) * buckets >> 16
                    yield _batch(
                        [
                            (i, row["block"], row["lang"], zstandard.compress(b" ".join(words[a:b]), 1), None, None, _pack(counts[a:b]))
                            for i, a, b in _cuts(bucket, buckets)
                        ],
                        sent_schema,
                    )

        def count(table: pa.Table) -> pa.Table:
            bucket = table.column("bucket")[0].as_py()
            table = table.sort_by("lang")
            rows = table.to_pylist()
            lists = [zstandard.decompress(r["words"]).split(b" ") for r in rows]
            sizes = [len(w) for w in lists]
            langs, start, group, names, of = table.column("lang").to_pylist(), 0, [], [], []
            cuts = [0, *(i for i in range(1, len(langs)) if langs[i] != langs[i - 1]), len(langs)]
            for a, b in zip(cuts, cuts[1:]):
                coded = pa.array([w for some in lists[a:b] for w in some], pa.large_binary()).dictionary_encode()
                group.append(coded.indices.to_numpy() + start)
                names += coded.dictionary.to_pylist()
                of += [langs[a]] * len(coded.dictionary)
                start += len(coded.dictionary)
            group = np.concatenate(group)
            counts = np.bincount(group, np.concatenate([_unpack(r["counts"]) for r in rows]).astype(float)).astype(np.int64)
            ids = _numbered(counts, least, buckets, bucket)
            found = [
                (bucket, None, None, of[i], names[i].decode("utf-8", "replace"), None, None, int(counts[i]), int(ids[i]))
                for i in np.flatnonzero(ids >= 0).tolist()
            ]
            return pa.Table.from_batches([_batch(_answers(table, bucket, group, sizes, ids) + found, counted_schema)])

        sent = relation.select("block", "lang", "words", "counts", "hashes").mapInArrow(send, _SENT)
        return settled(sent.groupBy("bucket").applyInArrow(count, _COUNTED)), buckets

    def keep_words(self, relation: DataFrame, counted: DataFrame) -> DataFrame:
        """The occurrences of frequent words."""
        schema = self.state

        def keep(block: pa.Table, told: pa.Table) -> pa.Table:
            row = block.to_pylist()[0]
            ids = np.concatenate([_unpack(a) for a in told.sort_by("bucket").column("ids").to_pylist()])
            words, places = ids[_unpack(row["codes"])], _unpack(row["places"], True)
            kept = words >= 0
            packed = (_pack(places[kept], True), _pack(words[kept]))
            return pa.Table.from_batches([_batch([(row["block"], *packed, *packed)], schema)])

        answers = counted.where("block IS NOT NULL").select("block", "bucket", "ids")
        occurrences = relation.select("block", "places", "codes")
        return settled(occurrences.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(keep, _STATE))

    def count_phrases(self, state: DataFrame, length: int) -> tuple[DataFrame, int]:
        buckets = self.buckets(state, "places", "phrases")
        sent_schema, counted_schema, least = self.sent, self.counted, self.least

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    _, first, following = _joined(row, length)
                    a, b, bucket, _, counts = _groups(first, following, buckets)
                    yield _batch(
                        [
                            (i, row["block"], None, None, _pack(a[s:e], True), _pack(b[s:e]), _pack(counts[s:e]))
                            for i, s, e in _cuts(bucket, buckets)
                        ],
                        sent_schema,
                    )

        def count(table: pa.Table) -> pa.Table:
            bucket = table.column("bucket")[0].as_py()
            firsts = [_unpack(p, True) for p in table.column("first").to_pylist()]
            a, b, _, group, _ = _groups(
                np.concatenate(firsts), np.concatenate([_unpack(p) for p in table.column("next").to_pylist()]), 1
            )
            sent = np.concatenate([_unpack(p) for p in table.column("counts").to_pylist()])
            counts = np.zeros(len(a), np.int64)
            np.add.at(counts, group, sent)
            ids = _numbered(counts, least, buckets, bucket)
            found = [
                (bucket, None, None, None, None, int(a[i]), int(b[i]), int(counts[i]), int(ids[i]))
                for i in np.flatnonzero(ids >= 0).tolist()
            ]
            return pa.Table.from_batches([_batch(_answers(table, bucket, group, list(map(len, firsts)), ids) + found, counted_schema)])

        return settled(state.mapInArrow(send, _SENT).groupBy("bucket").applyInArrow(count, _COUNTED)), buckets

    def keep_phrases(self, state: DataFrame, counted: DataFrame, length: int, buckets: int) -> DataFrame:
        """The occurrences of frequent phrases of `length` words."""
        schema = self.state

        def keep(block: pa.Table, told: pa.Table) -> pa.Table:
            row = block.to_pylist()[0]
            places, first, following = _joined(row, length)
            *_, group, _ = _groups(first, following, buckets)
            ids = [_unpack(a) for a in told.sort_by("bucket").column("ids").to_pylist()]
            phrases = np.concatenate([np.zeros(0, np.int64), *ids])[group]
            kept = phrases >= 0
            out = (row["block"], row["word_places"], row["words"], _pack(places[kept], True), _pack(phrases[kept]))
            return pa.Table.from_batches([_batch([out], schema)])

        answers = counted.where("block IS NOT NULL").select("block", "bucket", "ids")
        return settled(state.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(keep, _STATE))


def _joined(row: dict, length: int):
    return _keys(
        _unpack(row["places"], True), _unpack(row["phrases"]), _unpack(row["word_places"], True), _unpack(row["words"]), length
    )


def frequent_phrases(docs: DataFrame, least: int = MIN_COUNT, longest: int = MAX_WORDS) -> tuple[DataFrame, DataFrame]:
    """(lang, n) and (lang, words, f): the words of each language, and all phrases
    of up to `longest` words that occur `least` times or more, with their counts.

    The occurrences of words are written as a relation sorted by piece and place,
    in blocks.  For each length it is merge-joined with the frequent phrases a word
    shorter, on the piece and the next place; each block groups and counts its
    keys and sends them, packed, to their buckets, which add up, number the frequent
    ones and answer; the block then keeps the occurrences of these only, and
    that relation is written for the next length.  Blocks and buckets are
    bounded, whatever the language or how frequent a phrase is.
    """
    miner = _Miner(least)
    relation = first_relation(docs)
    totals = relation.groupBy("lang").agg(F.sum("n_words").alias("n"))
    counted, buckets = miner.count_words(relation)
    words = settled(counted.where("id IS NOT NULL").select("lang", "word", "f", "id"))
    found = [words.select("lang", F.array("word").alias("words"), "f", "id")]
    state = None
    for length in range(2, longest + 1):
        state = miner.keep_words(relation, counted) if state is None else miner.keep_phrases(state, counted, length - 1, buckets)
        counted, buckets = miner.count_phrases(state, length)
        keys = counted.where("id IS NOT NULL").select("first", "next", "f", "id")
        shorter = found[-1].select("lang", F.col("words").alias("_words"), F.col("id").alias("_first"))
        last = words.select("word", F.col("id").alias("_next"))
        joined = keys.join(shorter, F.col("first") == F.col("_first")).join(last, F.col("next") == F.col("_next"))
        found.append(settled(joined.select("lang", F.array_append("_words", F.col("word")).alias("words"), "f", "id")))
    phrases = found[0].drop("id")
    for some in found[1:]:
        phrases = phrases.unionByName(some.drop("id"))
    return totals, phrases


def collocations(
    docs: DataFrame,
    least: int = MIN_COUNT,
    longest: int = MAX_WORDS,
    top: int = TOP,
    inside_percent: int = INSIDE_PERCENT,
) -> DataFrame:
    """The `top` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Texts in lower case (A-Z) are split into pieces at `.,;:!?` and line ends, and these
    into words at spaces and tabs.  Counts are per language and cover all
    occurrences, overlaps included; n counts words.  Candidates have two to
    `longest` words and occur a >= `least` times.  Cut after k words, the parts
    occur l and r times, and the score is a * a / (l * r), in millionths, rounded down;
    the lowest counts, of ties the first.  A candidate inside a longer one
    that has `inside_percent` of its count or more goes.  The order is by score and
    a, both descending, then by phrase.

    A null language counts as `und`, a null text as empty; repeated rows count each;
    a table without candidates gives no rows.  Other columns are ignored.
    """
    totals, phrases = frequent_phrases(docs, least, longest)
    named = settled(phrases.withColumn("phrase", F.array_join("words", " ")))
    counts = named.select("lang", F.col("phrase").alias("part"), "f")
    candidates = named.where(F.size("words") > 1)
    size = F.size("words")

    def joined(start: Column, length: Column) -> Column:
        return F.array_join(F.slice("words", start, length), " ")

    cut = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), size - 1))).select(
        "lang", "phrase", F.col("f").alias("a"), "k", joined(F.lit(1), F.col("k")).alias("left"), joined(F.col("k") + 1, size - F.col("k")).alias("right")
    )
    first = counts.select("lang", F.col("part").alias("left"), F.col("f").alias("l"))
    rest = counts.select("lang", F.col("part").alias("right"), F.col("f").alias("r"))
    exact = {c: f"CAST({c} AS DECIMAL(20, 0))" for c in "alr"}
    score = F.expr(f"(CAST({SCALE} AS DECIMAL(7, 0)) * ({exact['a']} * {exact['a']})) div ({exact['l']} * {exact['r']})")
    scored = (
        cut.join(first, ["lang", "left"])
        .join(rest, ["lang", "right"])
        .groupBy("lang", "phrase", "a")
        .agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("lowest"))
    )
    longer = candidates.where(size > 2)
    lengths = longer.withColumn("m", F.explode(F.sequence(F.lit(2), size - 1)))
    inner = lengths.withColumn("at", F.explode(F.sequence(F.lit(1), size - F.col("m") + 1))).select(
        "lang", joined(F.col("at"), F.col("m")).alias("phrase"), "f"
    )
    most = inner.groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    left = scored.join(most, ["lang", "phrase"], "left").where(
        F.col("most").isNull() | (F.col("most") * 100 < F.col("a") * inside_percent)
    )
    order = Window.partitionBy("lang").orderBy(F.desc("lowest.score"), F.desc("a"), "phrase")
    ranked = left.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select(
        "lang",
        F.col("rank").cast("long").alias("rank"),
        "phrase",
        "a",
        F.col("lowest.l").alias("l"),
        F.col("lowest.r").alias("r"),
        "n",
        F.col("lowest.score").alias("score"),
    )
