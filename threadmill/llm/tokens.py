"""Token ids of documents in compressed shard files."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadmill.llm.common import partitions, running_totals, scratch_path, settled, small_side
from threadmill.llm.files import located, task_number, write_new
from threadmill.llm.repair import ShardFile, shard_bytes
from threadmill.llm.words import Chunk, chunks, split_punctuation

END_ID = 2
SHARD_IDS = 1 << 22
_CACHED_PIECES = 1_500_000
_SLOTS = 1 << 20
_RECENT = 1 << 16
_TOGETHER = 50
_DOCS_AT_ONCE = 256

_MANIFEST = "part long, number long, name string, n_docs long, n_ids long"
_READ = "part long, number long, place long, doc_id long, first long, n_tokens long, ids_crc32 long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _put(array: np.ndarray, at: int, values: np.ndarray) -> np.ndarray:
    """`array` with `values` at a place, made longer by half where it is too short."""
    if at + len(values) > len(array):
        longer = np.zeros((at + len(values)) * 3 // 2, array.dtype)
        longer[:at] = array[:at]
        array = longer
    array[at : at + len(values)] = values
    return array


def _merged(*tables: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    hashes, numbers = (np.concatenate(columns) for columns in zip(*tables))
    order = np.argsort(hashes, kind="stable")
    return hashes[order], numbers[order]


class WordEncoder:
    """Ids of texts from the ids of their pieces, each encoded once.

    The tokenizer composes letters (NFC), lower-cases, splits at white space and
    drops it, none of which reaches across white space; so a text's ids are those
    of its words, and a word's are those of its letters followed by those of the
    ASCII punctuation after them.  Words of ASCII only are lower-cased before that,
    others are left to the tokenizer.  Pieces are told apart by 64-bit hashes.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.size = max(max(vocabulary.values()), END_ID) + 1
        self.closes = np.zeros(self.size, bool)
        self.closes[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        # Hashes, ascending, and the numbers of their pieces: all but the last ones learned, and these.
        self.known = [(np.zeros(0, np.uint64), np.zeros(0, np.int32))] * 2
        self.keys = np.zeros(_SLOTS, np.uint64)
        self.values = np.full(_SLOTS, -1, np.int32)
        # Piece i has the ids flat[starts[i] : starts[i + 1]]; both arrays have room to grow.
        self.pieces = 0
        self.starts = np.zeros(1, np.int64)
        self.flat = np.zeros(1, np.uint32)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _ids(self, pieces: list[bytes]) -> list[list[int]]:
        """Words of letters go to the tokenizer many at a time; each of them ends
        with the only id that closes a word."""
        texts = [p.decode("utf-8", "replace") for p in pieces]
        plain = [i for i, t in enumerate(texts) if t.isalpha()]
        alone = [i for i, t in enumerate(texts) if not t.isalpha()]
        groups = [plain[i : i + _TOGETHER] for i in range(0, len(plain), _TOGETHER)]
        out: list[list[int]] = [[]] * len(pieces)
        for group, ids in zip(groups, self._encode([" ".join([texts[i] for i in g]) for g in groups])):
            cuts = (np.flatnonzero(self.closes[ids]) + 1).tolist()
            if len(cuts) != len(group) or cuts[-1] != len(ids):
                alone += group
                continue
            begin = 0
            for i, end in zip(group, cuts):
                out[i] = ids[begin:end]
                begin = end
        for i, ids in zip(alone, self._encode([texts[i] for i in alone])):
            out[i] = ids
        return out

    def _learn(self, hashes: np.ndarray, pieces: list[bytes]) -> None:
        ids = self._ids(pieces)
        first, last = self.pieces, self.pieces + len(ids)
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        begin = int(self.starts[first])
        ends = begin + np.cumsum(lengths)
        self.starts = _put(self.starts, first + 1, ends)
        self.flat = _put(self.flat, begin, np.fromiter(chain.from_iterable(ids), np.uint32, int(lengths.sum())))
        self.pieces = last
        most, recent = self.known
        recent = _merged(recent, (hashes, np.arange(first, last, dtype=np.int32)))
        if len(recent[0]) > _RECENT:
            most, recent = _merged(most, recent), (recent[0][:0], recent[1][:0])
        self.known = [most, recent]

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        found = np.full(len(hashes), -1, np.int64)
        for known, numbers in self.known:
            if len(known):
                at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                found = np.where(known[at] == hashes, numbers[at], found)
        return found

    def _numbers(self, raw: bytes, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each piece; most are found in a table of recent ones."""
        if self.pieces > _CACHED_PIECES:
            self._forget()
        slots = hashes & np.uint64(_SLOTS - 1)
        numbers = np.where(self.keys[slots] == hashes, self.values[slots], -1).astype(np.int64)
        missed = np.flatnonzero(numbers < 0)
        if len(missed):
            distinct, places, inverse = np.unique(hashes[missed], return_index=True, return_inverse=True)
            found = self._find(distinct)
            new = np.flatnonzero(found < 0)
            at = missed[places[new]]
            found[new] = self.pieces + np.arange(len(new))
            self._learn(distinct[new], [raw[s:e] for s, e in zip(starts[at].tolist(), ends[at].tolist())])
            self.keys[distinct & np.uint64(_SLOTS - 1)] = distinct
            self.values[distinct & np.uint64(_SLOTS - 1)] = found
            numbers[missed] = found[inverse]
        return numbers

    def encode(self, chunk: Chunk, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each closed by `end_id`; how many each text has)."""
        raw = chunk.data.tobytes()
        if b"<|" in raw:  # perhaps a special token, which is not split or lower-cased
            texts = [chunk.text(i).decode("utf-8", "replace") for i in range(len(chunk))]
            ids = [[*i, end_id] for i in self._encode(texts)]
            return np.array(list(chain.from_iterable(ids)), np.uint32), np.array(list(map(len, ids)))
        starts, ends, bounds = split_punctuation(chunk)
        raw = chunk.data.tobytes()
        numbers = self._numbers(raw, chunk.bytes_spans().hash(starts, ends), starts, ends)
        begin = self.starts[numbers]
        lengths = self.starts[numbers + 1] - begin
        sums = np.concatenate([[0], np.cumsum(lengths)])
        counts = sums[bounds[1:]] - sums[bounds[:-1]] + 1
        out = np.empty(int(sums[-1]) + len(chunk), np.uint32)
        keep = np.ones(len(out), bool)
        closing = np.cumsum(counts) - 1
        keep[closing] = False
        out[closing] = end_id
        out[keep] = self.flat[np.arange(int(sums[-1])) - np.repeat(sums[:-1] - begin, lengths)]
        return out, counts


@lru_cache(maxsize=1)
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def write_token_shards(
    docs: DataFrame,
    folder: str,
    tokenizer: str | None = None,
    end_id: int = END_ID,
    shard_ids: int = SHARD_IDS,
) -> DataFrame:
    """Write the ids of `docs` (doc_id, text) in ascending order of doc_id to
    shard files in `folder`; returns the written list of them: part, number (their
    order), name, n_docs, n_ids.

    A file closes after the document that reaches `shard_ids`; whatever the
    size of a partition, a task holds one file's ids.  A null text counts as
    empty: its only id is `end_id`.  Null ids come first, rows with equal ids are
    ordered by their texts' hashes.  Files of failed attempts are not listed.
    An empty table writes no file.  Other columns are ignored.
    """
    path = tokenizer or default_tokenizer()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, number = _encoder(path), task_number(), 0
        doc_ids: list[int | None] = []
        counts: list[np.ndarray] = []
        ids: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            whole = np.concatenate(ids)
            ids.clear()
            pieces = shard_bytes(doc_ids, np.concatenate(counts), whole, encoder.size, end_id)
            name = write_new(folder, f"tokens-{part:06d}-{number:05d}", ".rpr", pieces)
            row = [[part], [number], [name], [len(doc_ids)], [len(whole)]]
            doc_ids.clear(), counts.clear()
            return pa.RecordBatch.from_arrays([pa.array(v) for v in row], ["part", "number", "name", "n_docs", "n_ids"])

        waiting = 0
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for chunk in chunks(batch.column(1)):
                got, n = encoder.encode(chunk, end_id)
                doc_ids += keys[chunk.first : chunk.first + len(chunk)]
                ids.append(got)
                counts.append(n)
                waiting += len(got)
                if waiting >= shard_ids:
                    yield close()
                    number, waiting = number + 1, 0
        if doc_ids:
            yield close()

    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())
    dealt = tied.repartitionByRange(partitions(spark), *order, F.col("_tie"))
    ordered = dealt.sortWithinPartitions(*order, F.col("_tie")).select("doc_id", "text")
    return settled(ordered.mapInArrow(write, _MANIFEST))


def read_token_shards(spark: SparkSession, folder: str, shards: DataFrame) -> DataFrame:
    """One row per document from the listed files: doc_id, start (ids of all
    documents before it), n_tokens, ids_crc32 (of the ids as little-endian
    unsigned 32-bit integers)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = located(folder)
        for batch in batches:
            for part, number, name in zip(*(batch.column(i).to_pylist() for i in range(3))):
                with system.open_input_file(f"{path}/{name}") as source:
                    shard = ShardFile(source)
                    for first in range(0, shard.n_docs, _DOCS_AT_ONCE):
                        last = min(first + _DOCS_AT_ONCE, shard.n_docs)
                        raw = memoryview(shard.documents(first, last).astype("<u4").tobytes())
                        at = 4 * (shard.id_starts[first : last + 1] - shard.id_starts[first])
                        crcs = [zlib.crc32(raw[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                        n = last - first
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([part] * n, pa.int64()),
                                pa.array([number] * n, pa.int64()),
                                pa.array(range(first, last), pa.int64()),
                                pa.array(shard.doc_ids[first:last], pa.int64()),
                                pa.array(shard.id_starts[first:last]),
                                pa.array(np.diff(at) // 4),
                                pa.array(crcs, pa.int64()),
                            ],
                            ["part", "number", "place", "doc_id", "first", "n_tokens", "ids_crc32"],
                        )

    named = shards.select("part", "number", "name").repartition(partitions(spark) * 4, "part", "number")
    read_back = named.mapInArrow(read, _READ)
    starts = running_totals(shards, [F.col("part"), F.col("number")], "n_ids")
    starts = settled(starts.select("part", "number", "offset"))
    return read_back.join(small_side(starts), ["part", "number"]).select(
        "doc_id", (F.col("offset") + F.col("first")).alias("start"), "n_tokens", "ids_crc32"
    )


def token_ids(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write the ids of `docs` to a new folder and read them back."""
    folder = scratch_path(docs.sparkSession)
    shards = write_token_shards(docs, folder, tokenizer)
    return read_token_shards(docs.sparkSession, folder, shards)
