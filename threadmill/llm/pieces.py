"""Encoding texts with a SentencePiece model, and decoding the ids."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadmill.llm.words import Chunk, chunks

# White space in pieces is this character; a text starts with one that is not in it.
MARKER = "▁"
CHUNK_BYTES = 2 << 20
# So many texts are copied and marked together.
ROWS = 1000
# The table starts anew beyond so many distinct marked words, or bytes of them.
TABLE_WORDS = 300_000
TABLE_BYTES = 32 << 20

_SPACE = 0x20
_ONE_SPACE, _NOTHING = (pa.scalar(s, pa.large_string()) for s in (" ", ""))
# White space in runs, at both ends and of other kinds, and letters that normalisation would change.
_PROBE = "  a  ﬁ\tÅ　é \n "


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _processor(path: str):
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    if any(re.search(f"[^{MARKER}]{MARKER}", p) for p in pieces):
        raise ValueError("the model has pieces that cross a white-space marker")
    if model.decode(model.encode(_PROBE)) != _PROBE or model.encode("a b") != model.encode("a") + model.encode("b"):
        raise ValueError("the model changes texts before it segments them")
    return model


class MarkedWords:
    """The ids of distinct marked words: runs of markers with what follows them.

    No piece reaches from within a marked word over the next marker, so merges in
    one never touch another, and the ids of a text are those of its marked words
    one after the other.  Words are told apart by their bytes, not by hashes.
    """

    def __init__(self, path: str):
        self.model = _processor(path)
        self.marker = self.model.piece_to_id(MARKER)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.bytes = 0
        self.starts = np.zeros(1, np.int64)
        self.flat = np.zeros(0, np.int32)

    def _segment(self, words: list[bytes]) -> list[list[int]]:
        """The library puts the first marker before a text by itself, but not before an empty one."""
        ids = self.model.encode([w[1:].decode("utf-8", "replace") for w in words], num_threads=1)
        return [i if len(w) > 1 else [self.marker] for w, i in zip(words, ids)]

    def _numbers(self, words: list[bytes]) -> np.ndarray:
        """The places of distinct words in the table, after segmenting those it lacks."""
        if len(self.known) + len(words) > TABLE_WORDS or self.bytes > TABLE_BYTES:
            self._forget()
        found = np.fromiter((self.known.get(w, -1) for w in words), np.int64, len(words))
        new = np.flatnonzero(found < 0)
        if len(new):
            fresh = [words[i] for i in new.tolist()]
            ids = self._segment(fresh)
            lengths = np.fromiter(map(len, ids), np.int64, len(ids))
            found[new] = len(self.starts) - 1 + np.arange(len(new))
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lengths)])
            self.flat = np.concatenate(
                [self.flat, np.fromiter(chain.from_iterable(ids), np.int32, int(lengths.sum()))]
            )
            self.known.update(zip(fresh, found[new].tolist()))
            self.bytes += sum(map(len, fresh))
        return found

    def encode(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts of `chunk`, bounds per text); each text that is not
        empty begins with a space that stands for its first marker."""
        space = chunk.data == _SPACE
        opens = space.copy()
        opens[1:] &= ~space[:-1]
        first = chunk.offsets[:-1][np.diff(chunk.offsets) > 0]
        opens[first] = True
        starts = np.flatnonzero(opens)
        offsets = np.append(starts, len(chunk.data)).astype(np.int64)
        words = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(chunk.data)]
        ).dictionary_encode()
        numbers = self._numbers(words.dictionary.to_pylist())[words.indices.to_numpy()]
        begin = self.starts[numbers]
        lengths = self.starts[numbers + 1] - begin
        sums = np.concatenate([[0], np.cumsum(lengths)])
        places = np.arange(int(sums[-1])) - np.repeat(sums[:-1] - begin, lengths)
        return self.flat[places], sums[np.searchsorted(starts, chunk.offsets)]


@lru_cache(maxsize=1)
def _table(path: str) -> MarkedWords:
    return MarkedWords(path)


def encode_pieces(docs: DataFrame, model: str | None = None, carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns `carry` of `docs`, and `ids`: those of the model for the whole
    text, without begin and end ids.

    Each task keeps a table of distinct marked words: a word is segmented when the
    task first meets it, and ids are joined back by position, for a few MB of text
    at a time.  The table is bounded; beyond that it starts anew.  Nothing is
    shuffled.  The model may have no piece that crosses a marker and may not change texts,
    which is verified.

    A null text counts as empty and has no ids.  Repeated rows and ids come back
    as they are; columns that are not carried are ignored, so none can clash but a
    carried `ids`, which is an error.
    """
    path = model or default_model()
    if "ids" in carry:
        raise ValueError("the result has a column ids of its own")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, len(b), ROWS)):
            texts = pc.replace_substring(batch.column(0).cast(pa.large_string()).fill_null(""), MARKER, " ")
            marked = pc.if_else(pc.equal(texts, ""), texts, pc.binary_join_element_wise(_ONE_SPACE, texts, _NOTHING))
            for chunk in chunks(marked, size=CHUNK_BYTES):
                ids, bounds = _table(path).encode(chunk)
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
                rows = batch.slice(chunk.first, len(chunk))
                yield pa.RecordBatch.from_arrays([*rows.columns[1:], lists], [*rows.schema.names[1:], "ids"])

    chosen = docs.select(F.col("text").alias("_text"), *carry)
    kept = [docs.schema[c] for c in carry]
    return chosen.mapInArrow(encode, T.StructType([*kept, T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def decode_pieces(encoded: DataFrame, model: str | None = None, ids: str = "ids", text: str = "text") -> DataFrame:
    """`encoded` with the column `text`, decoded from `ids` by the library; a null
    list of ids counts as empty.  A column of that name is replaced."""
    path = model or default_model()
    rest = [c for c in encoded.columns if c != text]
    at = rest.index(ids)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        processor = _table(path).model
        for batch in batches:
            lists = batch.column(at)
            texts = [
                processor.decode(lists[i].values.to_pylist()) if lists[i].is_valid else "" for i in range(len(lists))
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*rest, text])

    fields = [encoded.schema[c] for c in rest]
    return encoded.select(*rest).mapInArrow(decode, T.StructType([*fields, T.StructField(text, T.StringType())]))
