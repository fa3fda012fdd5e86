"""Marked words against the library, on whole texts."""

from __future__ import annotations

import hashlib
import random

import pytest
from sentencepiece import SentencePieceProcessor

from threadmill.llm import pieces
from threadmill.llm.pieces import decode_pieces, default_model, encode_pieces
from threadmill.llm.queries import QUERIES

ODD = [
    "", " ", "  ", "   a", "a ", "a  ", " a  b   c ", "\n", "a\n b", "▁", "▁a▁▁b", "a▁ b", "\x00a \x00",
    "ﬁ Å", "é é", "<s> </s> <unk> <0x41>", "a\tb \t c", "　x  y", "\U0001f600 \U0001f468‍\U0001f469",
    "<s>", "x" * 5000, " " * 5000, "﻿a", "  b", "؀ ́ a",
]


def hashed(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=default_model())


def check(rows, texts, library):
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        want = library.encode(texts[r.doc_id] or "")
        assert list(r.ids) == want, texts[r.doc_id]
        assert r.text == library.decode(want)


def test_odd_texts(spark, library):
    random.seed(5)
    some = "ab ▁é\n.,<>\U0001f600́"
    texts = dict(enumerate([None, *ODD, *("".join(random.choices(some, k=random.randint(1, 40))) for _ in range(500))]))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    check(decode_pieces(encode_pieces(docs)).collect(), texts, library)


def test_small_table_and_chunks(spark, library, documents, monkeypatch):
    """A table that overflows, and texts in many chunks, change nothing."""
    monkeypatch.setattr(pieces, "TABLE_WORDS", 50)
    monkeypatch.setattr(pieces, "CHUNK_BYTES", 2000)
    table = pieces.MarkedWords(default_model())
    texts = [r.text or "" for r in documents.limit(40).collect()]
    import pyarrow as pa

    marked = pa.array([" " + t if t else t for t in texts])
    got = []
    for chunk in pieces.chunks(marked, size=2000):
        ids, bounds = table.encode(chunk)
        got += [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])]
    assert got == [library.encode(t) for t in texts]


def test_documents(spark, library, documents, sf_dir):
    got = {r.doc_id: r for r in QUERIES["op11_sentence_pieces"](spark, sf_dir).collect()}
    rows = documents.collect()
    assert len(rows) == len(got)
    for r in rows:
        ids = library.encode(r.text or "")
        have = got[r.doc_id]
        assert (have.n_tokens, have.ids_sha256) == (len(ids), hashed(",".join(map(str, ids))))
        assert have.decoded_sha256 == hashed(library.decode(ids))


def test_odd_rows(odd_documents, no_documents, library):
    rows = decode_pieces(encode_pieces(odd_documents, carry=("doc_id", "size", "shard"))).collect()
    given = sorted((repr(r.doc_id), r["size"], r.text or "") for r in odd_documents.collect())
    assert sorted((repr(r.doc_id), r["size"], r.text) for r in rows) == given
    assert encode_pieces(no_documents).collect() == []
    with pytest.raises(ValueError):
        encode_pieces(odd_documents.withColumnRenamed("size", "ids"), carry=("ids",))


def test_models_that_cross_markers_are_refused(monkeypatch):
    class Crossing:
        def __init__(self, model_file):
            pass

        def get_piece_size(self):
            return 1

        def id_to_piece(self, i):
            return "a▁b"

    monkeypatch.setattr("sentencepiece.SentencePieceProcessor", Crossing)
    with pytest.raises(ValueError):
        pieces.MarkedWords("any")
