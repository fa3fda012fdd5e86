from __future__ import annotations

import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")

# Nulls, empty and white-space texts, ties, repeated rows and a long text.
ODD_TEXTS = [
    (1, "a b c d e f g h"),
    (1, "a b c d e f g h"),
    (1, "another text under the same id"),
    (None, "a b c d e f g h"),
    (None, None),
    (2, None),
    (3, ""),
    (4, " \n\t "),
    (5, "é"),
    (6, "ÉTÉ été\n\nété  x\x0by   z"),
    (7, " ".join(f"w{i}" for i in range(30_000))),
    (8, "one two"),
]


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Odd rows, with columns whose names operators might use themselves."""
    rows = [(d, t, None if i % 3 else "en", ["b", None, "a"][i % 3], 0, i, "x") for i, (d, t) in enumerate(ODD_TEXTS)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, size int, shard string"
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.where("false")


@pytest.fixture(scope="session")
def words():
    return lambda text: WORD.findall(text or "")


@pytest.fixture(scope="session")
def lowered(words):
    upper = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
    return lambda text: words((text or "").translate(upper))
