"""Phrases against a count of all of them."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest

from threadmill.llm import phrases
from threadmill.llm.phrases import collocations

UPPER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def expected(rows, least=10, longest=3, top=2000):
    counts, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(UPPER)):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for size in range(1, longest + 1):
                counts[lang].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in candidates.items():
            score, _, l, r = min(
                (10**6 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p))
            )
            inside = any(
                100 * b >= 50 * a and p in [q[i : i + len(p)] for i in range(len(q) - len(p) + 1)]
                for q, b in candidates.items()
                if len(q) > len(p)
            )
            if not inside:
                scored.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def table(spark, rows):
    schema = "lang string, text string, words string, f int, phrase string, id string, block int"
    return spark.createDataFrame([(*r, "x", 1, "x", "x", 0) for r in rows], schema).repartition(3)


@pytest.mark.parametrize("least,longest,top", [(2, 3, 2000), (3, 5, 7), (10, 2, 50)])
def test_random_texts(spark, least, longest, top, monkeypatch):
    random.seed(least)
    words = ["a", "B", "é", "ß,", "c.", "x\x0by", "d", "e\t", "f!", "\x1f", "g;h", "A", "\x00"]
    rows = [
        (random.choice(["en", None, "und", "fr"]), " ".join(random.choices(words, k=random.randint(0, 60))))
        for _ in range(80)
    ]
    rows += [("en", None), ("en", ""), ("en", " .\n, "), ("de", "a a a a a a a a a a a a a a")] + [rows[0]] * 12
    got = sorted(tuple(r) for r in collocations(table(spark, rows), least, longest, top).collect())
    assert got == expected(rows, least, longest, top)


def test_many_blocks_and_a_long_text(spark, monkeypatch):
    """The same for texts in many blocks; products pass 64 bits at other scales too."""
    random.seed(1)
    long = " ".join(random.choices(["one", "two", "three,", "four"], k=60_000))
    rows = [("en", long), ("en", "one two three four " * 2000), (None, "one two")]
    got = sorted(tuple(r) for r in collocations(table(spark, rows)).collect())
    assert got == expected(rows)


def test_no_candidates(spark, no_documents):
    assert collocations(no_documents).collect() == []
    assert collocations(table(spark, [("en", "a b c"), (None, None)])).collect() == []


def test_packed_numbers():
    for values in ([], [0], [5, -1, 2**62, -(2**62)]):
        assert phrases._unpack(phrases._pack(phrases.np.array(values, int))).tolist() == values
    assert phrases._unpack(phrases._pack(phrases.np.array([1, 1, 7, 2**40]), True), True).tolist() == [1, 1, 7, 2**40]
