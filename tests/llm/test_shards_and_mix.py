"""Sharding and mixing against plain Python."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from threadmill.llm.mixing import BLOCK_WORDS, mix_sources, mixed_documents, source_quotas
from threadmill.llm.sharding import byte_shards


@pytest.mark.parametrize("table", ["documents", "odd_documents", "no_documents"])
def test_shards(table, request):
    docs = request.getfixturevalue(table)
    rows = docs.select("doc_id", "text").collect()
    expected = sorted(
        ((r.doc_id is not None, r.doc_id or 0), len(b) + 1, zlib.crc32(b))
        for r in rows
        for b in [(r.text or "").encode()]
    )
    total, before, places, slots = sum(e[1] for e in expected), 0, [], Counter()
    for key, size, crc in expected:
        shard = min((2 * before + size) * 8 // (2 * total), 7)
        places.append((key[1] if key[0] else None, size, crc, shard, slots[shard]))
        slots[shard] += 1
        before += size
    got = [(r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in byte_shards(docs).collect()]
    assert Counter(got) == Counter(places)


def _targets(sizes: list[int]) -> list[float]:
    """Shares by weight; whoever is above the limit stops there, and again."""
    weights = [(5.0, 2.0, 1.0)[i % 3] for i in range(len(sizes))]
    share, stopped = 1.5 * sum(sizes), set()
    while True:
        free = [i for i in range(len(sizes)) if i not in stopped]
        left = share - sum(2 * sizes[i] for i in stopped)
        level = left / sum(weights[i] for i in free) if free else 0
        above = {i for i in free if level * weights[i] > 2 * sizes[i]}
        if not above:
            return [2.0 * s if i in stopped else level * weights[i] for i, s in enumerate(sizes)]
        stopped |= above


@pytest.mark.parametrize("sizes", [[5000, 10, 900, 0, 70], [64 * 9] * 7, [1], [0, 0], list(range(1, 400, 7))])
def test_quotas_are_those_of_the_highest_quotients(spark, sizes):
    named = [(f"s{i:03d}" if i < len(sizes) - 1 else None, s) for i, s in enumerate(sizes)]
    got = source_quotas(spark.createDataFrame(named, "source string, source_size long")).orderBy("number").collect()
    targets = _targets(sizes)
    assert [r.target for r in got] == pytest.approx(targets)
    total = int(sum(targets) / BLOCK_WORDS + 0.5)
    quotients = sorted(
        (-t / (2 * k - 1), i)
        for i, (t, s) in enumerate(zip([r.target for r in got], sizes))
        for k in range(1, 2 * -(-s // BLOCK_WORDS) + 1)
    )
    assert [r.quota for r in got] == [Counter(i for _, i in quotients[:total])[i] for i in range(len(sizes))]


@pytest.mark.parametrize("table", ["documents", "odd_documents", "no_documents"])
def test_mix(table, request, words):
    docs = request.getfixturevalue(table)
    mixed = mix_sources(docs)
    rows = mixed.collect()
    assert len(rows) == docs.count()
    of_source = defaultdict(list)
    for r in rows:
        spans = sum(s.stop - s.start for s in r.spans)
        assert r.taken == r.epochs * r.size + spans <= 2 * r.size
        of_source[r.source].append(r)
    for own in of_source.values():
        assert {r.source_size for r in own} == {sum(r.size for r in own)}
        assert abs(sum(r.taken for r in own) - own[0].target) <= 2 * BLOCK_WORDS
    again = mix_sources(docs.repartition(5)).collect()
    assert Counter(map(str, rows)) == Counter(map(str, again))


def test_mixed_documents_have_the_words_taken(odd_documents, documents):
    for docs in (odd_documents, documents):
        taken = mix_sources(docs).groupBy("doc_id").agg(F.sum("taken").alias("n")).where("n > 0")
        out = mixed_documents(docs)
        assert out.columns == docs.columns
        counted = out.select("doc_id", F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).alias("n"))
        got = counted.groupBy("doc_id").agg(F.sum("n").alias("n"))
        assert Counter(map(tuple, got.collect())) == Counter(map(tuple, taken.collect()))
