"""Operators on texts against brute force."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadmill.llm import jaccard, substrings
from threadmill.llm.components import components
from threadmill.llm.decontaminate import ItemIndex, RADIUS, contaminated, without_items
from threadmill.llm.jaccard import jaccard_groups, one_per_group
from threadmill.llm.language import fit_language, predict_language
from threadmill.llm.quality import SYMBOLS, fit_quality, good_documents, score_quality
from threadmill.llm.substrings import remove_repeated

TABLES = pytest.mark.parametrize("table", ["documents", "odd_documents", "no_documents"])


@TABLES
def test_language(table, request, documents):
    docs = request.getfixturevalue(table)
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    model = fit_language(documents.where(remainder != 2))
    got = predict_language(docs, model, carry=("doc_id", "text", "lang")).withColumn("held_out", remainder == 2)
    rows = got.collect()
    assert len(rows) == docs.count()
    for r in rows:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letters) and 0 <= r.score <= 1
    if table == "documents":
        held = [r for r in rows if r.held_out]
        assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)


def test_language_without_examples(odd_documents, no_documents):
    assert fit_language(no_documents) is None
    assert {r.lang_pred for r in predict_language(odd_documents, None).collect()} == {"und"}


@TABLES
def test_base_counts(table, request, words):
    docs = request.getfixturevalue(table)
    scored = score_quality(docs, None, carry=("doc_id", "text")).collect()
    assert len(scored) == docs.count()
    for r in scored:
        w = words(r.text)
        lines = [line for line in (r.text or "").split("\n") if words(line)]
        windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        often = Counter(windows)
        covered = {j for i, x in enumerate(windows) if often[x] > 1 for j in range(i, i + 3)}
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(w),
            sum(map(len, w)),
            sum(c in SYMBOLS for c in r.text or ""),
            len(lines) - len(set(lines)),
            len(covered),
        )
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and r.kept != r.base_failed


def test_quality_verdicts(spark, sf_dir, documents, odd_documents, no_documents):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    # fitted on one half of the labels, judged on the other
    model = fit_quality(documents, labels.where("doc_id % 2 = 0"))
    judged = score_quality(documents, model).join(labels.where("doc_id % 2 = 1"), "doc_id").where("NOT base_failed")
    rows = judged.collect()
    assert sum(r.kept == (r.quality == 1) for r in rows) >= 0.97 * len(rows)
    kept = good_documents(odd_documents, labels)
    assert kept.columns == odd_documents.columns and kept.where("text IS NULL").isEmpty()
    assert fit_quality(documents, labels.where("quality = 1")) is None
    assert good_documents(no_documents, labels).isEmpty()


@TABLES
@pytest.mark.parametrize("hot", [2, 1000])
def test_substrings(table, hot, request, words, monkeypatch):
    monkeypatch.setattr(substrings, "HOT", hot)
    docs = request.getfixturevalue(table)
    window = 35 if table == "documents" else 8
    rows = remove_repeated(docs, window, carry=("doc_id", "text")).collect()
    assert len(rows) == docs.count()
    often = Counter()
    for r in rows:
        w = words(r.text)
        often.update(tuple(w[i : i + window]) for i in range(len(w) - window + 1))
    for r in rows:
        w = words(r.text)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if often[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        assert (r.n_words, r.n_removed) == (len(w), sum(gone))
        assert r.kept_sha256 == hashlib.sha256(kept.encode()).hexdigest()


def test_substrings_in_one_text(spark, words):
    text = " ".join(["x"] * 40 + [f"u{i}" for i in range(40)])
    row = remove_repeated(spark.createDataFrame([(1, text)], "doc_id long, text string"), with_text=True).first()
    assert row.n_removed == 40 and row.kept_text == " ".join(f"u{i}" for i in range(40))


def _groups(rows, lowered):
    """Shingle sets and components of rows (doc_id, text), pair by pair."""
    sets = []
    for r in rows:
        w = lowered(r.text)
        sets.append(frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)]))
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = defaultdict(list)
    for i, s in enumerate(sets):
        shared = Counter(j for t in s for j in where[t])
        for j, n in shared.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                parent[root(i)] = root(j)
        for t in s:
            where[t].append(i)
    ids = defaultdict(list)
    for i, r in enumerate(rows):
        ids[root(i)].append(r.doc_id)
    least = {k: min((d for d in v if d is not None), default=None) for k, v in ids.items()}
    return [(r.doc_id, len(sets[i]), least[root(i)]) for i, r in enumerate(rows)], [root(i) for i in range(len(rows))]


@TABLES
@pytest.mark.parametrize("bar", [1, 64])
def test_jaccard(table, bar, request, lowered, monkeypatch):
    monkeypatch.setattr(jaccard, "FREQUENT", bar)
    docs = request.getfixturevalue(table)
    expected, _ = _groups(docs.select("doc_id", "text").collect(), lowered)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_groups(docs).collect()]
    assert Counter(got) == Counter(expected)


def test_jaccard_of_edited_copies(spark, lowered, monkeypatch):
    """A group of copies with edits near the threshold, most pairs of which are no links."""
    monkeypatch.setattr(jaccard, "FREQUENT", 8)
    rng = np.random.default_rng(3)
    base = [f"b{i}" for i in range(160)]
    rows = []
    for d in range(150):
        own = list(base)
        for i in rng.choice(160, rng.integers(0, 7), replace=False):
            own[i] = f"x{rng.integers(0, 25)}"
        rows.append((d, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    expected, _ = _groups(docs.collect(), lowered)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_groups(docs).collect()]
    assert Counter(got) == Counter(expected)


def test_jaccard_sends_texts_of_a_group_once(spark, lowered, monkeypatch):
    """Of a group in which all pairs are compared, texts are not sent once per pair."""
    monkeypatch.setattr(jaccard, "FREQUENT", 8)
    sent, small_side = [], jaccard.small_side

    def counting(written, *rest):
        sent.append(written.count() if "_key" in written.columns else 0)
        return small_side(written, *rest)

    monkeypatch.setattr(jaccard, "small_side", counting)
    rng = np.random.default_rng(5)
    rows = []
    for d in range(150):
        own = [f"b{i}" for i in range(160)]
        for i in rng.choice(160, 6, replace=False):
            own[i] = f"x{rng.integers(0, 25)}"
        rows.append((d, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    expected, _ = _groups(docs.collect(), lowered)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_groups(docs).collect()]
    assert Counter(got) == Counter(expected) and sum(sent) < 4 * len(rows), sent


@TABLES
def test_one_document_stays(table, request, lowered):
    docs = request.getfixturevalue(table)
    rows = docs.select("doc_id", "text").collect()
    _, roots = _groups(rows, lowered)
    stays = one_per_group(docs)
    assert stays.columns == docs.columns
    with_words = {roots[i] for i, r in enumerate(rows) if lowered(r.text)}
    empty = sum(not lowered(r.text) for r in rows)
    assert stays.count() == len(with_words) + empty


def test_components(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1300)]
    parent: dict[int, int] = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: root(n) for n in {x for a, b in edges if a != b for x in (a, b)}}


def _contaminated(docs, items, lowered):
    shingles = lambda w: Counter([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])
    out = {}
    for d, text in docs:
        w = lowered(text)
        for i, item in items:
            want = lowered(item)
            if not want or len(want) > len(w) or not set(shingles(want)) & set(shingles(w) if len(want) > 4 else [tuple(w[a : a + len(want)]) for a in range(len(w))]):
                continue
            best = None
            for a in range(len(w) - len(want) + 1):
                x, y = shingles(w[a : a + len(want)]), shingles(want)
                shared, union = sum((x & y).values()), sum((x | y).values())
                if 100 * shared >= 75 * union and (best is None or shared / union > best[0]):
                    best = (shared / union, a)
            if best:
                out[d, i] = best
    return out


def test_decontamination(spark, sf_dir, documents, lowered):
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    items = [tuple(r) for r in benchmark.select("item_id", "text").collect()]
    rng = np.random.default_rng(7)
    planted = []
    for d, (_, text) in enumerate(items[:60]):  # passages with up to four words replaced, between other words
        w = text.split()
        for i in range(int(rng.integers(0, 5))):
            w[i] = "changed"
        planted.append((100_000 + d, " ".join(["before"] * 20 + w + ["after"] * 20)))
    docs = documents.select("doc_id", "text").limit(300).unionByName(
        spark.createDataFrame(planted, "doc_id long, text string")
    )
    rows = [tuple(r) for r in docs.collect()]
    expected = _contaminated(rows, items, lowered)
    got = {(r.doc_id, r.item_id): (r.similarity, r.first_word) for r in contaminated(docs, benchmark, 40).collect()}
    assert set(got) <= set(expected) and len(got) >= 0.97 * len(expected) and len(expected) >= 40
    assert all(got[k] == pytest.approx(expected[k]) for k in got)


def test_decontamination_of_odd_rows(spark, odd_documents, no_documents):
    items = [(1, "One TWO"), (None, "a b c d e f g h"), (2, None), (3, " "), (1, "no such words in any text at all")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in contaminated(odd_documents, benchmark).collect()}
    assert got == {(8, 1), (1, None), (None, None)}
    left = without_items(odd_documents, benchmark)
    assert left.columns == odd_documents.columns and left.count() == odd_documents.count() - 4
    assert contaminated(no_documents, benchmark).isEmpty()
    assert contaminated(odd_documents, benchmark.where("false")).isEmpty()


def test_all_fingerprints_within_the_radius_are_found():
    rng = np.random.default_rng(1)
    index = ItemIndex.of(list(range(50)), [f"item {i} with some words of its own {i * 7}" for i in range(50)])
    bits = np.unpackbits(index.fingerprints.astype(">u2").view(np.uint8), axis=1)
    asked, expected = [], set()
    for row in range(400):
        item, flips = int(rng.integers(0, 50)), rng.choice(128, rng.integers(0, RADIUS + 6), replace=False)
        b = bits[item].copy()
        b[flips] ^= 1
        asked.append(np.packbits(b).view(">u2"))
        expected |= {(row, int(i)) for i in np.flatnonzero((bits != b).sum(axis=1) <= RADIUS)}
    got = index.near(np.array(asked).astype(np.uint16))
    assert set(zip(*(x.tolist() for x in got))) == expected


def test_decontamination_with_a_repeated_filler(spark, lowered):
    """Windows at the threshold, whose last words are all the same; others hold the item's own repeats."""
    items, docs = [], []
    for i in range(6):
        w = [f"w{i}x{j}" for j in range(144)]
        if i > 3:
            w[40:70] = ["again"] * 30
        items.append((i, " ".join(w)))
        docs.append((i, " ".join(["before"] * 9 + w[:124] + ["____"] * 40)))
        docs.append((10 + i, " ".join(["____"] * 30 + w[20:] + ["after"] * 9)))
    got = contaminated(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    )
    expected = _contaminated(docs, items, lowered)
    assert len(expected) == 12
    found = {(r.doc_id, r.item_id): (r.similarity, r.first_word) for r in got.collect()}
    assert set(found) == set(expected) and all(found[k] == pytest.approx(expected[k]) for k in found)


def test_decontamination_of_texts_shorter_than_an_item(spark, lowered):
    def shingles(w):
        return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))

    rng = np.random.default_rng(11)
    items, docs = [], []
    for i in range(40):
        size = int(rng.integers(5, 70))
        w = [f"w{rng.integers(0, 30)}x{i}" for _ in range(size)]
        items.append((i, " ".join(w)))
        for cut in range(0, min(size, 20), 3):
            begin = int(rng.integers(0, cut + 1))
            own = w[begin : begin + size - cut]
            if cut % 2:
                own[int(rng.integers(0, len(own)))] = "changed"
            docs.append((len(docs), " ".join(own)))
    items.append((40, docs[0][1] + " and more"))
    expected = _contaminated(docs, items, lowered)
    n_whole = len(expected)
    for d, text in docs:
        for i, item in items:
            x, y = shingles(lowered(text)), shingles(lowered(item))
            shared, union = sum((x & y).values()), sum((x | y).values())
            if len(lowered(text)) < len(lowered(item)) and shared and 100 * shared >= 75 * union:
                expected[d, i] = (shared / union, 0)
    got = contaminated(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    )
    rows = got.collect()
    assert len(expected) >= n_whole + 40
    found = {(r.doc_id, r.item_id): (r.similarity, r.first_word) for r in rows}
    assert set(found) == set(expected) and all(found[k] == pytest.approx(expected[k]) for k in found)
    n_words = {d: len(lowered(t)) for d, t in docs}
    assert all(r.n_words == min(n_words[r.doc_id], len(lowered(items[r.item_id][1]))) for r in rows)


def test_no_pairs_where_too_few_tokens_are_shared_outside_the_partner(spark, monkeypatch):
    """Copies of one text, too far from it and each other to link, that share its words and a last one."""
    rng = random.Random(11)
    base = [f"w{i}" for i in range(150)]

    def edited(words, places):
        return [f"e{rng.random()}" if i in places else w for i, w in enumerate(words)]

    far = [edited(base, {10 + 22 * k + rng.randrange(6) for k in range(6)}) + ["same"] for _ in range(40)]
    texts = [base, *far, *(edited(f, {rng.randrange(20, 140)}) for f in far[:5])]
    compared = []
    verified = jaccard.verified

    def counted(docs, classes, pairs, shipped, extras=True):
        if not extras:
            compared.append(pairs.count())
        return verified(docs, classes, pairs, shipped, extras)

    monkeypatch.setattr(jaccard, "verified", counted)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_groups(docs).collect()}
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    want = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 100 * len(a & b) >= 75 * len(a | b):
                want = [min(want[i], want[j]) if w in (want[i], want[j]) else w for w in want]
    assert got == dict(enumerate(want)) and len(set(want)) < len(texts)
    # All pairs of the 46 would be 1035.
    assert compared[0] < 200
