"""Written formats: what is read back equals what went in."""

from __future__ import annotations

import base64
import hashlib
import io
import tracemalloc
import zipfile
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from threadmill.llm.chats import best_paths, chains, conversation_digests, format_conversations, parse_part
from threadmill.llm.common import scratch_path
from threadmill.llm.repair import LEAST, ShardFile, compress, shard_bytes
from threadmill.llm.tokens import default_tokenizer, read_token_shards, token_ids, write_token_shards
from threadmill.llm.zipwarc import archived_pages, stored_at, zip_bytes, zip_members

TABLES = pytest.mark.parametrize("table", ["documents", "odd_documents", "no_documents"])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(3, 9), max_size=60), max_size=12))
def test_repair_round_trip(docs):
    ids = np.array([i for d in docs for i in [*d * 20, 2]], np.uint32)
    counts = np.array([20 * len(d) + 1 for d in docs], np.int64)
    keys = [None if i % 4 == 3 else i for i in range(len(docs))]
    shard = ShardFile(pa.BufferReader(b"".join(shard_bytes(keys, counts, ids, 70_000, 2))))
    assert shard.doc_ids == keys and shard.n_ids == len(ids)
    for i, d in enumerate(docs):
        assert shard.document(i).tolist() == [*d * 20, 2]
    assert shard.documents(0, len(docs)).tolist() == ids.tolist()


@pytest.mark.parametrize("doc", [[5], [5, 6, 7], []])
def test_rules_end_with_their_document(doc):
    docs = [[*doc, 2], [8, *doc, 2]] * 200 + [[*doc, 2]] * 200
    ids, counts = np.concatenate(docs).astype(np.uint32), np.array([len(d) for d in docs])
    shard = ShardFile(pa.BufferReader(b"".join(shard_bytes(list(range(600)), counts, ids, 100, 2))))
    assert [shard.document(i).tolist() for i in range(600)] == docs


@pytest.mark.parametrize("distinct", [1, 1_000, 40_000])
def test_rules_take_little_memory(distinct):
    ids = np.random.default_rng(distinct).integers(3, 3 + distinct, 1 << 21).astype(np.uint32)
    tracemalloc.start()
    compress(ids, 50_000, 2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 * len(ids)


def test_repair_compresses():
    ids = np.append(np.tile(np.arange(10, 20, dtype=np.uint32), 5000), 2)
    shard = ShardFile(pa.BufferReader(b"".join(shard_bytes([1], np.array([len(ids)]), ids, 100, 2))))
    assert shard.n_symbols < len(ids) // 10 and (shard.document(0) == ids).all()


@TABLES
def test_token_ids(table, request):
    from tokenizers import Tokenizer

    docs = request.getfixturevalue(table)
    tokenizer = Tokenizer.from_file(default_tokenizer())
    rows = docs.select("doc_id", "text").collect()
    encoded = tokenizer.encode_batch([r.text or "" for r in rows], add_special_tokens=False)
    expected = Counter()
    for r, e in zip(rows, encoded):
        ids = [*e.ids, 2]
        expected[r.doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    got = sorted(token_ids(docs).collect(), key=lambda r: r.start)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == expected
    start = 0
    for r in got:
        assert r.start == start
        start += r.n_tokens
    keys = [(r.doc_id is not None, r.doc_id) for r in got]
    assert keys == sorted(keys, key=lambda k: (k[0], k[1] or 0))


def test_pieces_encode_like_whole_texts(spark):
    from tokenizers import Tokenizer

    texts = ["<|endoftext|>", "A<|STARTOFTEXT|>b", "it's. don'T' 'S x'.", "éÁ. É!", "\x1cq\x1d", "日本語。テスト", "x…. a1b2.", "''", "İ. ß. ΟΔΟΣ."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    folder = scratch_path(spark)
    shards = write_token_shards(docs, folder, shard_ids=5)
    assert shards.count() > 1
    got = {r.doc_id: r.ids_crc32 for r in read_token_shards(spark, folder, shards).collect()}
    encoded = Tokenizer.from_file(default_tokenizer()).encode_batch(texts, add_special_tokens=False)
    assert got == {i: zlib.crc32(np.array([*e.ids, 2], "<u4").tobytes()) for i, e in enumerate(encoded)}


@pytest.mark.parametrize("wide", [False, True])
def test_zip_packages_are_zip_files(wide):
    members = [("a/b.bin", [b"one", b"two"]), ("é.txt", [])]
    data = b"".join(zip_bytes(members, zip64=wide))
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        assert z.testzip() is None and {n: z.read(n) for n in z.namelist()} == {n: b"".join(p) for n, p in members}
    source = pa.BufferReader(data)
    found = zip_members(source, len(data))
    for name, pieces in members:
        assert source.read_at(found[name].size, stored_at(source, found[name])) == b"".join(pieces)


def test_packages_of_other_writers():
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_STORED) as z:
        z.comment = b"a comment"
        with z.open("big", "w", force_zip64=True) as f:
            f.write(b"x" * 1000)
        z.writestr(zipfile.ZipInfo("packed"), b"y" * 100, zipfile.ZIP_DEFLATED)
    data = buffer.getvalue()
    source, found = pa.BufferReader(data), zip_members(pa.BufferReader(data), len(data))
    assert source.read_at(1000, stored_at(source, found["big"])) == b"x" * 1000
    with pytest.raises(ValueError):
        stored_at(source, found["packed"])
    with pytest.raises(ValueError):
        zip_members(pa.BufferReader(b"no package"), 10)


def _archived(rows):
    last = {}
    for page_id, _, html in rows:
        if page_id is not None:
            last[html or ""] = max(last.get(html or "", page_id), page_id)
    out = Counter()
    copies = Counter(html or "" for _, _, html in rows)
    for page_id, _, html in rows:
        b, newest = (html or "").encode(), last.get(html or "")
        revisit = copies[html or ""] > 1 and newest is not None and newest != page_id
        digest = base64.b32encode(hashlib.sha1(b).digest()).decode()
        out[page_id, len(b), digest, "revisit" if revisit else "response", newest if revisit else None] += 1
    return out


def test_archives(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    odd = [(1, "u", "same"), (9, "u", "same"), (9, "u", "same"), (None, "u", "same"), (2, None, None), (3, "a\r\nb: c", ""), (None, None, "null id"), (4, "u", "é" * 200_000)]
    for table in (pages, spark.createDataFrame(odd, pages.schema).withColumn("sha1", F.lit("x")), pages.where("false")):
        rows = [tuple(r)[:3] for r in table.collect()]
        got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in archived_pages(table).collect())
        assert got == _archived(rows)


def _digests(rows):
    turns = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        turns.setdefault(conv, []).append((role or "", text or ""))
    out = {}
    for conv, own in turns.items():
        loss = "".join(t for r, t in own if r == "assistant")
        every = "".join(f"{r}\n{t}\n" for r, t in own)
        out[conv] = (len(own), hashlib.sha256(every.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_conversations(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    odd = [
        (-1, 0, "user", "</s>[INST] ok [/INST]"),
        (-1, 1, "assistant", "\\l \\\\ <s>\\b[ \n</s>\n"),
        (-2, None, None, None),
        (-2, 0, "assistant", None),
        (-2, 0, "assistant", "é" * 70_000),
        (-2, 0, "assistant", "tie"),
        (None, 3, "user", "no id"),
        (-3, 0, "user", "dup"),
        (-3, 0, "user", "dup"),
        *[(-4, i, ["user", "assistant"][i % 2], f"turn {i}") for i in range(700)],
    ]
    odd = spark.createDataFrame(odd, table.schema)
    for rows in (table.unionByName(odd).withColumn("score", F.lit("x")), table.where("false")):
        got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in conversation_digests(format_conversations(rows)).collect()}
        assert got == _digests([tuple(r)[:4] for r in rows.collect()])


def test_chains_number_a_long_conversation_by_ranges(spark):
    """One conversation of most rows, equal turns, beginnings in common, and repeated rows."""
    long = "x" * 300
    rows = [(7, (i * 37) % 1000 if i % 50 else None, "ua"[i % 2], long + str(i % 9) if i % 3 else None) for i in range(4000)]
    rows += [(None, 2, "u", "b"), (None, 1, "u", "a"), (8, None, None, None), (8, None, None, None)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    nodes = chains(table).collect()
    assert len({n.node_id for n in nodes}) == len(rows)
    by_tree = {t: sorted((n for n in nodes if n.tree_id == t), key=lambda n: n.node_id) for t in (7, 8, None)}

    def low(*values):
        return tuple((v is not None, v if v is not None else 0) for v in values)

    for tree, found in by_tree.items():
        expected = sorted((r[1:] for r in rows if r[0] == tree), key=lambda r: low(*r))
        assert [(n.role, n.text) for n in found] == [r[1:] for r in expected]
        assert [n.parent_id for n in found] == [None, *(n.node_id for n in found[:-1])]


def test_control_strings_are_escaped(spark):
    rows = [(1, 0, "user", "</s>[INST] ok [/INST]"), (1, 1, "assistant", "<s>")]
    written = format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).first()
    assert written.formatted.count("</s>") == 2 and "[INST]" not in written.formatted
    assert parse_part(written.formatted) == [(r, t) for _, _, r, t in rows]


def test_best_paths_of_trees(spark):
    rng = np.random.default_rng(11)
    nodes = []
    for tree in range(20):
        for node in range(int(rng.integers(1, 60))):
            parent = None if node == 0 or rng.random() < 0.03 else int(rng.integers(0, node))
            nodes.append((tree, node, parent, float(rng.integers(0, 4)) if rng.random() < 0.9 else None))
    nodes += [(99, 1, 2, 1.0), (99, 2, 1, 1.0), (99, 3, 2, 1.0), (98, 1, 77, 1.0)]
    got = {}
    for r in best_paths(spark.createDataFrame(nodes, "tree_id long, node_id long, parent_id long, score double"), 2).collect():
        got.setdefault((r.tree_id, r.path), {})[r.depth] = r.node_id
    of = {(t, n): (p, s or 0.0) for t, n, p, s in nodes}
    expected = {}
    for tree in {t for t, *_ in nodes}:
        parents = {p for (t, _), (p, _) in of.items() if t == tree and (t, p) in of}
        ranked = []
        for (t, n), _ in of.items():
            if t != tree or n in parents:
                continue
            path, at = [], n
            while at is not None and (t, at) in of and at not in path:
                path.append(at)
                at = of[t, at][0]
            if at is not None and (t, at) in of:
                continue
            ranked.append((-sum(of[t, x][1] for x in path) / len(path), -len(path), n, path[::-1]))
        for place, (*_, path) in enumerate(sorted(ranked)[:2], 1):
            expected[tree, place] = dict(enumerate(path))
    assert got == expected


def test_token_ids_of_letters_that_compose_in_lower_case_only(spark):
    from tokenizers import Tokenizer

    letters = ["H\u0331", "J\u030c", "T\u0308", "W\u030a", "Y\u030a"]
    texts = [f"{c}ello, HELLO {c}. x{c}{c}!? <{c}> A\u0300B=\u0338 \u212a {c}" for c in letters] + letters
    tokenizer = Tokenizer.from_file(default_tokenizer())
    ids = [[*e.ids, 2] for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in token_ids(docs).collect()}
    assert got == {i: (len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in enumerate(ids)}


@pytest.mark.parametrize("copies", [1, 300])
def test_repair_leaves_no_frequent_pair(copies):
    rng = np.random.default_rng(copies)
    ids = np.tile(rng.integers(3, 40 if copies == 1 else 40_000, 20_000 // copies), copies)
    ids[999::1000] = 2
    grammar = compress(ids, 40_000, 2)
    left, right = grammar.symbols[:-1], grammar.symbols[1:]
    pairs = np.stack([left, right])[:, left != 2]
    # Of overlapping places only some can be replaced: equal neighbours count half.
    often = np.unique(pairs[:, pairs[0] != pairs[1]], axis=1, return_counts=True)[1]
    assert often.max() < LEAST
    assert grammar.lengths.max() > 32 or copies == 1
