"""Repairs of conversations against a search of all edits."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from threadmill.llm.queries import QUERIES
from threadmill.llm.structure import crossings, damaged, last_state, repair_report, row_steps, tail

SPACES = " \t\n\x0b\x0c\r"


def damage(rows):
    for conv_id, turn, role, text in rows:
        key = f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}"
        which = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if which == 0:
            continue
        if which == 1:
            text = ""
        if which == 2:
            text = re.sub("[.!?]", "", text)
        if which == 4:
            role = "user"
        yield from [(conv_id, turn, role, text)] * (2 if which == 3 else 1)


def place(row):
    _, turn, role, text = row
    content = hashlib.md5(f"{len(role)}:{role}:{text}".encode()).hexdigest()
    return (turn is not None, turn or 0, role[:1], content)


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        body = text.strip(SPACES)
        if not body:
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            out.append("" if body[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows, found):
    """(cost, audit, repaired) over all edits, row by row, from the costs of all states."""
    follows = {"": "u", "s": "u", "u": "a", "a": "u"}
    names = {"u": "user", "a": "assistant"}

    def insert(best):
        for _ in range(2):
            for state, (cost, audit, out) in list(best.items()):
                to = follows[state]
                option = (cost + 5, audit + "I", (*out, f"{names[to]}:"))
                best[to] = min(best.get(to, option), option)
        return best

    best = {"": (0, "", ())}
    for (_, _, role, text), fault in zip(rows, found):
        after = {}

        def offer(state, option):
            after[state] = min(after.get(state, option), option)

        for state, (cost, audit, out) in insert(dict(best)).items():
            offer(state, (cost + 2, audit + "D", out))
            if fault in ("blank", "duplicate"):
                continue
            more = 5 if fault == "truncated" else 0
            to = follows[state]
            offer(to, (cost + 1 + more, audit + "R", (*out, f"{names[to]}:{text}")))
            if role[:1] == to or (state == "" and role[:1] == "s"):
                offer(role[:1], (cost + more, audit + "K", (*out, f"{role}:{text}")))
        best = after
    return min(v for state, v in insert(best).items() if state in ("", "a"))


def expected(original):
    groups = defaultdict(list)
    for row in damage(original):
        groups[row[0]].append(row)
    out = {}
    for conv_id in {r[0] for r in original}:
        rows = sorted(groups[conv_id], key=place)
        found = faults(rows)
        turns = [r[1] for r in rows if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        pairs = zip([r[2][:1] for r in rows], [r[2][:1] for r in rows[1:]])
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in pairs)
        cost, audit, repaired = cheapest(rows, found)
        digest = hashlib.sha256("\n".join(repaired).encode()).hexdigest()
        counts = [found.count(f) for f in ("blank", "duplicate", "truncated")]
        out[conv_id] = (gaps, *counts, illegal, cost, audit, digest)
    return out


def same(report, original):
    want, got = expected(original), report.collect()
    assert len(got) == len(want)
    for r in got:
        assert tuple(r)[1:] == want[r.conv_id], r.conv_id


def test_halving_finds_the_least_audit():
    random.seed(3)
    for _ in range(2000):
        kinds = random.choices("sSuUaAxXd", k=random.randint(1, 14))
        names = {"s": "system", "u": "user", "a": "assistant", "x": "tool", "d": "user"}
        rows = [(0, i, names[k.lower()], "") for i, k in enumerate(kinds)]
        found = ["blank" if k == "d" else "truncated" if k.isupper() else "" for k in kinds]
        tables = [row_steps(k) for k in kinds]
        end = last_state(tables)
        states = [0, *crossings(tables, 0, end)]
        steps = [t[a][b] for t, a, b in zip(tables, states, states[1:])] + [tail(end)]
        assert (sum(c for c, _ in steps), "".join(a for _, a in steps)) == cheapest(rows, found)[:2]


@pytest.fixture(scope="module")
def odd():
    random.seed(8)
    rows = [
        (0, 0, "user", "x."),
        (1, None, None, None),
        (1, None, "user", "a."),
        (1, 2**40, "assistant", "b."),
        (None, 1, "user", "a."),
        (None, 1, "user", "a."),
        (None, None, "assistant", "ok!\n "),
        (2, 3, "", " \t\r\n"),
        (2, 4, "tool", "é"),
        (3, 1, "user", "long " * 50_000),
    ]
    for conv_id in range(10, 80):
        for turn in range(random.randint(1, 12)):
            role = random.choice(["user", "assistant", "system", "tool", "user", "assistant"])
            rows.append((conv_id, turn + turn // 5, role, random.choice(["a.", "b", "c?", "", " ", "d!", "e.\n"])))
    rows += [(99, random.choice([None, i]), random.choice(["user", "assistant"]), f"{i % 70}.") for i in range(700)]
    return rows


@pytest.mark.parametrize("segment", [1, 7, 8192])
def test_odd_conversations(spark, odd, segment):
    schema = "conv_id long, turn long, role string, text string, rank int, fault string"
    given = spark.createDataFrame([(*r, 5, "x") for r in odd], schema).repartition(3)
    same(repair_report(given, damaged(given), segment), odd)


def test_conversations(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    same(QUERIES["op12_conversation_repair"](spark, sf_dir), [tuple(r) for r in rows])


def test_no_conversations(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair_report(empty, damaged(empty)).collect() == []
