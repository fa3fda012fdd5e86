"""Repairing the structure of conversations with the fewest edits."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadmill.llm.common import partitions, running_totals, settled

# Rows of the ordered table that are solved together.
SEGMENT = 8192

# The edits and their costs.
KEEP, REROLE, DELETE, INSERT = "KRDI"
COSTS = {KEEP: 0, REROLE: 1, DELETE: 2, INSERT: 5}
TRUNCATED_COST = 5
ROLES = {"u": "user", "a": "assistant"}

# States: nothing yet, after the system turn, after a user's, after an assistant's.
STATES = range(4)
_NEXT = {0: ("u", 2), 1: ("u", 2), 2: ("a", 3), 3: ("u", 2)}
_KEPT = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]
_ENDS = {0, 3}
_FAR = 1 << 60
_SHORT = 32

# (cost, key) for every state before and after: keys of one state order its audits.
Steps = list[list[tuple[int, object]]]


def _inserted(state: int) -> Iterator[tuple[int, int, str]]:
    """(state, cost, audit) after none, one and two inserted turns."""
    for n in range(3):
        yield state, n * COSTS[INSERT], n * INSERT
        state = _NEXT[state][1]


@lru_cache(maxsize=64)
def row_steps(kind: str) -> Steps:
    """The cheapest, then least audits that pass one row: `kind` is the initial of
    its role, in upper case if it is truncated, `d` if it has to go."""
    table: Steps = [[(_FAR, "")] * 4 for _ in STATES]
    extra = TRUNCATED_COST if kind.isupper() else 0
    for before in STATES:
        for state, cost, audit in _inserted(before):
            options = [(state, cost + COSTS[DELETE], audit + DELETE)]
            if kind != "d":
                options.append((_NEXT[state][1], cost + COSTS[REROLE] + extra, audit + REROLE))
                if kind.lower() in _KEPT[state]:
                    options.append((_KEPT[state][kind.lower()], cost + COSTS[KEEP] + extra, audit + KEEP))
            for after, total, edits in options:
                table[before][after] = min(table[before][after], (total, edits))
    return table


def tail(state: int) -> tuple[int, str]:
    """What ends a conversation that is in `state` after its last row."""
    return next((cost, audit) for s, cost, audit in _inserted(state) if s in _ENDS)


def forward(tables: Sequence[Steps], start: int) -> tuple[list[int], list[int]]:
    """Costs to every state, and the order of the least audits that lead there.

    No audit of these rows begins with another one: each ends with the edit of the
    last row.  So audits compare as their beginnings do, and what follows decides only
    between audits that share theirs."""
    costs, ranks = [_FAR] * 4, [0] * 4
    costs[start] = 0
    for table in tables:
        best = [
            min((costs[s] + table[s][t][0], ranks[s], table[s][t][1]) for s in STATES if costs[s] < _FAR) for t in STATES
        ]
        costs = [min(b[0], _FAR) for b in best]
        order = sorted(STATES, key=lambda t: best[t][1:] if costs[t] < _FAR else (4,))
        ranks = [order.index(t) for t in STATES]
    return costs, ranks


def backward(tables: Sequence[Steps], end: int) -> list[int]:
    """Costs from every state to `end`."""
    costs = [_FAR] * 4
    costs[end] = 0
    for table in reversed(tables):
        costs = [min(_FAR, *(table[s][t][0] + costs[t] for t in STATES)) for s in STATES]
    return costs


def crossings(tables: Sequence[Steps], start: int, end: int) -> list[int]:
    """The states after each of `tables` on the cheapest, then least way.

    The costs up to the middle and those from the end back to it meet there; the
    state with the least sum, then the least audit, splits the rest in two.  Only
    two vectors of four are kept for each of the halvings that are open."""
    if len(tables) == 1:
        return [end]
    middle = len(tables) // 2
    costs, ranks = forward(tables[:middle], start)
    back = backward(tables[middle:], end)
    state = min(STATES, key=lambda s: (costs[s] + back[s], ranks[s]))
    return crossings(tables[:middle], start, state) + crossings(tables[middle:], state, end)


def last_state(tables: Sequence[Steps], start: int = 0) -> int:
    """The state after the last row of a whole conversation."""
    costs, ranks = forward(tables, start)
    return min(STATES, key=lambda s: (costs[s] + tail(s)[0], ranks[s]))


def _remembered(function):
    """Most conversations are short, and many of them alike."""
    short = lru_cache(maxsize=1 << 16)(function)
    return lambda kinds, *rest: (short if len(kinds) <= _SHORT else function)(kinds, *rest)


@_remembered
def audits(kinds: str, start: int, end: int) -> list[str]:
    """What is done at each row, between two states."""
    tables = [row_steps(k) for k in kinds]
    states = [start, *crossings(tables, start, end)]
    return [table[s][t][1] for table, s, t in zip(tables, states, states[1:])]


@_remembered
def _matrix(kinds: str) -> bytes:
    tables = [row_steps(k) for k in kinds]
    return np.array([forward(tables, s) for s in STATES], np.int64).tobytes()


def _steps(matrix: bytes) -> Steps:
    values = np.frombuffer(matrix, np.int64).reshape(4, 2, 4).tolist()
    return [list(zip(costs, ranks)) for costs, ranks in values]


_FRAGMENT = """conv_id {key}, segment long, n_rows long, blank long, duplicate long, truncated long,
 illegal long, first string, last string, turns long, low {turn}, high {turn}, matrix binary"""
_SOLVED = "conv_id {key}, segment long, start int, stop int, tail string"
_REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
_LEGAL = {"su", "ua", "au"}


def _arrow(spark: SparkSession, ddl: str) -> pa.Schema:
    return spark.createDataFrame([], ddl).limit(0).toArrow().schema


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _runs(keys: list) -> list[tuple[int, int]]:
    """Bounds of runs of equal values."""
    cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
    return list(zip(cuts, cuts[1:])) if keys else []


def _fragments(table: pa.Table) -> list[tuple[object, dict[str, list]]]:
    """The rows of a segment, conversation by conversation, in order."""
    columns = table.sort_by("rank").to_pydict()
    return [(columns["conv_id"][a], {k: v[a:b] for k, v in columns.items()}) for a, b in _runs(columns["conv_id"])]


def _kinds(rows: dict[str, list]) -> str:
    kinds = []
    for initial, fault in zip(rows["initial"], rows["fault"]):
        known = initial if initial in ("s", "u", "a") else "x"
        kinds.append("d" if fault in ("blank", "duplicate") else known.upper() if fault == "truncated" else known)
    return "".join(kinds)


def _summary(conv_id: object, rows: dict[str, list]) -> tuple:
    faults, initials = rows["fault"], rows["initial"]
    turns = [t for t in rows["turn"] if t is not None]
    return (
        conv_id,
        rows["segment"][0],
        len(faults),
        *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
        sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:])),
        initials[0],
        initials[-1],
        len(_runs(turns)),
        turns[0] if turns else None,
        turns[-1] if turns else None,
        _matrix(_kinds(rows)),
    )


def _solve(fragments: dict[str, list]) -> tuple[list[tuple], tuple]:
    """(start, stop, tail) of each fragment of a conversation, and its report."""
    tables = [_steps(m) for m in fragments["matrix"]]
    end = last_state(tables)
    states = [0, *crossings(tables, 0, end)]
    closing, audit = tail(end)
    cost = sum(table[s][t][0] for table, s, t in zip(tables, states, states[1:])) + closing
    tails = [""] * (len(tables) - 1) + [audit]
    firsts, lasts = fragments["first"], fragments["last"]
    illegal = sum(fragments["illegal"]) + sum(a + b not in _LEGAL for a, b in zip(lasts, firsts[1:]))
    spans = [(a, b) for a, b in zip(fragments["low"], fragments["high"]) if a is not None]
    shared = sum(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    gaps = spans[-1][1] - spans[0][0] + 1 - (sum(fragments["turns"]) - shared) if spans else 0
    report = (gaps, *(sum(fragments[f]) for f in ("blank", "duplicate", "truncated")), illegal, cost)
    return list(zip(states, states[1:], tails)), report


def _edits(rows: dict[str, list], start: int, stop: int, tail: str) -> Iterator[tuple]:
    """(row_id, rank, step, edit, role) for every edit; `role` is what it leaves."""
    state = start
    for row_id, rank, initial, audit in zip(rows["row_id"], rows["rank"], rows["initial"], audits(_kinds(rows), start, stop)):
        for step, edit in enumerate(audit):
            role = None
            if edit == KEEP:
                state = _KEPT[state][initial]
            elif edit != DELETE:
                letter, state = _NEXT[state]
                role = ROLES[letter]
            yield (row_id if edit in (KEEP, REROLE) else None, rank, step, edit, role)
    for step, edit in enumerate(tail):
        letter, state = _NEXT[state]
        yield (None, rows["rank"][-1], len(audit) + step, edit, ROLES[letter])


def faults(rows: DataFrame, order: Sequence[Column]) -> DataFrame:
    """`rows` (row_id, conv_id, turn, role, text) without their texts, with the first
    fault of each (blank, duplicate, truncated or null), its initial, and `rank`.

    A blank text has no character but white space; a duplicate's role and text
    were there earlier in the conversation; a truncated text doesn't end with one of
    `.!?`.  Ranks number all rows; those of a conversation follow each other.
    """
    thin = rows.select(
        "row_id",
        "conv_id",
        "turn",
        F.substring("role", 1, 1).alias("initial"),
        F.md5(F.concat_ws(":", F.length("role"), "role", "text").cast("binary")).alias("content"),
        (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank"),
        (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("truncated"),
        F.lit(1).alias("one"),
    )
    numbered = settled(running_totals(thin, [*order, F.col("content")], "one").drop("offset", "one"))
    firsts = numbered.groupBy("conv_id", "content").agg(F.min("rank").alias("_first")).select("_first")
    fault = (
        F.when(F.col("blank"), "blank").when(F.col("_first").isNull(), "duplicate").when(F.col("truncated"), "truncated")
    )
    return numbered.join(firsts, F.col("rank") == F.col("_first"), "left").select(
        "row_id", "conv_id", "turn", "initial", fault.alias("fault"), "rank"
    )


def repair_conversations(conversations: DataFrame, segment: int = SEGMENT) -> tuple[DataFrame, DataFrame]:
    """Repair `conversations` (conv_id, turn, role, text) so that each one's roles
    are a system turn or none, then pairs of a user's and an assistant's turns.

    Returns two tables.  Reports: conv_id, gaps, blank, duplicate, truncated,
    illegal, cost.  Edits, in order of `rank` and `step`: conv_id, edit, and the
    role and text they leave, which are null for a deletion.

    Keeping a row costs nothing, another role 1, deleting it 2, which blank and
    duplicate rows must be, inserting an empty turn 5; a truncated row that stays
    costs 5 more.  Of the cheapest repairs the one whose edits' initials come first
    in ASCII order is taken.

    Rows are numbered over the whole table and dealt into segments of `segment`
    rows; each reduces its part of a conversation to the costs, and order, of the
    ways from each of four states to each.  These are joined per conversation to
    find the states between the parts; then every part is solved by halving.
    So a conversation of any length is spread over tasks.

    Rows of a conversation apply by turn, nulls first; those of one turn by the
    role's initial, then by a digest of role and text, so repeated rows follow each other.  Null roles and texts count as one space,
    null conversations as one conversation.  Conversations without rows have no
    report.  Other columns are ignored.
    """
    types = dict(conversations.dtypes)
    key, turn = types["conv_id"], types["turn"]
    space = F.lit(" ")
    rows = settled(
        conversations.select(
            F.monotonically_increasing_id().alias("row_id"),
            "conv_id",
            "turn",
            F.coalesce("role", space).alias("role"),
            F.coalesce("text", space).alias("text"),
        )
    )
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("initial")]
    segments = settled(faults(rows, order).withColumn("segment", F.expr(f"rank div {segment}")))
    fragment = _FRAGMENT.format(key=key, turn=turn)

    def summarise(table: pa.Table) -> pa.Table:
        return _table([_summary(conv_id, rows) for conv_id, rows in _fragments(table)], fragment_schema)

    def solve(table: pa.Table) -> pa.Table:
        whole = table.sort_by("segment").to_pydict()
        parts, report = _solve(whole)
        reports = [report] + [(None,) * len(report)] * (len(parts) - 1)
        out = [(c, s, *p, *r) for c, s, p, r in zip(whole["conv_id"], whole["segment"], parts, reports)]
        return _table(out, solved_schema)

    def edit(given: pa.Table, solved: pa.Table) -> pa.Table:
        ways = {c: w for c, *w in zip(*(solved.column(n).to_pylist() for n in ("conv_id", "start", "stop", "tail")))}
        out = [(conv_id, *e) for conv_id, rows in _fragments(given) for e in _edits(rows, *ways[conv_id])]
        return _table(out, edit_schema)

    spark = conversations.sparkSession
    solved_ddl = _SOLVED.format(key=key) + ", " + _REPORT
    edit_ddl = f"conv_id {key}, row_id long, rank long, step int, edit string, role string"
    fragment_schema, solved_schema, edit_schema = (_arrow(spark, ddl) for ddl in (fragment, solved_ddl, edit_ddl))

    parts = segments.groupBy("segment").applyInArrow(summarise, fragment)
    solved = settled(parts.groupBy("conv_id").applyInArrow(solve, solved_ddl))
    edits = segments.groupBy("segment").cogroup(solved.groupBy("segment")).applyInArrow(edit, edit_ddl)
    texts = rows.select("row_id", F.col("role").alias("_role"), F.col("text").alias("_text"))
    left = F.when(F.col("edit") != DELETE, F.coalesce("_text", F.lit("")))
    repaired = edits.join(texts, "row_id", "left").select(
        "conv_id", "rank", "step", "edit", F.coalesce("role", "_role").alias("role"), left.alias("text")
    )
    reports = solved.where(F.col("cost").isNotNull())
    return reports.select("conv_id", *(c.split()[0] for c in _REPORT.split(", "))), repaired


def repaired_digests(edits: DataFrame) -> DataFrame:
    """conv_id, audit (initials of the edits) and repaired_sha256 (of `role:text`,
    joined by line feeds) of the edits of :func:`repair_conversations`.

    Rows are sorted inside each task and pass through it one after the other."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        key, audit, digest, turns = None, [], None, 0
        for batch in batches:
            for conv_id, edit, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if digest is None or conv_id != key:
                    if digest is not None:
                        done.append((key, "".join(audit), digest.hexdigest()))
                    key, audit, digest, turns = conv_id, [], hashlib.sha256(), 0
                audit.append(edit)
                if edit != DELETE:
                    digest.update(("\n" * (turns > 0) + f"{role}:{text}").encode("utf-8", "surrogatepass"))
                    turns += 1
            if done:
                yield from _table(done, schema).to_batches()
                done.clear()
        if digest is not None:
            yield from _table([(key, "".join(audit), digest.hexdigest())], schema).to_batches()

    ddl = f"conv_id {dict(edits.dtypes)['conv_id']}, audit string, repaired_sha256 string"
    spark = edits.sparkSession
    schema = _arrow(spark, ddl)
    ordered = edits.repartition(partitions(spark), "conv_id").sortWithinPartitions("conv_id", "rank", "step")
    return ordered.select("conv_id", "edit", "role", "text").mapInArrow(read, ddl)


def damaged(conversations: DataFrame) -> DataFrame:
    """`conversations` with faults, chosen by the checksum of `conv_id:turn`: of 20
    rows one is dropped, one loses its text, one its `.!?`, one is repeated and one is
    given to the user.  Nulls count as one space there."""
    place = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    which = F.crc32(place.cast("binary")) % 20
    copies = F.when(which == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    text = F.coalesce("text", F.lit(" "))
    marked = conversations.where(which != 0).select(
        "conv_id",
        "turn",
        F.when(which == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(which == 1, "").when(which == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        copies.alias("_copies"),
    )
    return marked.withColumn("_copy", F.explode("_copies")).drop("_copies", "_copy")


def repair_report(conversations: DataFrame, rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """One row for each conversation of `conversations`, on how its `rows` were
    repaired: the report, the audit and a digest of the repaired rows.  Without
    rows, numbers are 0 and texts are empty."""
    reports, edits = repair_conversations(rows, segment)
    digests = repaired_digests(edits)
    ids = conversations.select("conv_id").distinct()
    numbers = [c.split()[0] for c in _REPORT.split(", ")]

    def same(other: DataFrame) -> Column:
        return ids["conv_id"].eqNullSafe(other["conv_id"])

    nothing = hashlib.sha256().hexdigest()
    return (
        ids.join(reports, same(reports), "left")
        .join(digests, same(digests), "left")
        .select(
            ids["conv_id"],
            *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers),
            F.coalesce("audit", F.lit("")).alias("audit"),
            F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"),
        )
    )
