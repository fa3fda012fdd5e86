"""Rate rules against the rule applied event by event."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import numpy as np
import pytest

from threadmill.operators import rates
from threadmill.streaming.rates import admitted_events, stream_rate_admitted

START = datetime(2024, 1, 1)
SCHEMA = "event_id bigint, client string, at timestamp, note bigint"


def step_by_step(times, limit, span):
    admitted, flags = [], []
    for t in times:
        ok = sum(t - a < span for a in admitted) < limit
        flags.append(ok)
        if ok:
            admitted.append(t)
    return flags


@pytest.mark.parametrize("seed", range(60))
def test_admit(seed):
    rng = random.Random(seed)
    limit, span = rng.randrange(1, 6), rng.randrange(1, 30)
    times = np.array(sorted(rng.randrange(200) for _ in range(rng.randrange(0, 150))), dtype=np.int64)
    expected = step_by_step(times.tolist(), limit, span)
    whole, _ = rates.admit(times, np.empty(0, dtype=np.int64), limit, span)
    assert whole.tolist() == expected
    cut, recent, parts = rng.randrange(0, len(times) + 1), np.empty(0, dtype=np.int64), []
    for piece in (times[:cut], times[cut:]):
        flags, recent = rates.admit(piece, recent, limit, span)
        parts += flags.tolist()
    assert parts == expected


def random_events(n, seed, seconds):
    """Calm and busy times, a client that never rests, and events without a client."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        client = rng.choice(["busy"] * 3 + ["a", "b", None])
        burst = rng.random() < 0.5
        second = rng.choice([50, 400, 410, 1000]) + rng.randrange(12) if burst else rng.randrange(seconds)
        if client == "busy":
            second = rng.randrange(0, 600)
        rows.append((i, client, START + timedelta(seconds=second, microseconds=rng.randrange(3)), None))
    # Too large for a double: must come through unharmed.
    rows.append((n, "a", START, 2**60 + 1))
    return rows


def expected_flags(rows, limit, seconds):
    flags = {}
    for client in {r[1] for r in rows}:
        mine = sorted((r for r in rows if r[1] == client), key=lambda r: (r[2], r[0]))
        micros = [(r[2] - START) // timedelta(microseconds=1) for r in mine]
        for r, ok in zip(mine, step_by_step(micros, limit, seconds * 1_000_000)):
            flags[r[0]] = ok
    return flags


@pytest.mark.parametrize("limit, window", [(3, 10), (1, 7), (20, 60), (100, 1)])
def test_rate_admitted(spark, limit, window):
    rows = random_events(1500, limit, 3000)
    events = spark.createDataFrame(rows, SCHEMA)
    got = rates.rate_admitted(events, "client", "at", "event_id", limit, window)
    assert got.columns == [*events.columns, "admitted"]
    found = got.collect()
    assert len(found) == len(rows)
    assert {r.event_id: r.admitted for r in found} == expected_flags(rows, limit, window)
    assert {r.note for r in found} == {None, 2**60 + 1}


@pytest.mark.parametrize("block_windows", [1, 8])
def test_offered_load(spark, block_windows):
    rows, window = random_events(1200, 9, 2000), 10
    events = spark.createDataFrame(rows, SCHEMA)
    got = rates.offered_load(events, "client", "at", window, block_windows)
    assert got.columns == [*events.columns, "offered"]
    found = {r.event_id: r.offered for r in got.collect()}
    span = timedelta(seconds=window)
    assert found == {
        r[0]: sum(o[1] == r[1] and r[2] - span < o[2] <= r[2] for o in rows) for r in rows
    }


def test_exempt_paths(spark):
    df = spark.createDataFrame([("/health",), ("/health/",), ("/healthy",), (None,)], "path string")
    assert [r.path for r in rates.not_exempt(df).collect()] == ["/healthy", None]


def test_stream_equals_batch(spark, tmp_path):
    rows = random_events(900, 4, 900)
    rows.sort(key=lambda r: (r[2], r[0]))
    source = tmp_path / "in"
    for i in range(3):
        part = rows[i * len(rows) // 3 : (i + 1) * len(rows) // 3]
        if i < 2:
            part = [*part, (-1 - i, "busy", None, None)]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(source))
    events = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(source))
    query = stream_rate_admitted(events, "client", "at", "event_id", str(tmp_path / "rates"), 3, 10)
    query.awaitTermination()
    assert len(query.recentProgress) >= 3
    found = admitted_events(spark, str(tmp_path / "rates")).collect()
    assert len(found) == len(rows) + 2
    want = expected_flags(rows, 3, 10) | {-1: None, -2: None}
    assert {r.event_id: r.admitted for r in found} == want


def test_events_without_a_time_stay(spark):
    rows = [(1, "a", START, 1), (2, "a", None, 2), (3, None, None, 3)]
    events = spark.createDataFrame(rows, SCHEMA)
    admitted = rates.rate_admitted(events, "client", "at", "event_id", 1, 10).collect()
    assert {r.event_id: r.admitted for r in admitted} == {1: True, 2: None, 3: None}
    offered = rates.offered_load(events, "client", "at", 10).collect()
    assert {r.event_id: r.offered for r in offered} == {1: 1, 2: None, 3: None}
