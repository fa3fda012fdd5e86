"""Which 64-bit hashes are frequent in a corpus, as bitmaps of fixed size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from threadmill.llm.common import partitions

# A bitmap has 2**BITS bits (8 MiB), whatever the size of the corpus.
BITS = 26
_HELD = 1 << 21


class Bitmap:
    """Answers `may be frequent`; never wrong about hashes that are."""

    def __init__(self, data: np.ndarray):
        self.data = data

    def has(self, hashes: np.ndarray) -> np.ndarray:
        place = hashes >> np.uint64(64 - BITS)
        bit = np.uint8(1) << (place & np.uint64(7)).astype(np.uint8)
        return (self.data[place >> np.uint64(3)] & bit) > 0

    def any(self) -> bool:
        return bool(self.data.any())


def _packed(ascending: np.ndarray) -> bytes:
    """Differences, byte by byte: the high bytes are small and compress well."""
    steps = np.diff(ascending, prepend=np.uint32(0)).astype("<u4")
    return zstandard.compress(steps.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.uint32)


def frequent(
    rows: DataFrame, hashes: Callable[[pa.RecordBatch], Iterator[np.ndarray]], thresholds: list[int]
) -> list[Bitmap]:
    """For each threshold, the hashes that `hashes` yields so often or more in all
    batches of `rows`.

    Hashes travel to the task of their leading bits with 32 more bits, as sorted and
    compressed differences; hashes equal in these bits count as one, which can
    only set a bit too many.  A task sends a hash no more often than the largest threshold each time it
    sends, so a hash all documents share stays small.  Each task returns its
    range of the bitmaps.
    """
    most = max(thresholds)
    log_buckets = min(max((4 * partitions(rows.sparkSession) - 1).bit_length(), 1), BITS - 4)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = 0

        def packed() -> pa.RecordBatch:
            distinct, often = np.unique(np.concatenate(held), return_counts=True)
            sent = np.repeat(distinct, np.minimum(often, most))
            buckets = (sent >> np.uint64(64 - log_buckets)).astype(np.int64)
            body = ((sent << np.uint64(log_buckets)) >> np.uint64(32)).astype(np.uint32)
            cuts = np.searchsorted(buckets, np.arange((1 << log_buckets) + 1))
            full = np.flatnonzero(np.diff(cuts))
            pieces = [_packed(body[cuts[b] : cuts[b + 1]]) for b in full]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(full), pa.array(pieces, pa.binary())], ["bucket", "packed"])

        for batch in batches:
            for some in hashes(batch):
                if len(some):
                    held.append(some)
                    n += len(some)
                if n >= _HELD:
                    yield packed()
                    n = 0
        if held:
            yield packed()

    def count(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        bodies = [_unpacked(p) for p in table.column("packed").to_pylist()]
        distinct, often = np.unique(np.concatenate(bodies), return_counts=True)
        out = []
        for t in thresholds:
            bits = np.zeros(1 << (BITS - log_buckets), np.uint8)
            bits[distinct[often >= t] >> np.uint32(32 - (BITS - log_buckets))] = 1
            out.append(np.packbits(bits, bitorder="little").tobytes())
        return pa.table({"bucket": [bucket], "maps": [out]})

    counted = (
        rows.mapInArrow(send, "bucket long, packed binary")
        .groupBy("bucket")
        .applyInArrow(count, "bucket long, maps array<binary>")
    )
    size = (1 << (BITS - log_buckets)) // 8
    maps = [np.zeros((1 << BITS) // 8, np.uint8) for _ in thresholds]
    for row in counted.collect():
        for whole, part in zip(maps, row.maps):
            whole[row.bucket * size : (row.bucket + 1) * size] = np.frombuffer(part, np.uint8)
    return [Bitmap(m) for m in maps]
