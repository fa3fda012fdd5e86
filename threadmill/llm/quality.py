"""Quality rules: base counts, and a calibrated linear model over hashed n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadmill.llm.words import Chunk, Spans, chunks, lines, per_text, ranges, repeated

# Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50
REPEAT_WINDOW = 3

# The model is fitted on at most so many labelled rows of each class, those with
# the smallest hashes of doc_id.
ROWS_PER_CLASS = 1000
FEATURES = 1 << 16
CHAR_NGRAM = 3
STEPS, RATE, DECAY = 200, 0.05, 1e-4
SCALE = 30.0
KEEP_FROM = 0.35

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS.encode())] = True


def base_counts(chunk: Chunk) -> dict[str, np.ndarray]:
    """The counts of each text that the base rules use."""
    data = chunk.data
    begins = (data & 0xC0) != 0x80
    space = np.isin(data, [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
    start, end, text = lines(chunk)
    words_before = np.searchsorted(chunk.starts, np.stack([start, end]))
    with_word = words_before[1] > words_before[0]
    start, end, text = start[with_word], end[with_word], text[with_word]
    hashes = chunk.bytes_spans().hash(start, end)
    distinct = np.unique(np.stack([text.astype(np.uint64), hashes]), axis=1)[0].astype(np.int64)
    n = len(chunk)
    dup_lines = np.bincount(text, minlength=n) - np.bincount(distinct, minlength=n)

    first, of_text = chunk.window_starts(REPEAT_WINDOW)
    windows = Spans(chunk.word_hashes()).hash(first, first + REPEAT_WINDOW)
    twice = first[repeated(of_text, windows) > 1]
    covered = np.zeros(len(chunk.starts), bool)
    for i in range(REPEAT_WINDOW):
        covered[twice + i] = True
    return {
        "n_words": chunk.n_words,
        "word_chars": per_text(chunk, begins & ~space),
        "n_symbols": per_text(chunk, _IS_SYMBOL[data]),
        "n_dup_lines": dup_lines,
        "n_repeat_words": np.bincount(chunk.word_text[covered], minlength=n),
    }


def _families(chunk: Chunk) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(feature, text) of the n-grams of each kind: one word, two words, and
    CHAR_NGRAM characters anywhere in the text."""
    mask = np.uint64(FEATURES - 1)
    words = chunk.word_hashes()
    yield (words & mask).astype(np.int32), chunk.word_text
    first, text = chunk.window_starts(2)
    yield (Spans(words).hash(first, first + 2) & mask).astype(np.int32), text
    at = np.flatnonzero((chunk.data & 0xC0) != 0x80)
    of = np.searchsorted(at, chunk.offsets)
    counts = np.maximum(np.diff(of) - CHAR_NGRAM + 1, 0)
    first, text = ranges(of[:-1], counts)
    ends = np.append(at, len(chunk.data))
    grams = chunk.bytes_spans(1).hash(ends[first], ends[first + CHAR_NGRAM])
    yield (grams & mask).astype(np.int32), text


@dataclass
class QualityModel:
    """Weights of each kind of n-gram, the intercept, and the calibration."""

    weights: np.ndarray
    intercept: float
    slope: float = 1.0
    shift: float = 0.0

    def logits(self, chunk: Chunk) -> np.ndarray:
        total = np.full(len(chunk), self.intercept)
        for weights, (features, text) in zip(self.weights, _families(chunk)):
            sums = np.bincount(text, weights=weights[features], minlength=len(chunk))
            total += SCALE * sums / np.maximum(np.bincount(text, minlength=len(chunk)), 1)
        return total

    def probabilities(self, chunk: Chunk) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logits(chunk) + self.shift, -30, 30)))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (quality, text) as features with their shares."""
    for batch in batches:
        labels = batch.column(0).to_pylist()
        for chunk in chunks(batch.column(1)):
            n = len(chunk)
            rows, shares = [], []
            for kind, (features, text) in enumerate(_families(chunk)):
                totals = np.bincount(text, minlength=n)
                keys, often = np.unique(text.astype(np.int64) * FEATURES + features, return_counts=True)
                rows.append(keys // FEATURES * (3 * FEATURES) + kind * FEATURES + keys % FEATURES)
                shares.append(SCALE * often / totals[keys // FEATURES])
            keys, values = np.concatenate(rows), np.concatenate(shares)
            order = np.argsort(keys)
            keys, values = keys[order], values[order]
            cuts = np.searchsorted(keys // (3 * FEATURES), np.arange(n + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(labels[chunk.first : chunk.first + n], pa.int32()),
                    pa.ListArray.from_arrays(cuts, pa.array((keys % (3 * FEATURES)).astype(np.int32))),
                    pa.ListArray.from_arrays(cuts, pa.array(values.astype(np.float32))),
                ],
                ["quality", "features", "shares"],
            )


def fit_quality(docs: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS) -> QualityModel | None:
    """A model from labelled documents: `labels` (doc_id, quality) joined to `docs`.

    At most `rows_per_class` rows of each class are used, four fifths for the
    weights and one fifth for the calibration (a logistic fit of the outcome to
    the score).  None if one of the classes has no row.
    """
    wanted = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")
    )
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    few = [wanted.where(F.col("quality") == q).orderBy(*order).limit(rows_per_class) for q in (0, 1)]
    chosen = F.broadcast(few[0].unionByName(few[1]))
    sample = docs.where("text IS NOT NULL").select("doc_id", "text").join(chosen, "doc_id")
    table = sample.select("quality", "text").mapInArrow(
        _counted, "quality int, features array<int>, shares array<float>"
    ).toArrow().combine_chunks()
    y = table.column("quality").to_numpy().astype(np.float64)
    if not len(y) or y.min() == y.max():
        return None
    features, shares = (table.column(c).combine_chunks() for c in ("features", "shares"))
    sizes = np.diff(features.offsets.to_numpy())
    x, v = features.values.to_numpy(), shares.values.to_numpy()
    # The order of rows depends on how the table was read; their contents do not.
    keys = np.add.reduceat(np.append(x.astype(np.int64) * 7919 % 1_000_003, 0), np.cumsum(sizes) - sizes) * (sizes > 0)
    rank = np.lexsort((keys, sizes))
    fold = np.empty(len(y), np.int64)
    fold[rank] = np.arange(len(y)) % 5
    row = np.repeat(np.arange(len(y)), sizes)
    weight = np.where(y == 1, 0.5 / max((y == 1).sum(), 1), 0.5 / max((y == 0).sum(), 1)) * (fold != 4)
    weight /= weight.sum()
    w, b = np.zeros(3 * FEATURES), 0.0
    m, s, mb, sb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, STEPS + 1):
        z = np.bincount(row, weights=w[x] * v, minlength=len(y)) + b
        error = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        gradient = np.bincount(x, weights=error[row] * v, minlength=len(w)) + DECAY * w
        m, s = 0.9 * m + 0.1 * gradient, 0.999 * s + 0.001 * gradient**2
        mb, sb = 0.9 * mb + 0.1 * error.sum(), 0.999 * sb + 0.001 * error.sum() ** 2
        c1, c2 = 1 - 0.9**step, 1 - 0.999**step
        w -= RATE * (m / c1) / (np.sqrt(s / c2) + 1e-9)
        b -= RATE * (mb / c1) / (np.sqrt(sb / c2) + 1e-9)
    model = QualityModel(w.reshape(3, FEATURES), b)
    z = np.bincount(row, weights=w[x] * v, minlength=len(y)) + b
    held = fold == 4
    if 0 < y[held].sum() < held.sum():
        model.slope, model.shift = _calibration(z[held], y[held])
    return model


def _calibration(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic fit; outcomes are pulled in a little, so
    that separable scores stay finite.  A slope that is not positive is not used."""
    hits, misses = y.sum(), (1 - y).sum()
    goal = np.where(y == 1, (hits + 1) / (hits + 2), 1 / (misses + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        d, r = p * (1 - p) + 1e-6, p - goal
        h = np.array([[(d * z * z).sum() + 1e-6, (d * z).sum()], [(d * z).sum(), d.sum() + 1e-6]])
        step = np.linalg.solve(h, [(r * z).sum(), r.sum()])
        a, b = a - float(np.clip(step[0], -1, 1)), b - float(np.clip(step[1], -1, 1))
    return (a, b) if a > 0 else (1.0, 0.0)


_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def score_quality(
    docs: DataFrame,
    model: QualityModel | None,
    keep_from: float = KEEP_FROM,
    carry: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """Base counts and verdict for each row of `docs`: the columns `carry`, the
    five counts, base_failed, probability and kept.

    A text fails the base rules with fewer than LEAST_WORDS words or if more than
    MOST_REPEATED_PERCENT of its words are in repeated windows.  Others are kept
    if their calibrated probability of being good is `keep_from` or more.  Without
    a model (no labels of one class) the probability is null and the base rules
    decide.  Null texts have no words.  An empty table gives an empty one."""
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(model)
    carried = docs.select(*carry).schema.fields
    text_at = carry.index("text") if "text" in carry else len(carry)
    schema = T.StructType(
        [T.StructField(f.name, f.dataType) for f in carried]
        + [T.StructField(c, T.LongType()) for c in _COUNTS]
        + [
            T.StructField("base_failed", T.BooleanType()),
            T.StructField("probability", T.DoubleType()),
            T.StructField("kept", T.BooleanType()),
        ]
    )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        for batch in batches:
            for chunk in chunks(batch.column(text_at)):
                counts = base_counts(chunk)
                failed = (counts["n_words"] < LEAST_WORDS) | (
                    100 * counts["n_repeat_words"] > MOST_REPEATED_PERCENT * counts["n_words"]
                )
                if model is None:
                    p, verdict = pa.nulls(len(chunk), pa.float64()), ~failed
                else:
                    p = model.probabilities(chunk)
                    verdict = ~failed & (p >= keep_from)
                columns = [batch.column(i).slice(chunk.first, len(chunk)) for i in range(len(carried))]
                columns += [pa.array(counts[c].astype(np.int64)) for c in _COUNTS]
                columns += [pa.array(failed), pa.array(p) if model is not None else p, pa.array(verdict)]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    more = [] if "text" in carry else ["text"]
    return docs.select(*carry, *more).mapInArrow(score, schema)


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that are kept, with their own columns only."""
    clash = set(docs.columns) & {*_COUNTS, "base_failed", "probability", "kept"}
    if clash:
        renamed = docs.withColumnsRenamed({c: f"_own_{c}" for c in clash})
        return good_documents(renamed, labels).withColumnsRenamed({f"_own_{c}": c for c in clash}).select(*docs.columns)
    scored = score_quality(docs, fit_quality(docs, labels), carry=tuple(docs.columns))
    return scored.where("kept").select(*docs.columns)
