"""Language identification: known words first, then shorter and shorter n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadmill.llm.common import settled, small_side
from threadmill.llm.words import Chunk, Spans, chunks, ranges

# The model learns from at most so many documents of each language, those with
# the smallest hashes, and keeps so many entries of each order for each language.
DOCS_PER_LANGUAGE = 1500
ENTRIES = 50_000
LONGEST = 5
WORDS = 0
UNKNOWN = "und"

# A letter is an ASCII letter or, for splitting words, any other character
# beyond ASCII.
_NO_LETTER = np.ones(256, bool)
_NO_LETTER[ord("a") : ord("z") + 1] = False
_NO_LETTER[0x80:] = False
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[ord("a") : ord("z") + 1] = True


def _letters(texts: pa.Array) -> Iterator[Chunk]:
    for chunk in chunks(texts):
        chunk.separators = _NO_LETTER
        yield chunk


def _has_letter(chunk: Chunk) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(_ASCII_LETTER[chunk.data])])
    found = sums[chunk.offsets[1:]] > sums[chunk.offsets[:-1]]
    for i in np.flatnonzero(~found & (chunk.n_words > 0)):
        found[i] = any(c.isalpha() for c in chunk.text(i).decode("utf-8", "replace"))
    return found


def _distinct_words(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, a place of each, which word of the chunk is which of them)."""
    return np.unique(chunk.word_hashes(), return_index=True, return_inverse=True)


class _Grams:
    """Character n-grams of some words of a chunk."""

    def __init__(self, chunk: Chunk):
        at = np.flatnonzero((chunk.data & 0xC0) != 0x80)
        self.at = np.append(at, len(chunk.data))
        self.spans: Spans = chunk.bytes_spans(1)
        self.chunk = chunk

    def of(self, places: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, which of `places`)."""
        first = np.searchsorted(self.at, self.chunk.starts[places])
        last = np.searchsorted(self.at, self.chunk.ends[places])
        begin, word = ranges(first, np.maximum(last - first - n + 1, 0))
        return self.spans.hash(self.at[begin], self.at[begin + n]), word


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, text) as counts of words and n-grams."""
    for batch in batches:
        langs = batch.column(0).dictionary_encode()
        codes = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        names = langs.dictionary.to_pylist()
        for chunk in _letters(batch.column(1)):
            _, places, inverse = _distinct_words(chunk)
            lang = codes[chunk.first + chunk.word_text]
            keys, often = np.unique(lang * (len(places) + 1) + inverse, return_counts=True)
            lang, word = keys // (len(places) + 1), keys % (len(places) + 1)
            grams = _Grams(chunk)
            for order in range(LONGEST + 1):
                if order == WORDS:
                    hashes, which = chunk.word_hashes()[places[word]], np.arange(len(word))
                else:
                    hashes, which = grams.of(places[word], order)
                for code, name in enumerate(names):
                    mine = lang[which] == code
                    distinct, at = np.unique(hashes[mine], return_inverse=True)
                    if not len(distinct):
                        continue
                    n = np.bincount(at, weights=often[which[mine]]).astype(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([name] * len(n)),
                            pa.array([order] * len(n), pa.int32()),
                            pa.array(distinct.view(np.int64)),
                            pa.array(n),
                        ],
                        ["lang", "kind", "hash", "n"],
                    )


@dataclass
class LanguageModel:
    """Sorted hashes and log frequencies per language for words and each n."""

    languages: list[str]
    hashes: list[np.ndarray]
    logs: list[np.ndarray]

    def _found(self, kind: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        known = self.hashes[kind]
        at = np.minimum(np.searchsorted(known, hashes), max(len(known) - 1, 0))
        return at, known[at] == hashes if len(known) else np.zeros(len(hashes), bool)

    def predict(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """(number of the language, its share of the likelihood) for each text.

        A known word adds its log frequency.  Of an unknown one the n-grams of
        the longest order of which any is known add the mean of theirs."""
        hashes, places, inverse = _distinct_words(chunk)
        scores = np.zeros((len(hashes), len(self.languages)))
        at, known = self._found(WORDS, hashes)
        scores[known] = self.logs[WORDS][at[known]]
        left, grams = np.flatnonzero(~known), _Grams(chunk)
        for order in range(LONGEST, 0, -1):
            if not len(left):
                break
            found, word = grams.of(places[left], order)
            at, known = self._found(order, found)
            at, word = at[known], word[known]
            often = np.bincount(word, minlength=len(left))
            hit = often > 0
            for lang in range(len(self.languages)):
                sums = np.bincount(word, weights=self.logs[order][at, lang], minlength=len(left))
                scores[left[hit], lang] = sums[hit] / often[hit]
            left = left[~hit]
        totals = np.stack(
            [np.bincount(chunk.word_text, weights=s[inverse], minlength=len(chunk)) for s in scores.T], axis=1
        )
        best = totals.argmax(axis=1)
        share = np.exp(totals - totals.max(axis=1, keepdims=True))
        return best, 1 / share.sum(axis=1)


def fit_language(labelled: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE, entries: int = ENTRIES) -> LanguageModel | None:
    """A model from `labelled` (doc_id, lang, text); rows with a null lang or text
    teach nothing.  None if there is no other row.

    The bounded number of documents per language makes the model's size and the
    counts that reach the driver independent of the corpus."""
    usable = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "lang", "text")
    # The documents with the smallest hashes of doc_id.  Twice as many as needed lie
    # below a share of all hashes that follows from the number of a language's
    # documents, so no task ranks more than these, however frequent it is.
    place = F.xxhash64("doc_id")
    ids = usable.where("doc_id IS NOT NULL").select("doc_id", "lang")
    sizes = settled(ids.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("_ids")))
    share = F.least(F.lit(1.0), F.lit(2.0 * docs_per_language) / F.col("_ids"))
    near = ids.join(small_side(sizes), "lang").where(place.cast("double") <= share * 2.0**64 - 2.0**63)
    order = Window.partitionBy("lang").orderBy(place, "doc_id")
    ranked = near.select("doc_id", "lang").distinct().withColumn("_place", F.row_number().over(order))
    chosen = ranked.where(F.col("_place") <= docs_per_language).select("doc_id", F.col("lang").alias("_lang"))
    sample = usable.join(small_side(settled(chosen)), "doc_id").where(F.col("lang") == F.col("_lang"))
    counts = sample.select("lang", F.lower("text")).mapInArrow(_counts, "lang string, kind int, hash long, n long")
    summed = settled(counts.groupBy("kind", "hash", "lang").agg(F.sum("n").alias("n")))
    totals = settled(summed.groupBy("kind", "lang").agg(F.sum("n").alias("n"))).collect()
    languages = sorted({r.lang for r in totals})
    if not languages:
        return None
    number = {lang: i for i, lang in enumerate(languages)}
    sizes = {(r.kind, r.lang): r.n for r in totals}
    hashes, logs = [], []
    for kind in range(LONGEST + 1):
        rows = summed.where(F.col("kind") == kind)
        often = rows.groupBy("hash").agg(
            F.sum("n").alias("all"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("of")
        ).where("all > 1")
        # Each language has its own, so that none is crowded out by larger ones.
        by_count = Window.partitionBy("lang").orderBy(F.desc("n"), "hash")
        own = rows.join(often.select("hash"), "hash").withColumn("_place", F.row_number().over(by_count))
        top = often.join(own.where(F.col("_place") <= entries).select("hash").distinct(), "hash")
        table = top.select("hash", *[F.coalesce(F.element_at("of", F.lit(lang)), F.lit(0)) for lang in languages]).toArrow()
        keys = table.column(0).to_numpy().view(np.uint64) if len(table) else np.zeros(0, np.uint64)
        counts = np.stack([table.column(1 + number[lang]).to_numpy() for lang in languages], axis=1).astype(float)
        n = np.array([sizes.get((kind, lang), 0) for lang in languages], float)
        order_ = np.argsort(keys)
        hashes.append(keys[order_])
        logs.append(np.log((counts[order_] + 0.1) / (n + 0.1 * (len(keys) + 1))))
    return LanguageModel(languages, hashes, logs)


def predict_language(docs: DataFrame, model: LanguageModel | None, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `carry`, lang_pred and score for each row of `docs`, from its whole
    text alone.

    `und` with score 0 stands for a null text, a text without a letter, and any
    text if nothing was learned.  Ties go to the language that sorts first."""
    from pyspark.sql import types as T

    shipped = docs.sparkSession.sparkContext.broadcast(model)
    carried = docs.select(*carry).schema.fields
    schema = T.StructType(
        [T.StructField(f.name, f.dataType) for f in carried]
        + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    )

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        names = np.array([*(model.languages if model else []), UNKNOWN], object)
        for batch in batches:
            for chunk in _letters(batch.column(0)):
                best, score = np.full(len(chunk), len(names) - 1), np.zeros(len(chunk))
                if model:
                    has = _has_letter(chunk)
                    found, share = model.predict(chunk)
                    best[has], score[has] = found[has], share[has]
                columns = [batch.column(1 + i).slice(chunk.first, len(chunk)) for i in range(len(carried))]
                columns += [pa.array(names[best], pa.string()), pa.array(score)]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select(F.lower("text").alias("_scored"), *carry).mapInArrow(predict, schema)
