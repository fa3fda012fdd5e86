"""Mixing sources to target weights by whole blocks of words."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadmill.llm.common import WORD, free_names, n_words, running_totals, settled, small_side

WEIGHTS = (5, 2, 1)
SHARE_PERCENT = 150
MAX_EPOCHS = 2
BLOCK_WORDS = 64
SHARD_BLOCKS = 256
SEED = 20


def source_quotas(sizes: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Targets and integer quotas for `sizes` (source, source_size).

    Sources in the order of their names (null last) weigh WEIGHTS, repeating,
    and share SHARE_PERCENT of all words; a target stops at MAX_EPOCHS times
    its source's size and the rest is shared by weight among the others.

    Blocks go to sources by highest quotients, target / (2 k - 1) for a source's
    k-th block (Sainte-Laguë), ties to the earlier source, until the blocks of
    the whole mix are given away.  The blocks whose quotient reaches that of an
    exact share are counted; only the few that rounding leaves over or short,
    at most half as many as there are sources, are listed and ranked.

    Adds number, base (words of earlier sources), target, blocks, quota.  This
    is one row per source, the only table here that one task holds.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(0))
    weights = F.array(*[F.lit(float(w)) for w in WEIGHTS])
    named = sizes.select(
        "source",
        "source_size",
        F.row_number().over(by_name).alias("number"),
        (F.sum("source_size").over(by_name) - F.col("source_size")).alias("base"),
    ).withColumns(
        {
            "weight": F.element_at(weights, (F.pmod(F.col("number") - 1, F.lit(len(WEIGHTS))) + 1).cast("int")),
            "most": (F.col("source_size") * MAX_EPOCHS).cast("double"),
            "share": F.sum("source_size").over(everything) * (SHARE_PERCENT / 100),
        }
    )
    # Those that reach their limit first come first; the level is where the others end up.
    filling = Window.orderBy(F.col("most") / F.col("weight"), "number")
    earlier = filling.rowsBetween(Window.unboundedPreceding, -1)
    later = filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col("share") - F.coalesce(F.sum("most").over(earlier), F.lit(0.0))) / F.sum("weight").over(later)
    levels = named.withColumn("level", level)
    place = F.struct((F.col("most") / F.col("weight")).alias("at"), "number", "level")
    below = F.col("level") * F.col("weight") <= F.col("most")
    final = F.min(F.when(below, place)).over(everything)["level"]
    whole = F.lit(float(block_words))
    targets = levels.withColumn("target", F.least("most", F.coalesce(final, F.lit(0.0)) * F.col("weight")))
    counted = targets.withColumns(
        {
            "blocks": F.ceil(F.col("source_size") / block_words),
            "exact": F.least(
                F.floor(F.col("target") / whole + 0.5), MAX_EPOCHS * F.ceil(F.col("source_size") / block_words)
            ),
        }
    ).withColumn(
        "short",
        F.floor(F.sum("target").over(everything) / whole + 0.5) - F.sum("exact").over(everything),
    )
    # More blocks if short is positive, fewer if it is negative.
    candidates = (
        counted.where((F.col("short") != 0) & (F.col("blocks") > 0))
        .withColumns(
            {
                "low": F.when(F.col("short") > 0, F.col("exact") + 1).otherwise(
                    F.greatest(F.lit(1), F.col("exact") + F.col("short") + 1)
                ),
                "high": F.when(
                    F.col("short") > 0, F.least(F.col("exact") + F.col("short"), MAX_EPOCHS * F.col("blocks"))
                ).otherwise(F.col("exact")),
            }
        )
        .where(F.col("low") <= F.col("high"))
        .select("number", "short", "target", F.explode(F.sequence("low", "high")).alias("k"))
    )
    quotient = F.col("target") / (2 * F.col("k") - 1)
    given = Window.orderBy(quotient.desc(), "number", "k")
    taken = Window.orderBy(quotient, F.desc("number"), F.desc("k"))
    place = F.when(F.col("short") > 0, F.row_number().over(given)).otherwise(F.row_number().over(taken))
    changes = (
        candidates.withColumn("place", place)
        .where(F.col("place") <= F.abs("short"))
        .groupBy("number")
        .agg(F.sum(F.signum("short")).cast("long").alias("change"))
    )
    return counted.join(changes, "number", "left").select(
        "source",
        "source_size",
        "number",
        "base",
        "target",
        "blocks",
        (F.col("exact") + F.coalesce("change", F.lit(0))).cast("long").alias("quota"),
    )


def chosen_blocks(
    quotas: DataFrame, shard_blocks: int = SHARD_BLOCKS, seed: int = SEED
) -> DataFrame:
    """number, shard and chosen: the blocks of every shard taken once more than
    the whole epochs, as places in the shard.

    A source's blocks form shards of `shard_blocks`; the part of its quota beyond
    whole epochs is spread evenly over them as integers, and each shard takes
    the blocks with the smallest seeded hashes.
    """
    extra = quotas.where((F.col("blocks") > 0) & (F.col("quota") % F.col("blocks") > 0)).select(
        "number", "blocks", (F.col("quota") % F.col("blocks")).alias("extra")
    )
    shards = extra.withColumn(
        "shard", F.explode(F.sequence(F.lit(0), F.expr(f"(blocks - 1) div {shard_blocks}")))
    ).withColumns(
        {
            "begin": F.col("shard") * shard_blocks,
            "end": F.least((F.col("shard") + 1) * shard_blocks, F.col("blocks")),
        }
    )
    quota = F.expr("(extra * end div blocks) - (extra * begin div blocks)").cast("int")
    key = lambda i: F.md5(
        F.concat_ws("/", F.lit(str(seed)), F.col("number"), F.col("begin") + i).cast("binary")
    )
    places = F.sequence(F.lit(0), (F.col("end") - F.col("begin") - 1).cast("int"))
    ranked = F.array_sort(F.transform(places, lambda i: F.struct(key(i).alias("k"), i.alias("i"))))
    chosen = F.transform(F.slice(ranked, F.lit(1), F.greatest(quota, F.lit(0))), lambda x: x["i"])
    return shards.repartition("number", "shard").select("number", "shard", chosen.alias("chosen"))


def mix_sources(
    docs: DataFrame,
    block_words: int = BLOCK_WORDS,
    shard_blocks: int = SHARD_BLOCKS,
    seed: int = SEED,
) -> DataFrame:
    """How often each row of `docs` (doc_id, source, text) is in the mix.

    A source's documents, ordered by doc_id, are one stream of words cut into
    blocks of `block_words`.  Returns doc_id, source, text_hash, size,
    source_size, target, epochs (whole copies taken), spans (word ranges, start
    and stop, taken once more) and taken, the words of both together.

    A null text or one without words has size 0 and nothing taken; a null
    source is a source, the last.  Rows with equal ids are ordered by the hash
    of the text, equal rows have interchangeable places, null ids come first.
    Without any words all targets are 0.  Other columns are ignored.  Runs over
    the same rows give the same result, however they are stored.
    """
    sized = settled(
        docs.select(
            "doc_id",
            "source",
            F.xxhash64("text").alias("text_hash"),
            n_words(F.col("text")).alias("size"),
        )
    )
    sizes = settled(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    quotas = settled(source_quotas(sizes, block_words))
    order = [
        F.col("source").asc_nulls_last(),
        F.col("doc_id").asc_nulls_first(),
        F.col("text_hash"),
        F.col("size"),
    ]
    facts = small_side(quotas, 256).withColumnRenamed("source", "_source")
    placed = settled(
        running_totals(sized, order, "size")
        .join(facts, F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("from", F.col("offset") - F.col("base"))
        .drop("_source", "offset", "base")
    )
    shard_words = block_words * shard_blocks
    pieces = placed.where("size > 0").select(
        "rank",
        "number",
        "from",
        "size",
        F.explode(
            F.sequence(F.expr(f"`from` div {shard_words}"), F.expr(f"(`from` + size - 1) div {shard_words}"))
        ).alias("shard"),
    )
    start = F.col("from") - F.col("shard") * shard_words
    met = pieces.join(chosen_blocks(quotas, shard_blocks, seed), ["number", "shard"]).withColumn("start", start)
    low, high = F.expr(f"start div {block_words}"), F.expr(f"(start + size - 1) div {block_words}")
    hits = F.filter(F.col("chosen"), lambda i: i.between(low, high))
    span = lambda i: F.struct(
        (F.greatest(i * block_words, F.col("start")) - F.col("start")).alias("start"),
        (F.least((i + 1) * block_words, F.col("start") + F.col("size")) - F.col("start")).alias("stop"),
    )
    extra = (
        met.where(F.size(hits) > 0)
        .select("rank", F.transform(hits, span).alias("spans"))
        .groupBy("rank")
        .agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
    )
    words = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["stop"] - s["start"])
    none = F.expr("cast(array() as array<struct<start: bigint, stop: bigint>>)")
    epochs = F.when(F.col("blocks") > 0, F.expr("quota div blocks")).otherwise(F.lit(0)).cast("long")
    return (
        placed.join(extra, "rank", "left")
        .withColumns({"spans": F.coalesce("spans", none), "epochs": F.when(F.col("size") > 0, epochs).otherwise(F.lit(0))})
        .select(
            "doc_id",
            "source",
            "text_hash",
            "size",
            "source_size",
            "target",
            "epochs",
            "spans",
            (F.col("epochs") * F.col("size") + words).alias("taken"),
        )
    )


def mixed_documents(docs: DataFrame) -> DataFrame:
    """`docs` (doc_id, source, text and others) as the mix takes them.

    A row comes once for each whole epoch, and once more with the words of its
    extra blocks, joined by a space, if it has any; n_chars, where there is
    such a column, is that of the new text.  Rows without words are in no mix.

    What is taken grows with the documents: both are sorted by id, source and hash
    and merged, at every size, so texts are shuffled once.
    """
    *key, once, number, spans, epochs, words = free_names(docs, 8)
    takes = settled(
        mix_sources(docs)
        .where("taken > 0")
        .select(
            *(F.col(c).alias(k) for c, k in zip(("doc_id", "source", "text_hash"), key)),
            F.col("epochs").cast("int").alias(epochs),
            F.col("spans").alias(spans),
        )
    )
    copies = takes.groupBy(*key).agg(F.count(F.lit(1)).alias(number))
    keyed = docs.withColumns(
        {key[0]: F.col("doc_id"), key[1]: F.col("source"), key[2]: F.xxhash64("text")}
    )
    # Rows that are there more than once share a key: one of them brings the text.
    several = settled(copies.where(F.col(number) > 1).drop(number))
    single = keyed if several.isEmpty() else _joined(keyed, several, key, "left_anti")
    repeated = _joined(keyed, several, key, "left_semi").dropDuplicates(key)
    taken = _joined(single, takes.hint("merge"), key, "inner")
    if not several.isEmpty():
        taken = taken.unionByName(_joined(repeated, takes.hint("merge"), key, "inner"))
    # An array of its own, not an expression that each span would evaluate anew.
    whole = F.when(F.size(spans) == 0, F.array().cast("array<string>")).otherwise(
        F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    )
    cut = F.array_join(
        F.flatten(
            F.transform(
                spans, lambda s: F.slice(words, (s["start"] + 1).cast("int"), (s["stop"] - s["start"]).cast("int"))
            )
        ),
        " ",
    )
    parts = F.when(F.size(spans) > 0, F.array(cut)).otherwise(F.array().cast("array<string>"))
    each = taken.withColumn(words, F.explode(F.array(whole)))
    rows = each.withColumn(once, F.explode(F.concat(F.array_repeat("text", F.col(epochs)), parts)))
    values = {"text": F.col(once), "n_chars": F.length(once).cast(dict(docs.dtypes).get("n_chars", "long"))}
    return rows.select(*[values[c].alias(c) if c in values else F.col(c) for c in docs.columns])


def _joined(rows: DataFrame, other: DataFrame, key: list[str], how: str) -> DataFrame:
    """A join on keys that may be null."""
    named = other.withColumnsRenamed({k: f"{k}_" for k in key})
    same = [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in key]
    return rows.join(named, same[0] & same[1] & same[2], how).drop(*(f"{k}_" for k in key))
