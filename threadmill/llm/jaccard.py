"""Documents whose sets of word shingles are similar, by token-combination prefixes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadmill.llm.common import free_names, partitions, settled, small_side
from threadmill.llm.components import components
from threadmill.llm.hashcounts import frequent
from threadmill.llm.words import chunks, distinct_sets, mix, ranges

SHINGLE = 5
PERCENT = 75
# A token in more documents than this is frequent; it is indexed in combinations.
FREQUENT = 64
# A combination takes two frequent tokens of the same one of n / GROUPING groups.
GROUPING = 8
MEMBERS_AT_ONCE = 128
# Classes of one partner are cut into blocks of about so many; two blocks are a cell.
BLOCK = 256
TOKENS_AT_ONCE = 1 << 20

_OTHER = np.uint64(0xA5A5A5A5A5A5A5A5)
_SETS = "doc_id long, text_key long, n int, cls long"
_COMPARED = "a long, b long, shared long, n_a long, n_b long, linked boolean, extra array<long>"
_COMPARED_FIELDS = [
    *[(c, pa.int64()) for c in ("a", "b", "shared", "n_a", "n_b")],
    ("linked", pa.bool_()),
    ("extra", pa.list_(pa.int64())),
]
_POSTINGS = "sig long, cls long, n int, whole boolean"


def _classes_of(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A hash of each set."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes), dtype=np.uint64)])
    n = np.diff(bounds).astype(np.uint64)
    return mix(sums[bounds[1:]] - sums[bounds[:-1]] + n * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def _combinations(tokens: np.ndarray, need: int, level: int) -> np.ndarray:
    """Pairs of the first frequent `tokens`, within groups, so many that losing
    any `need` - 1 of these tokens leaves one: a group of k tokens withstands
    the loss of k - 2, so it counts k - 1."""
    groups = (mix(tokens ^ _OTHER) % np.uint64(max(1, (1 << level) // GROUPING))).astype(np.int64)
    order = np.argsort(groups, kind="stable")
    first = np.ones(len(tokens), bool)
    first[order[1:]] = groups[order[1:]] != groups[order[:-1]]
    gained = np.cumsum(~first)  # in the order of the tokens, how many were not the first of their group
    used = min(int(np.searchsorted(gained, need)) + 1, len(tokens))
    tokens, groups = tokens[:used], groups[:used]
    order = np.argsort(groups, kind="stable")
    tokens, groups = tokens[order], groups[order]
    cuts = np.flatnonzero(np.diff(groups, prepend=-1, append=-2))
    salt = mix(np.array([level + 1], np.uint64))[0]
    out = [np.zeros(0, np.uint64)]
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        if b - a > 1:
            i, j = np.triu_indices(b - a, 1)
            out.append(mix(tokens[a + i] ^ mix(tokens[a + j] ^ salt)))
    return np.concatenate(out)


def _levels(n: int) -> list[int]:
    """Sizes of the same level share their groups; a set near the next level,
    which a similar set may have, is indexed in that one too."""
    level = n.bit_length() - 1
    return [level, level + 1] if 100 * n >= PERCENT * (2 << level) else [level]


def counted_tokens(docs: DataFrame) -> Broadcast:
    """Bitmaps of the tokens in two documents or more, and of the frequent ones."""

    def counted(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for chunk in chunks(batch.column(0), lower=True):
            hashes, _ = distinct_sets(chunk, SHINGLE)
            yield hashes

    maps = frequent(docs.select("text"), counted, [2, FREQUENT + 1])
    return docs.sparkSession.sparkContext.broadcast(maps)


def postings(docs: DataFrame, shipped: Broadcast) -> DataFrame:
    """Signatures (sig) of each class of equal sets (cls): similar sets share one.

    Sets x and y with 100 |x & y| >= 75 |x | y| differ in at most e = n - ceil(.75 n)
    tokens of x.  In one order of all tokens, the first tokens of x hold a
    signature that y has too as soon as losing any e of them leaves one.  Rare
    tokens come first, by hash, each a signature; e + 1 of them are enough.  Where
    there are fewer, the prefix is extended by frequent tokens, of which pairs
    are signatures; a set of two tokens or more always has enough of them.

    Frequencies are counted over all documents.  A rare token in one document
    only can link nothing and is left out.  `whole` says that all tokens of the
    prefix are rare.
    """
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeated, often = shipped.value
        seen: set[int] = set()
        for batch in batches:
            for chunk in chunks(batch.column(0), lower=True):
                hashes, bounds = distinct_sets(chunk, SHINGLE)
                classes, sizes = _classes_of(hashes, bounds), np.diff(bounds)
                fresh = np.zeros(len(chunk), bool)
                for i in np.flatnonzero(sizes > 0).tolist():
                    if (key := int(classes[i])) not in seen:
                        seen.add(key)
                        fresh[i] = True
                text = np.repeat(np.arange(len(chunk)), sizes)
                use = fresh[text]
                hashes, text = hashes[use], text[use]
                kind = often.has(hashes)
                order = np.lexsort((hashes, kind, text))
                hashes, text, kind = hashes[order], text[order], kind[order]
                starts = np.searchsorted(text, np.arange(len(chunk) + 1))
                need = sizes - (PERCENT * sizes + 99) // 100 + 1
                rare = np.bincount(text[~kind], minlength=len(chunk))
                whole = rare >= need
                place = np.arange(len(text)) - starts[text]
                single = ~kind & (place < need[text])
                single[single] = repeated.has(hashes[single])
                sigs, owners = [hashes[single]], [text[single]]
                for i in np.flatnonzero(fresh & ~whole).tolist():
                    own, own_kind = hashes[starts[i] : starts[i + 1]], kind[starts[i] : starts[i + 1]]
                    for level in _levels(int(sizes[i])):
                        pairs = _combinations(own[own_kind], int(need[i] - rare[i]), level)
                        sigs.append(pairs)
                        owners.append(np.full(len(pairs), i))
                sig, owner = np.concatenate(sigs), np.concatenate(owners)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(sig.view(np.int64)),
                        pa.array(classes[owner]),
                        pa.array(sizes[owner].astype(np.int32)),
                        pa.array(whole[owner]),
                    ],
                    ["sig", "cls", "n", "whole"],
                )

    return docs.select("text").mapInArrow(sign, _POSTINGS).distinct()


def shingle_sets(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n (size of the set) and cls (its hash) of each row."""

    def size(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(2), lower=True):
                hashes, bounds = distinct_sets(chunk, SHINGLE)
                part = [batch.column(i).slice(chunk.first, len(chunk)) for i in (0, 1)]
                n = pa.array(np.diff(bounds).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [*part, n, pa.array(_classes_of(hashes, bounds))], ["doc_id", "text_key", "n", "cls"]
                )

    return _keyed(docs).mapInArrow(size, _SETS)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")


def verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, shipped: Broadcast, extras: bool = True) -> DataFrame:
    """The pairs (a, b) of classes compared by their texts: shared, the sizes
    n_a and n_b, linked, and, with `extras` and where b has half of a's tokens or more,
    those of the others (extra) that more than one document has.

    Each pair lies in one `cell`; a text is sent to each cell of its class once, however many
    pairs it is in there, with those a that it is to be compared to as b."""
    spark = docs.sparkSession
    lists = settled(pairs.groupBy("cell", "b").agg(F.collect_set("a").alias("of")))
    n_lists, n_pairs = lists.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("of")), F.lit(0))).first()
    buckets = max(2 * partitions(spark), n_pairs // 400)
    nobody = F.array().cast("array<long>")
    alone = lists.select("cell", F.explode("of").alias("cls"), nobody.alias("of"))
    members = alone.unionByName(lists.withColumnRenamed("b", "cls")).groupBy("cell", "cls")
    # Places first, then texts: these are shuffled once, to where they are compared.
    placed = settled(
        members.agg(F.flatten(F.collect_set("of")).alias("of"))
        .join(classes, "cls")
        .select("cell", "cls", "of", F.col("rep_id").alias("_id"), F.col("rep_key").alias("_key"))
    )
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key"))
    row_bytes = 72 + 8 * n_pairs // max(n_lists, 1)
    texts = _keyed(docs).join(small_side(placed, row_bytes), same).select("cell", "cls", "of", "text")
    grouped = texts.withColumn("bucket", F.pmod(F.xxhash64("cell"), F.lit(buckets)))

    def compare(table: pa.Table) -> Iterator[pa.RecordBatch]:
        # Rows of the same document, id and text, are the same row.
        of = table.column("of").combine_chunks()
        cell, cls = (table.column(c).to_numpy() for c in ("cell", "cls"))
        places, first = np.unique(np.stack([cell, cls]), axis=1, return_index=True)
        hashes, sizes = [], []
        for chunk in chunks(table.column("text"), lower=True):
            some, bounds = distinct_sets(chunk, SHINGLE)
            hashes.append(some)
            sizes.append(np.diff(bounds))
        hashes, sizes = np.concatenate(hashes), np.concatenate(sizes)
        begin = np.cumsum(sizes) - sizes
        counts = of.value_lengths().to_numpy()[first]
        b = np.repeat(first, counts)
        asked = of.take(pa.array(first)).flatten().to_numpy()
        a = first[_rows_at(places, np.stack([cell[b], asked]))]
        heads = np.zeros(len(cls), bool)
        heads[b] = True
        row = np.repeat(np.arange(len(sizes)), sizes)
        known = np.sort(_in_row(hashes, row)[heads[row]])
        cuts = np.searchsorted(np.cumsum(sizes[a]), np.arange(0, int(sizes[a].sum()), TOKENS_AT_ONCE))
        cuts = np.unique(np.append(cuts, len(a)))
        for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            x, y = a[low:high], b[low:high]
            at, pair = ranges(begin[x], sizes[x])
            keys = _in_row(hashes[at], y[pair])
            found = np.minimum(np.searchsorted(known, keys), len(known) - 1)
            inside = known[found] == keys
            shared = np.bincount(pair[inside], minlength=len(x))
            linked = 100 * shared >= PERCENT * (sizes[x] + sizes[y] - shared)
            outside = ~inside & (extras & (2 * shared >= sizes[x]))[pair]
            outside[outside] = shipped.value[0].has(hashes[at[outside]])
            ends = np.cumsum(np.bincount(pair[outside], minlength=len(x)))
            extra = pa.ListArray.from_arrays(
                np.concatenate([[0], ends]).astype(np.int32), pa.array(hashes[at[outside]].view(np.int64))
            )
            columns = [cls[x], cls[y], shared, sizes[x].astype(np.int64), sizes[y].astype(np.int64), linked]
            names = ["a", "b", "shared", "n_a", "n_b", "linked", "extra"]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), extra], names)

    def compared(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(compare(table)), pa.schema(_COMPARED_FIELDS))

    return grouped.groupBy("bucket").applyInArrow(compared, _COMPARED)


def _in_row(hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return mix(hashes ^ mix(rows.astype(np.uint64) + np.uint64(1)))


def _rows_at(places: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which column of `places`, ascending and distinct, each column of `wanted` is."""
    both, inverse = np.unique(np.concatenate([places, wanted], axis=1), axis=1, return_inverse=True)
    inverse = inverse.ravel()
    number = np.empty(both.shape[1], np.int64)
    number[inverse[: places.shape[1]]] = np.arange(places.shape[1])
    return number[inverse[places.shape[1] :]]


def _enough() -> Column:
    """Whether sets of sizes n and _n, whose prefixes of rare tokens share c, could
    be similar: what the prefix that ends first has not, its rest would have to."""
    rest = [F.expr(f"({PERCENT} * {n} + 99) div 100 - 1") for n in ("n", "_n")]
    return (100 + PERCENT) * (F.col("c") + F.greatest(*rest)) >= PERCENT * (F.col("n") + F.col("_n"))


def outside_tokens(compared: DataFrame) -> DataFrame:
    """Of each class (cls) its tokens t outside its partner that another class with the
    partner has, rarest first, and how many of them a similar one shares (need).

    Similar sets x and y have 75/175 of their sizes' sum in common, and y is no smaller
    than 3/4 of x and than the smallest set with the partner.  Of that, what x has
    inside the partner leaves the rest, at least one, to be shared outside."""
    far = compared.where(F.size("extra") > 0)
    smallest = far.groupBy("b").agg(F.min("n_a").alias("least"))
    sizes = F.col("n_a") + F.greatest("least", F.expr(f"({PERCENT} * n_a + 99) div 100"))
    common = F.ceil(PERCENT * sizes / (100 + PERCENT)).cast("long")
    outside = settled(
        far.join(smallest, "b").select(
            "b",
            F.col("a").alias("cls"),
            F.greatest(common - F.col("shared"), F.lit(1)).alias("need"),
            F.explode("extra").alias("token"),
        )
    )
    # A token that no other class with p has cannot be shared.
    often = outside.groupBy("b", "token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    placed = outside.join(often, ["b", "token"]).select("cls", "need", F.struct("df", "token").alias("t"))
    return placed.groupBy("cls", "need").agg(F.sort_array(F.collect_list("t")).alias("t"))


def outside_prefixes(ranked: DataFrame) -> DataFrame:
    """cls and token: of the :func:`outside_tokens` of each class the rarest ones, so
    many that two similar classes with one partner share one of them.

    Losing any one less than are needed from the tokens, in one order for all sets,
    leaves one that is shared.  What many sets share comes last in that order and is
    seldom needed; a set with fewer tokens than it needs has none."""
    used = F.slice("t", F.lit(1), F.greatest(F.size("t") - F.col("need") + 1, F.lit(0)).cast("int"))
    return ranked.select("cls", F.explode(used).alias("t")).select("cls", "t.token")


def similar_classes(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) between classes of different sets that connect all that are
    connected by similar pairs.

    First each class is compared with one partner p, if they could be similar.  A class is central if its
    signatures are those of many others; the most central class of each
    signature is proposed, and the one proposed most often taken.  That joins
    groups of any size without all their pairs.

    Then the pairs across what is joined are compared, for signatures whose
    classes are not all joined yet.  A pair (u, v) goes on if its sizes allow, and,
    where both prefixes are of rare tokens, if so many of these are shared that
    the rest of the sets could do.  Where both were compared with the same p,
    min(|u & p|, |v & p|) and min(|u - p|, |v - p|) together must do, the latter, where p
    has half of each, counted over tokens that others with p have; and if
    the former does not alone, they must share a token that p has not: then
    near sets (p has half of each) meet at these tokens instead of signatures."""
    shipped = counted_tokens(docs)
    posted = settled(postings(docs, shipped))
    met = posted.groupBy("sig").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = settled(posted.join(met, "sig"))
    central = shared.groupBy("cls").agg((F.sum("df") / F.first("n")).alias("central"))
    heads = (
        shared.join(central, "cls")
        .groupBy("sig")
        .agg(F.max(F.struct("central", "cls")).alias("head"))
        .select("sig", F.col("head.cls").alias("b"))
    )
    votes = shared.join(settled(heads), "sig").where("cls <> b").groupBy("cls", "b").agg(F.count(F.lit(1)).alias("votes"))
    best = votes.groupBy("cls").agg(F.max(F.struct("votes", "b")).alias("best")).select("cls", "best.b", F.col("best.votes").alias("c"))
    sets = settled(shared.select("cls", "n", "whole").distinct())
    partners = sets.select(*[F.col(c).alias(f"_{c}") for c in sets.columns])
    proposed = best.join(sets, "cls").join(partners, F.col("b") == F.col("_cls"))
    hopeful = ~(F.col("whole") & F.col("_whole")) | _enough()
    starred = settled(proposed.where(hopeful).select(F.col("cls").alias("a"), "b"))
    members = starred.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / MEMBERS_AT_ONCE).alias("groups"))
    cell = F.xxhash64("b", F.pmod(F.xxhash64("a"), F.col("groups"))).alias("cell")
    first = settled(verified(docs, classes, starred.join(members, "b").select("a", "b", cell), shipped))
    labels = settled(components(first.where("linked")))
    of_partner = first.select(F.col("a").alias("cls"), F.col("b").alias("p"), F.col("shared").alias("inside"))
    own = F.coalesce("component", "cls").alias("component")
    blocks = of_partner.groupBy("p").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    of_block = of_partner.join(blocks, "p").withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")))
    ranked = settled(outside_tokens(first))
    beyond = ranked.select("cls", F.size("t").alias("beyond"))
    facts = settled(
        sets.join(of_block, "cls", "left")
        .join(beyond, "cls", "left")
        .join(labels.withColumnRenamed("node", "cls"), "cls", "left")
        .select(
            "cls",
            "n",
            "whole",
            own,
            F.coalesce("p", "cls").alias("p"),
            F.coalesce("inside", "n").alias("inside"),
            F.coalesce("beyond", F.lit(0)).alias("beyond"),
            F.xxhash64(F.coalesce("p", "cls"), F.coalesce("block", F.lit(0))).alias("block"),
        )
    )
    marked = settled(shared.select("sig", "cls").join(facts, "cls"))
    mixed = marked.groupBy("sig").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("sig")
    rest = settled(marked.join(mixed, "sig", "left_semi"))
    far = outside_prefixes(ranked).join(facts, "cls")

    both = F.col("n") + F.col("_n")
    inside = F.least("inside", "_inside")
    near = (2 * F.col("inside") >= F.col("n")) & (2 * F.col("_inside") >= F.col("_n"))
    apart = F.least(F.col("n") - F.col("inside"), F.col("_n") - F.col("_inside"))
    outside = F.when(near, F.least("beyond", "_beyond")).otherwise(apart)
    could = (
        (F.col("cls") > F.col("_cls"))
        & (F.col("component") != F.col("_component"))
        & (100 * F.least("n", "_n") >= PERCENT * F.greatest("n", "_n"))
        & ((F.col("p") != F.col("_p")) | ((100 + PERCENT) * (inside + outside) >= PERCENT * both))
    )
    at_tokens = (F.col("p") == F.col("_p")) & near & ((100 + PERCENT) * inside < PERCENT * both)

    def pairs(table: DataFrame, key: str, condition: Column) -> DataFrame:
        other = table.select(*[F.col(c).alias(f"_{c}") for c in table.columns])
        found = table.join(other, (F.col(key) == F.col(f"_{key}")) & could & condition)
        return found.groupBy(F.col("cls").alias("a"), F.col("_cls").alias("b")).agg(
            F.count(F.lit(1)).alias("c"),
            F.first("n").alias("n"),
            F.first("_n").alias("_n"),
            F.first(F.col("whole") & F.col("_whole")).alias("whole"),
            F.first(F.xxhash64("block", "_block")).alias("cell"),
        )

    by_signature = pairs(rest, "sig", ~at_tokens).where(~F.col("whole") | _enough()).select("a", "b", "cell")
    by_token = pairs(far, "token", at_tokens).select("a", "b", "cell")
    second = verified(docs, classes, by_signature.unionByName(by_token), shipped, extras=False)
    return first.unionByName(second).where("linked").select("a", "b")


def _labelled(docs: DataFrame) -> DataFrame:
    """Rows with words: doc_id, text_key, n, component (a label) and component_id;
    and rows without: the same with a null component."""
    sets = settled(shingle_sets(docs))
    classes = settled(
        sets.where("n > 0")
        .groupBy("cls")
        .agg(F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "text_key")).alias("r"))
        .select("cls", F.col("r.doc_id").alias("rep_id"), F.col("r.text_key").alias("rep_key"))
    )
    joined = settled(components(similar_classes(docs, classes)))
    named = classes.join(joined.withColumnRenamed("node", "cls"), "cls", "left").withColumn(
        "component", F.coalesce("component", "cls")
    )
    ids = named.groupBy("component").agg(F.min("rep_id").alias("component_id"))
    of_class = named.join(ids, "component").select("cls", "component", "component_id")
    found = sets.where("n > 0").join(of_class, "cls").drop("cls")
    empty = sets.where("n = 0").select(
        "doc_id",
        "text_key",
        "n",
        F.lit(None).cast("long").alias("component"),
        F.col("doc_id").alias("component_id"),
    )
    return found.unionByName(empty)


def jaccard_groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id for each row of `docs` (doc_id, text).

    A document's set is its distinct shingles of five words, with A-Z in lower
    case; with fewer words the whole sequence is the one shingle.  Two documents
    are linked if 100 * shared >= 75 * union; component_id is the smallest doc_id
    that links reach.  Rows with equal sets are linked.  A null text or one
    without words has an empty set and its own id; null ids count last, and a
    component of null ids only has a null id.  An empty table gives an empty one.
    Other columns are ignored.
    """
    return _labelled(docs).select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")


def one_per_group(docs: DataFrame) -> DataFrame:
    """`docs` with one row of each component: that with the smallest doc_id (of
    equal ids, one with the smallest text hash).  Rows without words all stay."""
    labelled = settled(_labelled(docs).select("doc_id", "text_key", "component"))
    ranked = F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "text_key")
    first = (
        labelled.where("component IS NOT NULL")
        .groupBy("component")
        .agg(F.min(ranked).alias("r"))
        .select("component", F.col("r.doc_id").alias("first_id"), F.col("r.text_key").alias("first_key"))
    )
    rows = labelled.where("component IS NOT NULL").groupBy("component", "doc_id", "text_key").agg(
        F.count(F.lit(1)).alias("copies")
    )
    stays = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("text_key") == F.col("first_key"))
    # Rows that go, and rows that stay but are there more than once.
    id_, key, stay, text_key = free_names(docs, 4)
    marked = settled(
        rows.join(first, "component")
        .where(~stays | (F.col("copies") > 1))
        .select(F.col("doc_id").alias(id_), F.col("text_key").alias(key), stays.alias(stay))
    )
    keyed = docs.withColumn(text_key, F.xxhash64("text"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (F.col(text_key) == F.col(key))
    unique = keyed.join(small_side(marked), same, "left_anti")
    twice = keyed.join(small_side(marked.where(stay)), same, "left_semi").dropDuplicates(["doc_id", text_key])
    return unique.unionByName(twice).select(*docs.columns)
