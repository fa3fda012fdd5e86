"""Reply trees as training conversations."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadmill.llm.common import partitions, running_totals, scratch_path, settled

# Fixed values of the template.  A turn is OPEN, role, line feed, text, CLOSE,
# line feed.  Texts and roles never contain OPEN, CLOSE or an instruction mark:
# every < and [ in them is written as an escape.
OPEN, CLOSE = "<s>", "</s>"
ESCAPES = (("\\", "\\\\"), ("<", "\\l"), ("[", "\\b"))
_PLAIN = {"\\\\": "\\", "\\l": "<", "\\b": "["}
LOSS_ROLE = "assistant"
PART_TURNS = 256
HEAD_CHARS = 256

_TURN = re.compile(r"<s>([^\n<]*)\n([^<]*)</s>\n")


def escaped(text):
    """A text as it stands in the output; nulls count as empty."""
    out = F.coalesce(text, F.lit(""))
    for plain, written in ESCAPES:
        out = F.replace(out, F.lit(plain), F.lit(written))
    return out


def unescaped(text: str) -> str:
    return re.sub(r"\\.", lambda m: _PLAIN[m[0]], text) if "\\" in text else text


def chains(conversations: DataFrame) -> DataFrame:
    """Rows by turn (conv_id, turn, role, text) as reply trees without branches.

    A row replies to the row before it by turn.  Equal turns are ordered by role
    and text, null turns come first.  Rows with a null conv_id form one tree.
    Adds tree_id, node_id (numbers grow along a tree), parent_id and a score of 0.

    The whole table is numbered by ranges, so a conversation of any length uses
    as many tasks as it fills; only its rows of one turn, with one role and one
    beginning of the text, stay together."""
    rows = conversations.select(
        F.col("conv_id").alias("tree_id"), "turn", "role", "text", F.lit(1).cast("long").alias("_one")
    )
    order = [F.col("tree_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.substring("text", 1, HEAD_CHARS)]
    numbered = running_totals(rows, order, "_one", [F.col("text")])
    heads = numbered.groupBy("tree_id").agg(F.min("rank").alias("rank")).select("rank", F.lit(True).alias("_head"))
    return numbered.join(heads, "rank", "left").select(
        "tree_id",
        F.col("rank").alias("node_id"),
        F.when(F.col("_head").isNull(), F.col("rank") - 1).alias("parent_id"),
        "role",
        "text",
        F.lit(0.0).alias("score"),
    )


def best_paths(nodes: DataFrame, paths: int = 1) -> DataFrame:
    """The `paths` best root-to-leaf paths of each tree of `nodes` (tree_id,
    node_id, parent_id, score): tree_id, path (1 is the best), depth, node_id.

    Each round joins the pointers of nodes that do not know their root yet with the
    whole table, so that a node knows an ancestor twice as far, the sum of the
    scores up to it and the distance; a tree of depth n takes log2(n) rounds.  A path's score is the mean of its
    nodes' scores, a null counting as 0; ties go to the longer path, then to the
    smaller leaf, and every task sends its best `paths` leaves of a tree at most.
    Marking the chosen paths walks the same tables back.  No task ever holds a
    path or a tree.

    A node whose parent is null or absent is a root; nodes on or below a cycle
    belong to no path.  (tree_id, node_id) is unique; null trees are a tree.
    """
    keys = nodes.select("tree_id", "node_id", "parent_id", F.coalesce("score", F.lit(0.0)).alias("score"))
    present = keys.select(F.col("tree_id").alias("_tree"), F.col("node_id").alias("_node"))
    same = F.col("tree_id").eqNullSafe(F.col("_tree"))
    linked = keys.join(present, same & (F.col("parent_id") == F.col("_node")), "left")
    level = settled(
        linked.select("tree_id", "node_id", F.col("_node").alias("up"), F.col("score").alias("sum"), F.lit(1).alias("n"))
    )
    rooted, jumps = level.where("up IS NULL"), []
    limit = max(int(level.count()), 1).bit_length() + 1
    climbing = links = level.where("up IS NOT NULL")
    while len(jumps) <= limit and not climbing.isEmpty():
        jumps.append(climbing)
        far = rooted.unionByName(climbing).select(
            F.col("tree_id").alias("_tree"),
            F.col("node_id").alias("_node"),
            F.col("up").alias("_up"),
            F.col("sum").alias("_sum"),
            F.col("n").alias("_n"),
        )
        level = settled(
            climbing.join(far, same & (F.col("up") == F.col("_node"))).select(
                "tree_id",
                "node_id",
                F.col("_up").alias("up"),
                (F.col("sum") + F.col("_sum")).alias("sum"),
                (F.col("n") + F.col("_n")).alias("n"),
            )
        )
        rooted = rooted.unionByName(level.where("up IS NULL"))
        climbing = level.where("up IS NOT NULL")
    parents = links.select(F.col("tree_id").alias("_tree"), F.col("up").alias("_node")).distinct()
    leaves = rooted.join(parents, same & (F.col("node_id") == F.col("_node")), "left_anti")
    best = Window.partitionBy("tree_id").orderBy((F.col("sum") / F.col("n")).desc(), F.desc("n"), "node_id")
    marked = settled(
        leaves.withColumn("path", F.row_number().over(best)).where(F.col("path") <= paths).select(
            "tree_id", "path", "node_id"
        )
    )
    for table in reversed(jumps):
        ups = table.select(
            F.col("tree_id").alias("_tree"), F.col("node_id").alias("_node"), F.col("up").alias("_up")
        )
        more = marked.join(ups, same & (F.col("node_id") == F.col("_node"))).select(
            "tree_id", "path", F.col("_up").alias("node_id")
        )
        marked = settled(marked.unionByName(more))
    depth = rooted.select(
        F.col("tree_id").alias("_tree"), F.col("node_id").alias("_node"), (F.col("n") - 1).alias("depth")
    )
    return marked.join(depth, same & (F.col("node_id") == F.col("_node"))).select("tree_id", "path", "depth", "node_id")


def format_paths(nodes: DataFrame, chosen: DataFrame) -> DataFrame:
    """The chosen paths in the template: tree_id, path, part, formatted, n_turns,
    loss_spans (characters of `formatted`, from and to, that are trained on).

    A conversation is its parts in order; a part has PART_TURNS turns at most,
    so a row stays small however long a conversation is."""
    texts = nodes.select(F.col("tree_id").alias("_tree"), F.col("node_id").alias("_node"), "role", "text")
    on = F.col("tree_id").eqNullSafe(F.col("_tree")) & (F.col("node_id") == F.col("_node"))
    head = F.concat(F.lit(OPEN), escaped(F.regexp_replace("role", "\n", " ")), F.lit("\n"))
    body = escaped(F.col("text"))
    turns = chosen.join(texts, on).select(
        "tree_id",
        "path",
        F.expr(f"depth div {PART_TURNS}").alias("part"),
        F.struct(
            "depth",
            F.concat(head, body, F.lit(CLOSE + "\n")).alias("text"),
            F.length(head).alias("head"),
            F.length(body).alias("body"),
            F.coalesce(F.col("role") == LOSS_ROLE, F.lit(False)).alias("loss"),
        ).alias("turn"),
    )
    parts = turns.groupBy("tree_id", "path", "part").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start: int, stop: int>>)").alias("spans"))

    def step(acc, t):
        begin = acc["at"] + t["head"]
        span = F.struct(begin.alias("start"), (begin + t["body"]).alias("stop"))
        spans = F.when(t["loss"], F.array_append(acc["spans"], span)).otherwise(acc["spans"])
        return F.struct((acc["at"] + F.length(t["text"])).alias("at"), spans.alias("spans"))

    return parts.select(
        "tree_id",
        "path",
        "part",
        F.array_join(F.transform("turns", lambda t: t["text"]), "").alias("formatted"),
        F.size("turns").cast("long").alias("n_turns"),
        F.aggregate("turns", start, step)["spans"].alias("loss_spans"),
    )


def parse_part(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn; the inverse of the template."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at character {at}")
        turns.append((unescaped(m[1]), unescaped(m[2])))
        at = m.end()
    return turns


_DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def conversation_digests(written: DataFrame) -> DataFrame:
    """Digests of formatted conversations, from the parts as written.

    Parts are sorted by conversation inside each task and pass through it one
    after the other; only running digests are kept."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        done: list[tuple] = []

        def finish() -> None:
            if state is not None:
                done.append((key[0], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        def flush() -> pa.RecordBatch:
            columns = list(zip(*done)) or [()] * 6
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            names = [c.split()[0] for c in _DIGEST.split(", ")]
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)
            done.clear()
            return batch

        for batch in batches:
            for tree, path, formatted, spans in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if (tree, path) != key:
                    finish()
                    key, state = (tree, path), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in parse_part(formatted):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                for span in spans:
                    text = unescaped(formatted[span["start"] : span["stop"]])
                    state[2] += len(text)
                    state[3].update(text.encode("utf-8", "surrogatepass"))
                state[4] += len(formatted)
            if done:
                yield flush()
        finish()
        yield flush()

    spark = written.sparkSession
    ordered = written.repartition(partitions(spark), "tree_id", "path").sortWithinPartitions("tree_id", "path", "part")
    return ordered.select("tree_id", "path", "formatted", "loss_spans").mapInArrow(read, _DIGEST)


def format_conversations(conversations: DataFrame, folder: str | None = None) -> DataFrame:
    """Format whole `conversations` (conv_id, turn, role, text), write them as
    Parquet to `folder` and return what was written.  Null roles and texts count
    as empty, a line feed in a role as a space; an empty table writes no rows."""
    spark = conversations.sparkSession
    nodes = settled(chains(conversations))
    path = folder or scratch_path(spark)
    format_paths(nodes, best_paths(nodes)).write.parquet(path)
    return spark.read.parquet(path)
