"""A message table kept as Parquet: a base and a log of changes.

Plain Parquet files cannot be updated in place.  The store has a base, one row
per key, and for every batch the rows it changed.  A row's place is its
`chat_bucket` and `id_range`; a folder holds the places of a bucket in an
`id_block`, one or neighbouring ones, so many that a part has few folders
however many places there are.  So a batch reads only the part of the table it
touches, and files stay large.  :mod:`threadmill.sinks.manifest` says which batches count, and in what
order: readers see whole batches only, each batch of a writer counts once, and a
batch that was computed from a table that changed meanwhile is refused.

:func:`MessageStore.fold` moves the log into the base, rewriting the
partitions the log touches and no others; batches cost as much after a thousand
batches as after the first.

Besides the message columns a row has what is needed to put a scan that comes
late in its place (:func:`threadmill.streaming.ingest.ordered_changes`): `run`, the
scans since which it reads as it does, and `before`, the place of the last
scan that read differently, or of the row itself where what came before is not known.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadmill.operators.filters import content, since
from threadmill.schema import CHECKPOINTS, KEY, MESSAGES, SCOPE
from threadmill.sinks.manifest import Conflict, Entry, Manifest
from threadmill.sinks.shared import settled

PLACE = ["chat_bucket", "id_range"]
FOLDERS = ["chat_bucket", "id_block"]
_RANGE = T.StructField("id_range", T.LongType())
_BUCKET = T.StructField("chat_bucket", T.IntegerType())
_BLOCK = T.StructField("id_block", T.LongType())
_PART = T.StructField("part", T.StringType())
_KIND = T.StructField("change_type", T.StringType())
_RUN = T.ArrayType(
    T.StructType([MESSAGES["updated_at"], MESSAGES["date"], MESSAGES["chat_id"]])
)
_BEFORE = T.StructType([MESSAGES["updated_at"], MESSAGES["edit_date"], T.StructField("version", T.LongType())])
ORDERED = [T.StructField("run", _RUN), T.StructField("before", _BEFORE)]

# A block of level k is of 16**k ranges, cut at its multiples.
LEVELS = 8
# A part has at most about so many folders, or one for so many rows.
MOST_FOLDERS = 512
ROWS_PER_FOLDER = 1 << 18

# So many batches in the log are folded into the base by those who write regularly.
FOLD_AFTER = 16


def version() -> Column:
    """Makes the order of versions total."""
    return F.xxhash64(content())


def anchored(rows: DataFrame) -> DataFrame:
    """`rows` as the store keeps them if nothing is known about the time before."""
    own = {
        "run": F.array(F.struct("updated_at", "date", "chat_id")),
        "before": F.struct("updated_at", "edit_date", version().alias("version")),
    }
    return rows.withColumns({k: v for k, v in own.items() if k not in rows.columns})


def _prunable(places: DataFrame) -> DataFrame:
    """A written table.  The condition holds for every row; it marks the table as
    worth pruning a scan by."""
    return settled(places).where("chat_bucket >= 0")


def _block(level: int) -> Column:
    """The number of the block of this level, different from those of all other levels."""
    return F.floor(F.col("id_range") / 16**level) * LEVELS + level


def _level(places: DataFrame) -> int:
    """The lowest level whose blocks make few folders of `places`, with `rows` if known."""
    folders = [F.approx_count_distinct(F.xxhash64("chat_bucket", _block(k))) for k in range(LEVELS)]
    rows = F.sum("rows") if "rows" in places.columns else F.lit(0)
    n_rows, *counts = places.agg(rows, *folders).first()
    most = max(MOST_FOLDERS, (n_rows or 0) // ROWS_PER_FOLDER)
    return next((k for k, n in enumerate(counts) if n <= most), LEVELS - 1)


@dataclass(frozen=True)
class MessageStore:
    spark: SparkSession
    path: str
    buckets: int = 64
    ids_per_range: int = 1_000_000

    @property
    def manifest(self) -> Manifest:
        return Manifest(self.spark, f"{self.path}/manifest")

    def create(self) -> MessageStore:
        """Make an empty store; leaves an existing one alone."""
        if not self.manifest.numbers():
            try:
                self.manifest.commit(Entry(0, "fold", [], through=0))
            except Conflict:
                pass
        return self

    def version(self) -> int:
        """The number of the last entry: what a batch is computed from."""
        return self.manifest.numbers()[-1]

    def applied(self, writer: str, batch: int) -> Entry | None:
        """The entry that holds this batch of this writer, if it is in the table."""
        for entry in self.manifest.live():
            if entry.kind == "batch" and (entry.writer, entry.batch) == (writer, batch):
                return entry
            if entry.kind == "fold" and entry.applied.get(writer, -1) >= batch:
                return entry
        return None

    # Places

    def _placed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumns(
            {
                "chat_bucket": F.pmod(F.xxhash64("chat_identifier"), F.lit(self.buckets)).cast("int"),
                "id_range": F.floor(F.col("message_id") / self.ids_per_range),
            }
        )

    def places(self, keys: DataFrame) -> DataFrame:
        """The places in which `keys`, or all messages of its scopes, lie: a small
        written table."""
        if "message_id" in keys.columns:
            return _prunable(self._placed(keys.select(*KEY)).select(*PLACE).distinct())
        scopes = keys.select("chat_identifier", F.lit(None).cast("long").alias("message_id"))
        return _prunable(self._placed(scopes).select("chat_bucket").distinct())

    # Reading

    def _read(self, kind: str, parts: Sequence[str], fields: Sequence[T.StructField], near: DataFrame | None) -> DataFrame:
        """The rows of some parts; with `near`, a table of places, those in these: a
        join on the folders too, by which Spark prunes the scan."""
        folders = [_BUCKET, _PART] if kind == "places" else [_PART, _BUCKET, _BLOCK]
        schema = T.StructType([*fields, _RANGE, *folders])
        if not parts:
            return self.spark.createDataFrame([], schema)
        folder = f"{self.path}/{kind}"
        rows = self.spark.read.schema(schema).option("basePath", folder).parquet(*(f"{folder}/part={p}" for p in parts))
        if near is None:
            return rows
        if "id_range" in near.columns:
            # The levels of the parts are not looked up: a place is in one block of each.
            near = near.withColumn("id_block", F.explode(F.array(*map(_block, range(LEVELS)))))
        return rows.join(near, near.columns, "left_semi")

    def _base(self, folds: Sequence[str], near: DataFrame | None) -> DataFrame:
        rows = self._read("base", folds, [*MESSAGES.fields, *ORDERED], near)
        if len(folds) < 2:
            return rows
        written = self._read("places", folds, [], None)
        number = F.element_at(F.create_map(*(F.lit(x) for i, p in enumerate(folds) for x in (p, i))), F.col("part"))
        newest = written.groupBy(*PLACE).agg(F.max_by("part", number).alias("part"))
        return rows.join(newest, [*PLACE, "part"], "left_semi")

    def _log(self, entries: Sequence[Entry], near: DataFrame | None) -> DataFrame:
        rows = self._read("log", [e.parts[0] for e in entries], [*MESSAGES.fields, *ORDERED, _KIND], near)
        pairs = [F.lit(x) for e in entries for x in (e.parts[0], e.number)]
        number = F.element_at(F.create_map(*pairs), F.col("part")) if pairs else F.lit(0)
        return rows.withColumn("number", number)

    def state(
        self, before: int | None = None, near: DataFrame | None = None, since_date: object | None = None
    ) -> DataFrame:
        """One row per key, with `run` and `before`, after the entries below number `before`.

        With `near`, a table of :func:`places`, at least the rows in these; with
        `since_date`, at least the rows dated then or later."""
        live = self.manifest.live(before)
        folds = [p for e in live if e.kind == "fold" for p in e.parts]
        batches = [e for e in live if e.kind == "batch"]
        columns = [*MESSAGES.names, "run", "before"]
        base = self._base(folds, near)
        if since_date is not None:
            base = since(base, since_date)
        if not batches:
            return base.select(*columns)
        log = self._log(batches, near)
        newest = log.groupBy(*KEY).agg(F.max_by(F.struct(*columns), "number").alias("row")).select("row.*")
        rest = base.join(log.select(*KEY).distinct(), list(KEY), "left_anti")
        return rest.select(*columns).unionByName(newest)

    def current(self, before: int | None = None, near: DataFrame | None = None) -> DataFrame:
        """One row per key; with `near`, rows with keys, at least all that share one with it."""
        return self.state(before, None if near is None else self.places(near)).select(*MESSAGES.names)

    def change_log(self) -> DataFrame:
        """The changes since the last fold, with `change_type` and the entry's `number`."""
        batches = [e for e in self.manifest.live() if e.kind == "batch"]
        changed = self._log(batches, None).where("change_type <> 'unchanged'")
        return changed.select(*MESSAGES.names, "change_type", "number")

    def checkpoints(self, before: int | None = None) -> DataFrame:
        """Highest message id and latest run per scope, over all batches."""
        parts = [p for e in self.manifest.live(before) for p in e.parts]
        paths = [f"{self.path}/checkpoints/part={p}" for p in parts]
        if not paths:
            return self.spark.createDataFrame([], T.StructType(CHECKPOINTS.fields))
        written = self.spark.read.schema(T.StructType(CHECKPOINTS.fields)).parquet(*paths)
        return written.groupBy(*SCOPE).agg(
            F.max("last_message_id").alias("last_message_id"), F.max("last_run_ts").alias("last_run_ts")
        )

    def counters(self) -> DataFrame:
        """What each batch since the last fold did: number, writer, batch, and rows by kind of change."""
        kinds = ("insert", "update", "revive", "delete", "unchanged")
        rows = [
            (e.number, e.writer, e.batch, *(e.counts.get(k, 0) for k in kinds))
            for e in self.manifest.live()
            if e.kind == "batch"
        ]
        names = "number long, writer string, batch long, " + ", ".join(f"`{k}` long" for k in kinds)
        return self.spark.createDataFrame(rows, names)

    # Writing

    def _write(self, rows: DataFrame, kind: str, part: str, places: DataFrame | None = None) -> None:
        """`rows` as a part; `places`, theirs with the number of `rows` in each, if known."""
        placed = self._placed(rows)
        if places is None:
            places = placed.groupBy(*PLACE).agg(F.count(F.lit(1)).alias("rows"))
        # Rebalancing splits a large folder over tasks and keeps a small one whole.
        blocks = placed.withColumn("id_block", _block(_level(places))).hint("rebalance", *FOLDERS)
        blocks.write.partitionBy(*FOLDERS).parquet(f"{self.path}/{kind}/part={part}")

    def _write_checkpoints(self, scopes: DataFrame | None, part: str) -> None:
        if scopes is None:
            scopes = self.spark.createDataFrame([], T.StructType(CHECKPOINTS.fields))
        rows = scopes.select(*CHECKPOINTS.names)
        rows.hint("rebalance").write.parquet(f"{self.path}/checkpoints/part={part}")

    def commit(
        self,
        writer: str,
        batch: int,
        changes: DataFrame,
        checkpoints: DataFrame | None = None,
        seen: int | None = None,
    ) -> Entry:
        """Add a batch: rows with `change_type`, of which those that change nothing,
        not even `run`, are left out, and how far it got in each scope.

        `seen` is the :func:`version` from which it was computed; if there is a
        newer one, :class:`Conflict` is raised and the table stays as it is.  A
        batch that is in the table already is not added again."""
        done = self.applied(writer, batch)
        if done is not None:
            return done
        part = f"p{uuid.uuid4().hex}"
        if "run" not in changes.columns:
            changes = anchored(changes.where(F.col("change_type") != "unchanged"))
        self._write(changes.select(*MESSAGES.names, "run", "before", "change_type"), "log", part)
        self._write_checkpoints(checkpoints, part)
        written = self._read("log", [part], [*MESSAGES.fields, *ORDERED, _KIND], None)
        counts = {r[0]: r[1] for r in written.groupBy("change_type").count().collect()}
        number = (self.version() if seen is None else seen) + 1
        return self.manifest.commit(Entry(number, "batch", [part], writer, batch, counts=counts))

    def write_base(self, messages: DataFrame) -> None:
        """Replace everything by a table with one row per key."""
        part, seen = f"p{uuid.uuid4().hex}", self.version()
        self._write_fold(anchored(messages.select(*MESSAGES.names)), part)
        self._write_checkpoints(None, part)
        self.manifest.commit(Entry(seen + 1, "fold", [part], through=seen + 1))

    def _write_fold(self, rows: DataFrame, part: str, places: DataFrame | None = None) -> None:
        columns = [*MESSAGES.names, "run", "before"]
        self._write(rows.select(*columns), "base", part, places)
        if places is None:
            places = self._read("base", [part], [], None).select(*PLACE).distinct()
        places.select(*PLACE).hint("rebalance").write.parquet(f"{self.path}/places/part={part}")

    def fold(self) -> Entry | None:
        """Move the log into the base: the partitions it touches are written anew, as
        a part that takes their place; the others stay.  Batches that are committed
        meanwhile stay in the log; if another fold is, this one has no effect."""
        live = self.manifest.live()
        batches = [e for e in live if e.kind == "batch"]
        if not batches:
            return None
        seen, part = batches[-1].number, f"p{uuid.uuid4().hex}"
        last = next((e for e in live if e.kind == "fold"), Entry(-1, "fold", []))
        touched = _prunable(self._log(batches, None).select(*PLACE).distinct())
        self._write_fold(self.state(seen + 1, touched), part, touched)
        self._write_checkpoints(self.checkpoints(seen + 1), part)
        applied = dict(last.applied)
        for entry in batches:
            applied[entry.writer] = max(applied.get(entry.writer, -1), entry.batch)
        while True:
            now = self.manifest.live()
            if any(e.kind == "fold" and e.number > last.number for e in now):
                return None
            number = max(e.number for e in now) + 1
            try:
                return self.manifest.commit(
                    Entry(number, "fold", [*last.parts, part], through=seen, applied=applied)
                )
            except Conflict:
                continue

    def compact(self, path: str, before: int | None = None) -> MessageStore:
        """A new store at `path` with the current rows as its base."""
        compacted = MessageStore(self.spark, path, self.buckets, self.ids_per_range).create()
        part = f"p{uuid.uuid4().hex}"
        compacted._write_fold(self.state(before), part)
        compacted._write_checkpoints(self.checkpoints(before), part)
        applied: dict[str, int] = {}
        for entry in self.manifest.live(before):
            for writer, batch in {**entry.applied, **({entry.writer: entry.batch} if entry.writer else {})}.items():
                applied[writer] = max(applied.get(writer, -1), batch)
        compacted.manifest.commit(Entry(1, "fold", [part], through=1, applied=applied))
        return compacted
