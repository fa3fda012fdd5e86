"""One incremental run over a message table."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadmill.operators.deletions import (
    checkpoint_update,
    deletion_rows,
    missing_messages,
    seen_ids,
)
from threadmill.operators.upsert import apply_log, change_summary, upsert_changes
from threadmill.schema import MESSAGES
from threadmill.sinks.exports import jsonl_rows, write_csv, write_jsonl
from threadmill.sinks.manifest import Conflict
from threadmill.sinks.shared import settled
from threadmill.sinks.store import MessageStore
from threadmill.sources.raw import edit_rescan, incremental_scan


@dataclass(frozen=True)
class SyncRun:
    """Results of a run.  `log` holds the rows it changed, with `change_type`;
    log and summary are computed, the other two are lazy."""

    log: DataFrame
    summary: DataFrame
    snapshot: DataFrame
    checkpoints: DataFrame


def sync_run(
    current: DataFrame,
    checkpoints: DataFrame,
    scanned: DataFrame,
    scopes: DataFrame,
    cutoff: object,
    edit_cutoff: object | None = None,
) -> SyncRun:
    """New messages since the checkpoints, edits and deletions in the re-scan window.

    `scanned` are flattened rows; `scopes` says which chats and topics were
    scanned, how far back, and whether completely.  Without an `edit_cutoff`
    the re-scan reaches back to `cutoff`.

    The increment and the log are written to the shared folder: both are small
    beside the table, and are joined to it.
    """
    return _run(current, current, checkpoints, scanned, scopes, cutoff, edit_cutoff)


def _run(
    touched: DataFrame,
    scope: DataFrame,
    checkpoints: DataFrame,
    scanned: DataFrame,
    scopes: DataFrame,
    cutoff: object,
    edit_cutoff: object | None = None,
    earliest: object | None = None,
) -> SyncRun:
    """`touched` holds at least the rows whose keys were scanned, `scope` at least
    those that a scan could have seen."""
    fresh = incremental_scan(scanned, checkpoints, cutoff)
    again = edit_rescan(scanned, cutoff if edit_cutoff is None else edit_cutoff)
    staged = fresh.unionByName(again).distinct()
    if "id" not in staged.columns:
        staged = staged.withColumn("id", F.lit(None).cast("bigint"))
    staged = settled(staged)

    changes = upsert_changes(touched, staged, ("updated_at", "edit_date", "id"))
    seen = seen_ids(staged)
    # What was seen cannot be missing, so the table before the upsert will do.
    deletions = deletion_rows(missing_messages(scope, seen, scopes, earliest))
    columns = [*MESSAGES.names, "change_type"]
    all_rows = settled(changes.select(*columns).unionByName(deletions.select(*columns)))
    log = all_rows.where(F.col("change_type") != "unchanged")
    return SyncRun(
        log=log,
        summary=change_summary(all_rows),
        snapshot=apply_log(touched, log),
        checkpoints=checkpoint_update(checkpoints, scopes, seen),
    )


def sync_store(
    store: MessageStore,
    batch_id: int,
    scanned: DataFrame,
    scopes: DataFrame,
    cutoff: object,
    edit_cutoff: object | None = None,
    writer: str = "sync",
) -> SyncRun:
    """The same against a store, as batch `batch_id` of `writer`.

    The table is read where it can matter: the partitions of the keys found, and
    for deletions those of the chats scanned, from the earliest cutoff on.
    Running a batch again, after a failure, changes nothing and returns the same;
    one that meets a batch of another writer is computed anew.
    """
    scanned, scopes = settled(scanned), settled(scopes)
    earliest = scopes.where("scan_complete").agg(F.min("cutoff")).first()[0]
    while True:
        done = store.applied(writer, batch_id)
        if done is not None and done.kind == "fold":
            raise ValueError(f"batch {batch_id} of {writer} has been folded into the base")
        seen = store.version() if done is None else done.number - 1
        touched = store.state(seen + 1, store.places(scanned)).select(*MESSAGES.names)
        scope = store.state(seen + 1, store.places(scopes), earliest).select(*MESSAGES.names)
        run = _run(touched, scope, store.checkpoints(seen + 1), scanned, scopes, cutoff, edit_cutoff, earliest)
        run = replace(run, snapshot=apply_log(store.current(seen + 1), run.log))
        try:
            store.commit(writer, batch_id, run.log, run.checkpoints, seen)
            return run
        except Conflict:
            continue


def export_if_changed(
    summary: DataFrame, messages: DataFrame, csv_path: str | None = None, jsonl_path: str | None = None
) -> bool:
    """Rebuild the exports after a run that changed something."""
    needed = bool(summary.first()["export_needed"])
    if needed and csv_path:
        write_csv(messages, csv_path)
    if needed and jsonl_path:
        write_jsonl(jsonl_rows(messages), jsonl_path)
    return needed
