"""Change data: an ordered journal for each drive, merged into state that remembers what it has seen.

State has one row for each (drive, file_ref) named, with the last change's seq and whether that
deleted it. A merge takes the latest of state and batch, so batches may come in any order and twice. How it is stored: log_state.
"""

from __future__ import annotations

import json
import time
from datetime import datetime

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.names import JUNK_DIRS, USER_DIRS
from lodestone.operators.hierarchy import directory_chains, stamped
from lodestone.sources.external import register
from lodestone.sources.tables import EVENTS, dealt, save_snapshot, stored
from lodestone.streaming.log_state import RECORD, add_run, is_due, latest, load_manifest, mark_saved, state_of
from lodestone.streaming.log_state import STATE as STATE
from lodestone.streaming.log_state import load_state as load_state

#: Journal reasons, by which a record is one change.
DELETE, RENAMED, CREATE, RENAMED_FROM = 0x200, 0x2000, 0x100, 0x1000


def journal_events(records: DataFrame) -> DataFrame:
    """Changes from journal records (drive, seq, file_ref, parent_ref, name, is_dir, reason): deletion before new name before creation; others and empty names none."""
    bit = lambda mask: F.col("reason").bitwiseAND(mask) != 0
    op = F.when(bit(DELETE), "deleted").when(bit(RENAMED), "moved").when(bit(CREATE), "created")
    return records.withColumn("op", op).where("op is not null and name <> ''").withColumn("old_ref", F.lit(None).cast("long")).select("drive", "seq", "op", "file_ref", "old_ref", *RECORD)


def changes(events: DataFrame) -> DataFrame:
    """STATE rows of events: a rename to another ref deletes the old one; a checkpoint changes nothing."""
    put = events.where(F.col("op").isin("created", "moved", "renamed", "deleted")).select("drive", "file_ref", *RECORD, "seq", (F.col("op") == "deleted").alias("gone"))
    renamed = events.where((F.col("op") == "renamed") & F.col("old_ref").isNotNull() & (F.col("old_ref") != F.col("file_ref")))
    old = renamed.select("drive", F.col("old_ref").alias("file_ref"), *RECORD, "seq", F.lit(True).alias("gone"))
    return put.unionByName(old)


def merged(state: DataFrame, events: DataFrame) -> DataFrame:
    """The state after the events: the last change of each (drive, file_ref); of one seq the deletion."""
    return latest(dealt(state.unionByName(changes(events)), "drive", "file_ref"))


def live(state: DataFrame) -> DataFrame:
    """SCAN rows that are there."""
    return state.where("not gone").select("drive", "file_ref", *RECORD)


def from_scan(records: DataFrame, seq: int = 0) -> DataFrame:
    """State of a full scan that began at journal position seq."""
    return records.select("drive", "file_ref", *RECORD, F.lit(seq).cast("long").alias("seq"), F.lit(False).alias("gone"))


def rescans(drives: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """(drive, rescan): a drive without a checkpoint, of another journal or outside the journal's range is scanned anew.

    drives: drive, journal_id, first_seq, next_seq; checkpoints: drive, journal_id, next_seq.
    """
    known = checkpoints.select("drive", F.col("journal_id").alias("seen_id"), F.col("next_seq").alias("seen"))
    valid = (F.col("seen_id") == F.col("journal_id")) & F.col("seen").between(F.col("first_seq"), F.col("next_seq"))
    return drives.join(known, "drive", "left").select("drive", (~F.coalesce(valid, F.lit(False))).alias("rescan"))


def with_junk(state: DataFrame, junk_refs: DataFrame, roots: DataFrame | None = None, junk_dirs=JUNK_DIRS, user_dirs=USER_DIRS) -> tuple[DataFrame, DataFrame]:
    """(entries, junk_refs) after changes: what lies under a junk directory, or under a ref that was pruned before, is junk.

    A pruned ref stays junk until a change deletes it or moves it elsewhere; what was pruned below it isn't known and stays.
    roots, junk_dirs, user_dirs: as of hierarchy.with_ancestry.
    """
    state = stored(state, "state")  # it is read several times
    seen = state.select("drive", "file_ref")
    pruned = junk_refs.select("drive", "file_ref").distinct().join(seen, ["drive", "file_ref"], "left_anti")
    # pruned refs that hold something stand as directories at the root; they have no rows of their own
    now = live(state)
    holders = now.select("drive", F.col("parent_ref").alias("file_ref")).distinct()
    stand_ins = pruned.join(holders, ["drive", "file_ref"], "left_semi").select("drive", "file_ref", F.lit(0).cast("long").alias("parent_ref"), F.lit("").alias("name"), F.lit(True).alias("is_dir"))
    chains = directory_chains(now.unionByName(stand_ins), junk_dirs, user_dirs, junk_refs=stand_ins)
    whole = stamped(now, chains, roots, user_dirs)
    return whole.where("not is_junk").drop("is_junk"), whole.where("is_junk").select("drive", "file_ref").unionByName(pruned)


def apply_batch(spark: SparkSession, path: str, batch: DataFrame) -> int:
    """Adds a batch to the state under path and publishes the next version; an empty first state is fine. Returns the version.

    What is written grows with the batch, not with the state (see log_state). A batch may come again, as after a crash, and
    several writers may add batches at once.
    """
    batch = batch.persist()  # a batch, not the state
    try:
        found = batch.groupBy("drive").agg(F.max("seq").alias("seq"), F.count("*").alias("n")).collect()  # a row for each drive
        positions = {r["drive"]: r["seq"] for r in found if r["drive"] is not None and r["seq"] is not None}
        return add_run(spark, path, changes(batch), positions, sum(r["n"] for r in found))
    finally:
        batch.unpersist()


def compact(spark: SparkSession, path: str, snapshot: str, roots: DataFrame, junk_refs: DataFrame, every: int = 1, **options) -> int | None:
    """Saves entries, junk_refs, roots and checkpoints of the state as a snapshot after each `every` batches.

    Nothing is published if it isn't time or if there are no entries: the old snapshot stays. Returns the snapshot's version.
    """
    newest = load_manifest(spark, path)
    if newest is None or newest[1]["batches"] % every:
        return None
    return _saved(spark, path, newest[1], snapshot, roots, junk_refs, **options)


def save_if_due(spark: SparkSession, path: str, snapshot: str, roots: DataFrame, junk_refs: DataFrame, events: int = 500, seconds: float = 30.0, **options) -> int | None:
    """Saves a snapshot as `compact` does if `events` are pending and the last save is `seconds` ago; None otherwise."""
    newest = load_manifest(spark, path)
    if newest is None or not is_due(newest[1], time.time(), events, seconds):
        return None
    return _saved(spark, path, newest[1], snapshot, roots, junk_refs, **options)


def _saved(spark: SparkSession, path: str, manifest: dict, snapshot: str, roots: DataFrame, junk_refs: DataFrame, **options) -> int | None:
    state = state_of(spark, path, manifest)
    checkpoints = spark.createDataFrame(sorted(manifest["positions"].items()), "drive string, next_seq long")
    entries, junk = with_junk(state, junk_refs, roots=roots, **options)
    saved = save_snapshot({"entries": entries, "junk_refs": junk, "roots": roots, "checkpoints": checkpoints}, snapshot, keep_if_empty="entries")
    if saved is not None:
        mark_saved(spark, path, manifest)
    return saved


def replay(spark: SparkSession, source: str, path: str, checkpoint: str, once: bool = True, most_files: int = 1000):
    """A stream of JSON change files into state under path: all there is now and then an end, or each half second. A batch has most_files files at most."""
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", most_files).json(source)
    writer = stream.writeStream.foreachBatch(lambda batch, _: apply_batch(batch.sparkSession, path, batch)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="500 milliseconds")).start()


def replay_journal(spark: SparkSession, journal: str, path: str, checkpoint: str, start: str = "end", positions: dict[str, tuple[int, int]] | None = None, most_events: int = 10_000, every: str = "500 milliseconds"):
    """A stream of the journals of all drives (see sources.external) into state under path, in batches of most_events at most.

    Without a saved position (positions: drive to journal id and next position) a drive's journal begins at `start`, its first
    record or its end. A position of another journal, or one that the journal has no more, ends the query with RescanNeeded.
    For a catch-up wait for processAllAvailable(), then stop the query.
    """
    register(spark)
    options = {"path": journal, "start": start, "eventsPerBatch": most_events, "positions": json.dumps(positions or {})}
    stream = spark.readStream.format("lodestone_journal").options(**options).load()
    add = lambda batch, _: apply_batch(batch.sparkSession, path, journal_events(batch))
    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def keep_replaying(spark: SparkSession, source: str, path: str, checkpoint: str, most_failures: int = 8, pause: float = 0.5) -> int:
    """Runs `replay` to its end, again after a failure; most_failures in a row without a new version of the state raise the last one. Returns how often it failed."""
    failures = in_row = 0
    while True:
        before = (load_manifest(spark, path) or (0,))[0]
        try:
            replay(spark, source, path, checkpoint).awaitTermination()
            return failures
        except StreamingQueryException:
            failures += 1
            in_row = 1 if (load_manifest(spark, path) or (0,))[0] > before else in_row + 1
            if in_row >= most_failures:
                raise
            time.sleep(pause)


def is_stale(progress: dict | None, now: datetime, after: float = 60.0) -> bool:
    """Whether a query's last progress (its lastProgress) is older than `after` seconds; without any it is."""
    if not progress:
        return True
    return (now - datetime.fromisoformat(progress["timestamp"].replace("Z", "+00:00"))).total_seconds() > after
