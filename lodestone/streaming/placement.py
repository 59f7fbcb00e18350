"""Depth, flags and paths of entries kept under change: a batch restamps what it names and the subtrees of directories that it changes.

Besides the change state there are three tables of the same log structure. closure has (ancestor, descendant) of directories, a
directory with itself and with an ancestor that isn't there, too; dirs has each directory's parent, name and ancestors; placed has the
stamped entries by their parent. A batch finds the directories under those that it names in closure, their present
ancestors in dirs and their entries in placed, each by key. Chains are built anew for these directories and their ancestors
alone, by the same doubling that a whole build uses, so both give the same.

The batch reaches the change state last: after a crash it comes again, finds what the state was and writes the same rows once more.
One writer at a time places batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.names import JUNK_DIRS, USER_DIRS
from lodestone.operators.hierarchy import directory_chains, stamped
from lodestone.streaming.changes import changes, from_scan, live
from lodestone.streaming.log_state import Shape, add_run, begin, latest, load_manifest, lookup, state_of

DIRS = Shape({"drive": "string", "file_ref": "long"}, {"parent_ref": "long", "name": "string", "above": "array<bigint>"})
CLOSURE = Shape({"drive": "string", "ancestor": "long", "descendant": "long"}, {})
PLACED = Shape({"drive": "string", "parent_ref": "long", "file_ref": "long"}, {"name": "string", "name_lower": "string", "is_dir": "boolean", "ext": "string", "depth": "int", "user_path": "int", "is_junk": "boolean", "path": "string"})
SCANNED = ["drive", "file_ref", "parent_ref", "name", "is_dir"]


def _with_seq(rows: DataFrame, seq: int, gone: bool = False) -> DataFrame:
    return rows.withColumns({"seq": F.lit(seq).cast("long"), "gone": F.lit(gone)})


def _dirs(chains: DataFrame, records: DataFrame) -> DataFrame:
    """Rows of dirs for the directories of both."""
    return chains.select("drive", "file_ref", F.array_distinct("above").alias("above")).join(records.select("drive", "file_ref", "parent_ref", "name"), ["drive", "file_ref"])


def _pairs(dirs: DataFrame) -> DataFrame:
    """Rows of closure for rows of dirs."""
    return dirs.select("drive", F.explode(F.array_union("above", F.array("file_ref"))).alias("ancestor"), F.col("file_ref").alias("descendant"))


def begin_placed(spark: SparkSession, path: str, records: DataFrame, positions: dict[str, int], roots: DataFrame | None = None, junk_dirs=JUNK_DIRS, user_dirs=USER_DIRS) -> None:
    """The tables of a full scan (SCAN, each key once) that began at the drives' positions; rows without drive, ref or parent go."""
    records = records.select(*SCANNED).dropna(subset=["drive", "file_ref", "parent_ref"])
    chains = directory_chains(records, junk_dirs, user_dirs, with_above=True)
    dirs = _dirs(chains, records.where("is_dir"))
    begin(spark, f"{path}/dirs", _with_seq(dirs, 0), {}, DIRS)
    begin(spark, f"{path}/closure", _with_seq(_pairs(dirs), 0), {}, CLOSURE)
    begin(spark, f"{path}/placed", _with_seq(stamped(records, chains.drop("above"), roots, user_dirs), 0), {}, PLACED)
    begin(spark, f"{path}/state", from_scan(records), positions)


def placed_entries(spark: SparkSession, path: str) -> DataFrame | None:
    """Entries as `with_ancestry` gives them for the live state; None before a first scan or batch."""
    found = load_manifest(spark, f"{path}/placed")
    return None if found is None else state_of(spark, f"{path}/placed", found[1], PLACED).where("not gone").drop("seq", "gone")


def place_batch(spark: SparkSession, path: str, batch: DataFrame, roots: DataFrame | None = None, junk_dirs=JUNK_DIRS, user_dirs=USER_DIRS) -> dict[str, int]:
    """Adds a batch of events to the state and restamps what it moves. Returns how many rows each table got; an empty first state is fine.

    Events without drive or ref are left out, and so are creations and moves without a parent.
    """
    held: list[DataFrame] = []

    def kept(frame: DataFrame) -> DataFrame:
        held.append(frame.persist())
        return held[-1]

    try:
        found = batch.groupBy("drive").agg(F.max("seq").alias("seq"), F.count("*").alias("n")).collect()  # a row for each drive
        positions = {r["drive"]: r["seq"] for r in found if r["drive"] is not None and r["seq"] is not None}
        rows = kept(latest(changes(batch).dropna(subset=["drive", "file_ref"]).where("gone or parent_ref is not null")))
        key = ["drive", "file_ref"]
        before = kept(lookup(spark, f"{path}/state", rows.select(*key), whole=True))
        after = kept(latest(before.unionByName(rows)))
        number = (load_manifest(spark, f"{path}/state") or (0,))[0] + 1

        # directories whose chains change: those named, and what is under them
        named = after.select("drive", F.col("file_ref").alias("ancestor"))
        under = lookup(spark, f"{path}/closure", named, CLOSURE).select("drive", F.col("descendant").alias("file_ref"))
        own = live(after).where("is_dir").select("drive", "file_ref", "parent_ref", "name")
        affected = kept(under.unionByName(own.select(*key)).distinct())
        old_dirs = kept(lookup(spark, f"{path}/dirs", affected, DIRS))
        moved = kept(own.unionByName(old_dirs.join(after, key, "left_anti").select("drive", "file_ref", "parent_ref", "name")))

        # their ancestors, as far as they aren't affected themselves
        parents = live(after).select("drive", F.col("parent_ref").alias("file_ref")).distinct()
        near = lookup(spark, f"{path}/dirs", parents, DIRS)
        ancestors = near.select("drive", F.explode("above").alias("file_ref")).unionByName(parents).distinct().join(affected, key, "left_anti")
        context = lookup(spark, f"{path}/dirs", ancestors, DIRS).select("drive", "file_ref", "parent_ref", "name")
        chains = directory_chains(moved.unionByName(context).withColumn("is_dir", F.lit(True)), junk_dirs, user_dirs, with_above=True)

        new_dirs = kept(_dirs(chains, moved))
        gone_dirs = old_dirs.join(new_dirs, key, "left_anti")
        pairs, old_pairs = _pairs(new_dirs), _pairs(old_dirs)
        gone_pairs = old_pairs.join(pairs, list(CLOSURE.key), "left_anti")

        # entries: those named and those in an affected directory
        inside = lookup(spark, f"{path}/placed", affected.withColumnRenamed("file_ref", "parent_ref"), PLACED).select(*SCANNED).join(after, key, "left_anti")
        entries = stamped(live(after).unionByName(inside), chains.drop("above"), roots, user_dirs)
        was = live(before).join(live(after).select(*key, F.col("parent_ref").alias("now")), key, "left").where("now is null or now <> parent_ref")
        gone_entries = was.select("drive", "parent_ref", "file_ref", *[F.lit(None).cast(t).alias(c) for c, t in PLACED.record.items()])

        counts = {}
        for name, shape, put, drop in (("dirs", DIRS, new_dirs, gone_dirs), ("closure", CLOSURE, pairs, gone_pairs), ("placed", PLACED, entries, gone_entries)):
            delta = kept(_with_seq(put, number).unionByName(_with_seq(drop, number, gone=True)))
            counts[name] = delta.count()
            if counts[name]:
                add_run(spark, f"{path}/{name}", delta, {}, 0, shape, counts[name], {drive: number for drive in positions})
        add_run(spark, f"{path}/state", rows, positions, sum(r["n"] for r in found))
        return counts
    finally:
        for frame in held:
            frame.unpersist()
