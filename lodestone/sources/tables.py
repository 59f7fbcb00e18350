"""Schemas, stored intermediate tables, versioned snapshots and scan records."""

from __future__ import annotations

import hashlib
import tempfile
import time
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions.names import launchable
from lodestone.sources.versions import commit, delete, file_of, newest, read_json, versions

SNAPSHOT_FORMAT = 2
SCAN = "drive string, file_ref long, parent_ref long, name string, is_dir boolean"
EVENTS = "drive string, seq long, op string, file_ref long, old_ref long, parent_ref long, name string, is_dir boolean"
CHECKPOINTS = "drive string, journal_id long, next_seq long"
BROADCAST_ROWS = 200_000


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one where none is named and all of Spark runs in this process.

    On a cluster without that setting executors would each write to a disk of their own, so that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run has."""
    return f"{shared_folder(spark)}/lodestone-{uuid.uuid4().hex}/{name}"


def stored(frame: DataFrame, name: str) -> DataFrame:
    """The frame, written as a table to the shared folder and read again: later reads survive lost executors."""
    path = new_folder(frame.sparkSession, name)
    frame.write.option("compression", "zstd").parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def stored_counting(frame: DataFrame, name: str, **counts: Column) -> tuple[DataFrame, dict[str, int]]:
    """The frame as `stored` gives it, and aggregates of its rows that the write itself takes, so no further job does."""
    seen = Observation(f"{name}-{uuid.uuid4().hex}")
    table = stored(frame.observe(seen, F.count("*").alias("rows"), *[c.alias(k) for k, c in counts.items()]), name)
    return table, seen.get


def drop_stored(*frames: DataFrame) -> None:
    """Deletes the tables behind frames that `stored` gave, once nothing reads them any more."""
    for frame in frames:
        session, folders = frame.sparkSession, {f.rpartition("/")[0] for f in frame.inputFiles()}
        for folder in folders:
            if "/lodestone-" in folder:
                place = session._jvm.org.apache.hadoop.fs.Path(folder)
                place.getFileSystem(session._jsc.hadoopConfiguration()).delete(place, True)


def files_stamp(spark: SparkSession, paths: list[str]) -> str:
    """A hash of path, length and time of all files under the paths: another one as soon as a file is replaced. No content is read."""
    found = []
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = place.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(place, True)
        while files.hasNext():
            f = files.next()
            found.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()


def broadcast_if_small(frame: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marked for broadcast where its counted rows are within the bound; beyond it Spark joins by shuffles."""
    return F.broadcast(frame) if frame.limit(rows + 1).count() <= rows else frame


def spread(frame: DataFrame) -> DataFrame:
    """The rows over one partition for each core, if the scan has fewer: all rows of a small file are one task's else. A scan of more partitions stays as it is."""
    cores = frame.sparkSession.sparkContext.defaultParallelism
    return frame.repartition(cores) if frame.rdd.getNumPartitions() < cores else frame


def dealt(frame: DataFrame, *key: str) -> DataFrame:
    """The rows by key over a set number of partitions, for steps that sort all of a large table, whose keys have few rows each.

    Adaptive execution would merge partitions to one for each core, up to 64 MB of compressed rows, which are gigabytes once a task has unpacked and sorted them.
    """
    session = frame.sparkSession
    return frame.repartition(max(int(session.conf.get("spark.sql.shuffle.partitions")), 8 * session.sparkContext.defaultParallelism), *key)


def first_of_each(frame: DataFrame, key: list[str], order: list) -> DataFrame:
    """One row for each key, the first by order."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return frame.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def parsed_records(raw: DataFrame) -> DataFrame:
    """File records in use with their best name: raw has SCAN's columns, in_use and name_space (0 DOS alone, 1 Win32, 2 both, 3 POSIX)."""
    priority = F.when(F.col("name_space") == 1, 0).when(F.col("name_space") == 2, 1).otherwise(2)
    used = raw.where(F.col("in_use") & (F.col("name_space") != 0) & (F.coalesce("name", F.lit("")) != ""))
    return first_of_each(used.withColumn("_priority", priority), ["drive", "file_ref"], ["_priority", "name"]).drop("_priority", "in_use", "name_space")


def save_snapshot(tables: dict[str, DataFrame | Callable[[Callable[[str], DataFrame]], DataFrame]], path: str, keep_if_empty: str | None = None, options: dict[str, str] | None = None, notes: dict | None = None) -> int | None:
    """Writes the tables under path, then publishes them as the next version with one small file; readers see old or new. Returns the version.

    Each writer has a folder of its own, and of several at once each publishes a version of its own, in the order of their
    commits. A function instead of a table gives it from those before it, which it reads by name as they were written. keep_if_empty: a table without which nothing is published (None is returned). options: of the writer. notes: what is published with the version.
    """
    spark = next(iter(tables.values())).sparkSession
    folder = f"w{time.time_ns():020d}-{uuid.uuid4().hex}"
    rows = {}
    for name, frame in tables.items():
        if not isinstance(frame, DataFrame):
            frame = frame(lambda earlier: spark.read.parquet(f"{path}/{folder}/{earlier}"))
        seen = Observation(f"{name}-{folder}")
        frame.observe(seen, F.count("*").alias("rows")).write.options(**{"compression": "zstd", **(options or {})}).parquet(f"{path}/{folder}/{name}")
        rows[name] = seen.get.get("rows", 0)
        if name == keep_if_empty and not rows[name]:
            return None
    document = {"format": SNAPSHOT_FORMAT, "folder": folder, "tables": rows, "notes": notes or {}}
    return commit(spark, f"{path}/_versions", lambda _: document)[0]


def latest_version(spark: SparkSession, path: str) -> int | None:
    return max(versions(spark, f"{path}/_versions"), default=None)


def load_snapshot(spark: SparkSession, path: str) -> dict[str, DataFrame] | None:
    """The tables of the newest version; None if there is none or its format is another one, which asks for a rebuild."""
    found = newest(spark, f"{path}/_versions")
    if found is None or found[1]["format"] != SNAPSHOT_FORMAT:
        return None
    return {name: spark.read.parquet(f"{path}/{found[1]['folder']}/{name}") for name in sorted(found[1]["tables"])}


def snapshot_notes(spark: SparkSession, path: str) -> dict | None:
    """The notes of the newest version; None where `load_snapshot` gives None."""
    found = newest(spark, f"{path}/_versions")
    return found[1].get("notes", {}) if found and found[1]["format"] == SNAPSHOT_FORMAT else None


def set_fingerprint(rows: DataFrame, value: Column) -> str:
    """Two sums of hashes of a value and the number of rows: equal for the same values in any order, in one pass and one row to the driver.

    Two different multisets are taken for equal with a chance of about 2^-128. Nulls count as a value.
    """
    one = lambda salt: F.coalesce(F.sum(F.xxhash64(value, F.lit(salt)).cast("decimal(38, 0)")), F.lit(0))
    r = rows.agg(F.count("*").alias("n"), one(1).alias("a"), one(2).alias("b")).first()
    return f"{r['n']}:{int(r['a']) % (1 << 64):016x}{int(r['b']) % (1 << 64):016x}"


def drop_old_versions(spark: SparkSession, path: str, kept: int = 2) -> list[str]:
    """Deletes all but the newest `kept` versions and their folders; a reader of an older one has to load anew. Returns the folders."""
    log = f"{path}/_versions"
    dropped = []
    for version in versions(spark, log)[:-kept]:
        name = file_of(log, version)
        dropped.append(read_json(spark, name)["folder"])
        delete(spark, f"{path}/{dropped[-1]}", name)
    return dropped


def validate_snapshot(tables: dict[str, DataFrame]) -> DataFrame:
    """(check, ok) of a snapshot of entries with their roots: every check is an all or an any over one pass of its table.

    roots: there is one, and each has a drive and a path. entries: refs and names are there, a ref is one row of its
    drive, depths and flags are in range, every drive has a root.
    """
    entries, roots = tables["entries"], tables["roots"]
    sound = lambda rows: F.coalesce(F.bool_and(rows), F.lit(True))
    checks = [
        roots.agg((F.count("*") > 0).alias("roots_exist"), sound(F.col("drive").isNotNull() & (F.coalesce("root", F.lit("")) != "")).alias("roots_named")),
        entries.agg(sound(F.col("drive").isNotNull() & F.col("file_ref").isNotNull() & F.col("name").isNotNull()).alias("refs_and_names"), sound(F.col("depth").between(1, 15) & F.col("user_path").isin(0, 1)).alias("depths_in_range")),
        entries.groupBy("drive", "file_ref").agg(F.count("*").alias("n")).agg((F.coalesce(F.max("n"), F.lit(1)) == 1).alias("refs_once")),
        entries.select("drive").distinct().join(roots, "drive", "left_anti").agg((F.count("*") == 0).alias("drives_rooted")),
    ]
    rows = [c.select(F.inline(F.array(*[F.struct(F.lit(k).alias("check"), F.col(k).alias("ok")) for k in c.columns]))) for c in checks]
    return reduce(DataFrame.union, rows)


def read_exclusions(spark: SparkSession, path: str) -> DataFrame:
    """(prefix): the trimmed lower-case lines of a text file or folder; empty ones go."""
    return spark.read.text(path).select(F.lower(F.trim("value")).alias("prefix")).where("prefix <> ''")


def write_exclusions(prefixes: DataFrame, path: str) -> None:
    """One line for each prefix of (prefix); nulls are left out."""
    prefixes.select("prefix").where("prefix is not null").write.mode("overwrite").text(path)


def read_pool(spark: SparkSession, path: str) -> DataFrame:
    """(name, path) of an application pool in JSON, an array or lines; entries that may not be launched and broken lines go."""
    rows = spark.read.schema("name string, path string").option("mode", "DROPMALFORMED").option("multiLine", path.endswith(".json")).json(path)
    return rows.where(F.col("name").isNotNull() & launchable(F.col("path")))


def write_pool(apps: DataFrame, path: str) -> None:
    apps.select("name", "path").write.mode("overwrite").json(path)


def describe_snapshot(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n) of a snapshot."""
    counts = [frame.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n") for name, frame in tables.items()]
    out = counts[0]
    for frame in counts[1:]:
        out = out.union(frame)
    return out
