"""What an entry inherits along its chain of parents: depth, user and junk flags, path.

Only directories are walked, by pointer doubling: each round a directory's pointer skips to where its
pointer's pointer points, and what lies between is combined. 6 rounds cover 64 levels; a cycle ends with
them. Then one join brings each entry its parent's values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.names import JUNK_DIRS, USER_DIRS, extension
from lodestone.sources.tables import BROADCAST_ROWS, drop_stored, stored_counting

FLAG_ROUNDS, PATH_ROUNDS = 5, 6
DEEPEST = 15
SEPARATOR = "\\"


def directory_chains(records: DataFrame, junk_dirs=JUNK_DIRS, user_dirs=USER_DIRS, junk_refs: DataFrame | None = None, with_above: bool = False) -> DataFrame:
    """(drive, file_ref, levels, junk, user, prefix) of each directory, for what is in it: counted ancestors, flags, path with a separator at the end.

    with_above: also above, the refs of its ancestors from its parent on, the last one there or not.
    """
    dirs = records.where("is_dir").select("drive", "file_ref", "parent_ref", "name", F.lower("name").alias("lower"))
    top = (F.col("parent_ref") == F.col("file_ref")) | (F.col("parent_ref") == 0)
    junk = F.col("lower").isin(*junk_dirs)
    if junk_refs is not None:
        marked = junk_refs.select("drive", "file_ref", F.lit(True).alias("marked")).distinct()
        dirs = dirs.join(marked, ["drive", "file_ref"], "left")
        junk = junk | F.coalesce("marked", F.lit(False))
    state = dirs.select(
        "drive",
        "file_ref",
        F.when(~top, F.col("parent_ref")).alias("up"),
        F.when(top, 0).otherwise(1).alias("levels"),
        junk.alias("junk"),
        F.col("lower").isin(*user_dirs).alias("user"),
        F.when(F.col("parent_ref") == F.col("file_ref"), "").otherwise(F.concat("name", F.lit(SEPARATOR))).alias("prefix"),
        *([F.when(top, F.array().cast("array<bigint>")).otherwise(F.array("parent_ref")).alias("above")] if with_above else []),
    )
    carried = [c for c in ("levels", "junk", "user", "prefix", "above") if c in state.columns]
    for k in range(PATH_ROUNDS + 1):
        # the write counts rows and open pointers, so a round is one job
        state, seen = stored_counting(state, f"chains-{k}", open=F.count_if(F.col("up").isNotNull()))
        if k:
            drop_stored(before)
        # the many entries that ask for chains pass by, unsorted; of the chains each task holds its share
        small = F.broadcast if seen.get("rows", 0) <= BROADCAST_ROWS else lambda frame: frame.hint("shuffle_hash")
        if k == PATH_ROUNDS or not seen.get("open", 0):
            break
        before = state
        # directories whose chain has ended aren't joined: without a pointer all of them would be one task's
        going = state.where("up is not null")
        above, near = state, F.broadcast
        if seen.get("rows", 0) > BROADCAST_ROWS:
            asked = going.select("drive", F.col("up").alias("file_ref")).distinct()
            if asked.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
                near = lambda frame: frame
            above = state.join(near(asked), ["drive", "file_ref"], "left_semi")
        above = above.select("drive", F.col("file_ref").alias("up"), *[F.col(c).alias(f"{c}_up") for c in carried], F.col("up").alias("next"))
        joined = going.join(near(above), ["drive", "up"], "left")
        flags = k < FLAG_ROUNDS
        moved = joined.select(
            "drive",
            "file_ref",
            F.col("next").alias("up"),
            (F.col("levels") + F.coalesce("levels_up", F.lit(0)) if flags else F.col("levels")).alias("levels"),
            (F.col("junk") | F.coalesce("junk_up", F.lit(False)) if flags else F.col("junk")).alias("junk"),
            (F.col("user") | F.coalesce("user_up", F.lit(False)) if flags else F.col("user")).alias("user"),
            F.concat(F.coalesce("prefix_up", F.lit("")), "prefix").alias("prefix"),
            *([F.concat("above", F.coalesce("above_up", F.array().cast("array<bigint>"))).alias("above")] if with_above else []),
        )
        state = state.where("up is null").unionByName(moved)
    return small(state.drop("up"))


def with_names(records: DataFrame) -> DataFrame:
    """records with what their own names say: name_lower and ext; nothing is walked."""
    lower = F.lower("name")
    return records.withColumns({"name_lower": lower, "ext": extension(lower, F.col("is_dir"))})


def with_ancestry(records: DataFrame, roots: DataFrame | None = None, junk_dirs=JUNK_DIRS, user_dirs=USER_DIRS, junk_refs: DataFrame | None = None) -> DataFrame:
    """records (SCAN) with name_lower, ext, depth (1 to 15), user_path (0 or 1), is_junk and path.

    An entry in a junk directory at any level is junk, the directory itself isn't. A user directory
    itself and what is in it has user_path 1. Ancestors without a parent of their own aren't counted.
    roots (drive, root): where a drive's paths begin, C:\\ if not named. Rows whose parent is missing
    are at the root.
    """
    return stamped(records, directory_chains(records, junk_dirs, user_dirs, junk_refs), roots, user_dirs)


def stamped(records: DataFrame, chains: DataFrame, roots: DataFrame | None = None, user_dirs=USER_DIRS) -> DataFrame:
    """records with what they inherit from the chains of their directories, as `with_ancestry` gives it."""
    chains = chains.withColumnRenamed("file_ref", "parent_ref")
    lower = F.lower("name")
    joined = records.join(chains, ["drive", "parent_ref"], "left")
    own_root = F.col("parent_ref") == F.col("file_ref")
    out = joined.select(
        "drive",
        "file_ref",
        "parent_ref",
        "name",
        lower.alias("name_lower"),
        "is_dir",
        extension(lower, F.col("is_dir")).alias("ext"),
        F.least(F.lit(DEEPEST), F.coalesce(F.when(~own_root, F.col("levels")), F.lit(0)) + 1).cast("int").alias("depth"),
        (F.coalesce("user", F.lit(False)) | (F.col("is_dir") & lower.isin(*user_dirs))).cast("int").alias("user_path"),
        F.coalesce(F.when(~own_root, F.col("junk")), F.lit(False)).alias("is_junk"),
        F.concat(F.coalesce("prefix", F.lit("")), F.when(own_root, "").otherwise(F.col("name"))).alias("path"),
    )
    if roots is None:
        return out.withColumn("path", F.concat(F.lit("C:\\"), "path"))
    rooted = out.join(F.broadcast(roots.select("drive", "root")), "drive", "left")  # a row for each drive
    return rooted.withColumn("path", F.concat(F.coalesce("root", F.lit("C:\\")), "path")).drop("root")


def prune(records: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """(entries, junk_refs): what lies in junk directories goes, and is remembered by its ref."""
    whole = with_ancestry(records, **options)
    return whole.where("not is_junk").drop("is_junk"), whole.where("is_junk").select("drive", "file_ref")
