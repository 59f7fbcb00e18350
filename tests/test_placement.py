"""Incremental depth, flags and paths: equal to a whole build after random batches, and as much work as a subtree has."""

import os
import random

from lodestone.operators.hierarchy import with_ancestry
from lodestone.sources import tables
from lodestone.streaming import changes, log_state, placement

JUNK, USER = ("temp", "bin"), ("users",)
OPTIONS = {"junk_dirs": JUNK, "user_dirs": USER}


def event(seq, op, ref, name="n", parent=0, is_dir=False, old=None, drive="C"):
    return (drive, seq, op, ref, old, parent, name, is_dir)


def rows_of(frame):
    return sorted((r["drive"], r["file_ref"], r["parent_ref"], r["name"], r["name_lower"], r["is_dir"], r["ext"] or "", r["depth"], r["user_path"], r["is_junk"], r["path"]) for r in frame.collect())


def whole(spark, path, roots=None):
    return rows_of(with_ancestry(changes.live(log_state.load_state(spark, f"{path}/state")[0]), roots, **OPTIONS))


def random_batch(rng, seq, refs=30):
    batch = []
    for _ in range(rng.randint(1, 5)):
        seq += 1
        drive, ref, op = rng.choice("CD"), rng.randint(1, refs), rng.choice(["created", "created", "moved", "moved", "deleted", "renamed"])
        name = rng.choice(["temp", "users", "a", "b.c", "bin", "x", "y.txt"])
        # parents are mostly smaller refs; some aren't there, and some make cycles
        parent = rng.randint(0, refs) if rng.random() < 0.15 else rng.randint(0, ref - 1)
        batch.append(event(seq, op, ref, name, parent, rng.random() < 0.7, rng.randint(1, refs) if op == "renamed" else None, drive))
    return batch, seq


def test_random_batches(spark, tmp_path, monkeypatch):
    """PLACEMENT_BATCHES sets their number; after each third one all columns of all entries are compared."""
    for name, value in (("LEVEL0_RUNS", 3), ("PART_ROWS", 15), ("LEVEL1_ROWS", 40), ("GROWTH", 3)):
        monkeypatch.setattr(log_state, name, value)
    path, rng, seq = f"file://{tmp_path}/tree", random.Random(int(os.environ.get("PLACEMENT_SEED", 5))), 100
    roots = spark.createDataFrame([("D", "D:\\")], "drive string, root string")
    scan = [("C", k, rng.randint(0, k - 1), rng.choice(["temp", "users", "d", "e.f"]), rng.random() < 0.7) for k in range(1, 25)]
    assert placement.placed_entries(spark, path) is None
    placement.begin_placed(spark, path, spark.createDataFrame(scan, tables.SCAN), {"C": 100}, roots, **OPTIONS)
    assert rows_of(placement.placed_entries(spark, path)) == whole(spark, path, roots)
    n = int(os.environ.get("PLACEMENT_BATCHES", 4))
    for k in range(n):
        batch, seq = random_batch(rng, seq)
        for _ in range(1 + (k % 5 == 4)):  # some come again
            placement.place_batch(spark, path, spark.createDataFrame(batch, tables.EVENTS), roots, **OPTIONS)
        if k % 3 == 2 or k == n - 1:
            assert rows_of(placement.placed_entries(spark, path)) == whole(spark, path, roots), k


def test_from_nothing_and_odd_events(spark, tmp_path):
    path = f"file://{tmp_path}/tree"
    make = lambda *rows: spark.createDataFrame(rows, tables.EVENTS)
    # a file before its folders, folders from the bottom up
    placement.place_batch(spark, path, make(event(1, "created", 9, "f.txt", 8)), **OPTIONS)
    placement.place_batch(spark, path, make(event(2, "created", 8, "bin", 7, True), event(3, "checkpoint", 0)), **OPTIONS)
    placement.place_batch(spark, path, make(event(4, "created", 7, "Users", 0, True), event(5, "created", None), event(6, "created", 5, "x", None), (None, 7, "created", 1, None, 0, "x", False)), **OPTIONS)
    assert [(r[1], r[7], r[8], r[9], r[10]) for r in rows_of(placement.placed_entries(spark, path))] == [(7, 1, 1, False, "C:\\Users"), (8, 1, 1, False, "C:\\Users\\bin"), (9, 2, 1, True, "C:\\Users\\bin\\f.txt")]
    # a folder becomes a file, its entries are at the root; a late event changes nothing
    placement.place_batch(spark, path, make(event(9, "moved", 8, "bin", 7, False), event(1, "deleted", 7)), **OPTIONS)
    assert rows_of(placement.placed_entries(spark, path)) == whole(spark, path)
    assert placement.place_batch(spark, path, make(), **OPTIONS) == {"dirs": 0, "closure": 0, "placed": 0}


def test_crash_between_tables(spark, tmp_path, monkeypatch):
    """A batch that fails after any of its tables comes again and gives the same."""
    import pytest

    path = f"file://{tmp_path}/tree"
    scan = [("C", 1, 0, "a", True), ("C", 2, 1, "b", True), ("C", 3, 2, "f", False), ("C", 4, 0, "temp", True)]
    placement.begin_placed(spark, path, spark.createDataFrame(scan, tables.SCAN), {"C": 0}, **OPTIONS)
    add = placement.add_run
    for fail, batch in enumerate(([event(1, "moved", 2, "b", 4, True)], [event(2, "moved", 1, "aa", 2, True), event(3, "created", 6, "g", 1)], [event(4, "deleted", 1), event(5, "moved", 2, "b2", 0, True)])):
        left = [fail + 1]

        def failing(*args, left=left):
            left[0] -= 1
            if left[0] < 0:
                raise RuntimeError("lost")
            return add(*args)

        monkeypatch.setattr(placement, "add_run", failing)
        with pytest.raises(RuntimeError):
            placement.place_batch(spark, path, spark.createDataFrame(batch, tables.EVENTS), **OPTIONS)
        monkeypatch.setattr(placement, "add_run", add)
        placement.place_batch(spark, path, spark.createDataFrame(batch, tables.EVENTS), **OPTIONS)
        assert rows_of(placement.placed_entries(spark, path)) == whole(spark, path), fail


def test_work_is_the_subtrees(spark, tmp_path):
    """Of 20,000 entries a moved file restamps one, a moved folder what is under it."""
    path = f"file://{tmp_path}/tree"
    dirs = spark.range(1, 201).selectExpr("'C' as drive", "id as file_ref", "id div 10 as parent_ref", "concat('d', id) as name", "true as is_dir")
    files = spark.range(1000, 21_000).selectExpr("'C' as drive", "id as file_ref", "1 + id % 200 as parent_ref", "concat('f', id) as name", "false as is_dir")
    placement.begin_placed(spark, path, dirs.unionByName(files), {"C": 0}, **OPTIONS)
    one = placement.place_batch(spark, path, spark.createDataFrame([event(1, "moved", 1500, "g", 7)], tables.EVENTS), **OPTIONS)
    assert one == {"dirs": 0, "closure": 0, "placed": 2}  # the new row and the old place
    # folder 15 has folders 150 to 159 and each of these 100 files
    sub = placement.place_batch(spark, path, spark.createDataFrame([event(2, "moved", 15, "bin", 3, True)], tables.EVENTS), **OPTIONS)
    assert sub["dirs"] == 11 and sub["placed"] == 11 * 100 + 11 + 1 and sub["closure"] < 11 * 5
    assert rows_of(placement.placed_entries(spark, path)) == whole(spark, path)
