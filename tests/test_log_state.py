"""Log-structured change state and optimistic commits: against a dictionary, under many small batches, with several writers."""

import random
import threading
import time

import pytest

from lodestone.sources import tables, versions
from lodestone.streaming import changes, log_state
from pyspark.sql import functions as F


def event(seq, op, ref, name="n", parent=0, old=None, drive="C"):
    return (drive, seq, op, ref, old, parent, name, False)


def batch_of(spark, rows):
    return spark.createDataFrame(rows, tables.EVENTS)


def live_of(spark, path):
    state, _ = log_state.load_state(spark, path)
    return {(r["drive"], r["file_ref"]): (r["parent_ref"], r["name"]) for r in changes.live(state).collect()}


def bytes_under(folder):
    return sum(f.stat().st_size for f in folder.rglob("*") if f.is_file())


@pytest.fixture
def small(monkeypatch):
    for name, value in (("LEVEL0_RUNS", 2), ("PART_ROWS", 10), ("LEVEL1_ROWS", 20), ("GROWTH", 2), ("KEPT", 3)):
        monkeypatch.setattr(log_state, name, value)


def test_state_equals_a_dictionary(spark, tmp_path, small):
    """Random batches, some again and late, over many merges and levels; tombstones go, and a later event finds none."""
    path, rng, seq = f"file://{tmp_path}/state", random.Random(2), 0
    model: dict = {}
    last: dict = {}
    before = []
    for step in range(26):
        batch = []
        for _ in range(rng.randint(1, 14)):
            seq += 1
            drive, ref = rng.choice("CD"), rng.randint(1, 90)
            op = rng.choice(["created", "created", "moved", "deleted", "renamed"])
            old = rng.randint(1, 90) if op == "renamed" else None
            batch.append(event(seq, op, ref, f"n{seq}", rng.randint(0, 9), old, drive))
            for key in [(drive, old)] if old not in (None, ref) else []:
                last[key] = seq
                model.pop(key, None)
            last[drive, ref] = seq
            model.pop((drive, ref), None)
            if op != "deleted":
                model[drive, ref] = (batch[-1][5], batch[-1][6])
        rng.shuffle(batch)
        changes.apply_batch(spark, path, batch_of(spark, batch))
        if before and rng.random() < 0.3:
            changes.apply_batch(spark, path, batch_of(spark, before))  # comes again
        before = batch
        if step % 5 == 4:
            assert live_of(spark, path) == model
        if step % 6 == 5:
            log_state.mark_saved(spark, path, log_state.load_manifest(spark, path)[1])
    assert live_of(spark, path) == model
    version, manifest = log_state.load_manifest(spark, path)
    levels = log_state._levels(spark, path, manifest)
    assert len(levels) >= 3 and len(manifest["runs"]) < 2
    for own in levels:  # disjoint and in order
        assert all(a["high"] < b["low"] for a, b in zip(own, own[1:], strict=False))
    assert len(versions.versions(spark, f"{path}/_log")) <= log_state.KEPT
    state, checkpoints = log_state.load_state(spark, path)
    assert max(r["next_seq"] for r in checkpoints.collect()) == seq
    assert {(r["drive"], r["file_ref"]): r["seq"] for r in state.where("not gone").collect()} == {k: last[k] for k in model}
    # no file is left that neither the manifest nor its trash names
    named = {p["file"] for p in manifest["runs"]} | {p["file"] for own in levels for p in own} | {f for _, f in manifest["trash"]}
    there = {str(f.relative_to(tmp_path / "state")) for f in (tmp_path / "state" / "data").rglob("*.parquet")}
    assert {f for f in there if (tmp_path / "state" / f).stat().st_size} - named == {f for f in there - named if f.rpartition("/")[0] in {n.rpartition("/")[0] for n in named}}


def test_tombstones_go(spark, tmp_path, small):
    path = f"file://{tmp_path}/state"
    log_state.begin(spark, path, changes.from_scan(spark.range(1, 40).selectExpr("'C' as drive", "id as file_ref", "0L as parent_ref", "'n' as name", "false as is_dir")), {"C": 0})
    with pytest.raises(ValueError):
        log_state.begin(spark, path, spark.createDataFrame([], log_state.STATE), {})
    changes.apply_batch(spark, path, batch_of(spark, [event(k, "deleted", k) for k in range(1, 20)]))
    assert len(live_of(spark, path)) == 20
    for _ in range(2):
        log_state.mark_saved(spark, path, log_state.load_manifest(spark, path)[1])
    changes.apply_batch(spark, path, batch_of(spark, [event(50, "created", 3, "back"), event(51, "created", 60), (None, 52, "created", 1, None, 0, "x", False), event(53, "created", None)]))
    for k in range(8):
        changes.apply_batch(spark, path, batch_of(spark, [event(60 + k, "created", 70 + k)]))
    state, _ = log_state.load_state(spark, path)
    gone = {r["file_ref"] for r in state.where("gone").collect()}
    assert len(gone) < 19 and 3 not in gone and live_of(spark, path)["C", 3] == (0, "back") and len(live_of(spark, path)) == 30


def test_a_batch_writes_kilobytes(spark, tmp_path):
    """Whatever the size of the state; no file of the base is rewritten, and the manifest stays of one size."""
    folder, path = tmp_path / "state", f"file://{tmp_path}/state"
    scan = spark.range(400_000).selectExpr("'C' as drive", "id as file_ref", "id div 7 as parent_ref", "concat('name-', hash(id), '-', id) as name", "false as is_dir")
    log_state.begin(spark, path, changes.from_scan(scan), {"C": 0})
    base = {f: f.stat().st_mtime_ns for f in folder.rglob("*.parquet")}
    size, sizes = bytes_under(folder), []
    assert size > 3_000_000
    rng = random.Random(1)
    for k in range(6):
        changes.apply_batch(spark, path, batch_of(spark, [event(1 + 200 * k + j, "moved", rng.randrange(400_000), f"m{k}-{j}") for j in range(200)]))
        sizes.append(bytes_under(folder))
    grown = [b - a for a, b in zip([size, *sizes], sizes, strict=False)]
    assert max(grown) < 40_000 and all(f.stat().st_mtime_ns == t for f, t in base.items())
    plan = log_state.load_state(spark, path)[0]._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and plan.count("SortMergeJoin") == 0
    assert log_state.load_state(spark, path)[0].count() == 400_000


def test_versions_are_constant_and_none_is_lost(spark, tmp_path):
    """A thousand commits leave a few files; of eight writers at once none loses a change, and readers see whole documents in order."""
    log, seen = f"file://{tmp_path}/log", []
    for _ in range(1000 // 8):
        versions.commit(spark, log, lambda d: {"n": (d or {"n": 0})["n"] + 1}, 5)
    assert len(list((tmp_path / "log").iterdir())) == 5 and versions.newest(spark, log) == (125, {"n": 125})

    def write(k):
        for j in range(10):
            versions.commit(spark, log, lambda d: {"n": d["n"] + 1, "by": [*d.get("by", []), f"{k}-{j}"]}, 5)

    writers = [threading.Thread(target=write, args=(k,)) for k in range(8)]
    for t in writers:
        t.start()
    while any(t.is_alive() for t in writers):
        seen.append(versions.newest(spark, log))
        time.sleep(0.01)
    number, last = versions.newest(spark, log)
    assert (number, last["n"]) == (205, 205) and sorted(last["by"]) == sorted(f"{k}-{j}" for k in range(8) for j in range(10))
    assert all(v == d["n"] for v, d in seen) and [v for v, _ in seen] == sorted(v for v, _ in seen)
    assert versions.commit(spark, log, lambda d: None) is None and not versions.publish(spark, log, 205, {})


def test_versions_elsewhere(spark, tmp_path):
    """On a file system that isn't the local one a rename that doesn't overwrite names the version."""
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.here.link./in", f"file://{tmp_path}")
    log = "viewfs://here/in/log"
    spark._jvm.org.apache.hadoop.fs.Path(log).getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(spark._jvm.org.apache.hadoop.fs.Path(log))
    assert versions.publish(spark, log, 1, {"a": "é"}) and not versions.publish(spark, log, 1, {"a": 2})
    assert versions.newest(spark, log) == (1, {"a": "é"}) and versions.commit(spark, log, lambda d: d | {"b": 1}) == (2, {"a": "é", "b": 1})


def test_two_writers_at_once(spark, tmp_path, small):
    path = f"file://{tmp_path}/state"
    errors = []

    def write(k):
        try:
            for j in range(4):
                changes.apply_batch(spark, path, batch_of(spark, [event(100 * j + k, "created", 1000 * k + j), event(100 * j + k, "created", 7, f"w{k}")]))
        except Exception as error:  # shown by the test
            errors.append(error)

    writers = [threading.Thread(target=write, args=(k,)) for k in (1, 2)]
    for t in writers:
        t.start()
    for t in writers:
        t.join()
    assert not errors
    assert log_state.load_manifest(spark, path)[1]["batches"] == 8
    assert set(live_of(spark, path)) == {("C", 1000 * k + j) for k in (1, 2) for j in range(4)} | {("C", 7)} and live_of(spark, path)["C", 7] == (0, "w2")


def test_two_snapshots_at_once(spark, tmp_path):
    path = f"file://{tmp_path}/saved"
    saved = []
    writers = [threading.Thread(target=lambda k=k: saved.append(tables.save_snapshot({"t": spark.range(k)}, path))) for k in (3, 5)]
    for t in writers:
        t.start()
    for t in writers:
        t.join()
    assert sorted(saved) == [1, 2] and tables.load_snapshot(spark, path)["t"].count() in (3, 5)
    assert len(tables.drop_old_versions(spark, path, 1)) == 1 and tables.latest_version(spark, path) == 2


def test_save_is_due(spark, tmp_path):
    path, saved = f"file://{tmp_path}/state", f"file://{tmp_path}/saved"
    roots, junk = spark.createDataFrame([("C", "C:\\")], "drive string, root string"), spark.createDataFrame([], "drive string, file_ref long")
    changes.apply_batch(spark, path, batch_of(spark, [event(k, "created", k) for k in range(1, 31)]))
    manifest = log_state.load_manifest(spark, path)[1]
    at = manifest["saved_at"]
    assert [log_state.is_due(manifest, at + s, e, 30) for s, e in ((29, 30), (31, 30), (31, 31))] == [False, True, False]
    save = lambda **due: changes.save_if_due(spark, path, saved, roots, junk, **due)
    assert save() is None and save(events=30, seconds=0) == 1 and save(events=30, seconds=0) is None
    assert tables.load_snapshot(spark, saved)["entries"].agg(F.count("*")).first()[0] == 30
    assert log_state.load_manifest(spark, path)[1]["pending"] == 0
