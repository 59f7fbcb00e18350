"""The journal as a stream with positions, and the walker of a directory tree."""

import json
import os
import random

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from lodestone.sources import external
from lodestone.streaming import changes, log_state


def record(seq, ref, reason, name="n", parent=0):
    return {"seq": seq, "file_ref": ref, "parent_ref": parent, "name": name, "is_dir": False, "reason": reason}


def segment(folder, drive, journal, first, until, records):
    place = folder / drive / str(journal)
    place.mkdir(parents=True, exist_ok=True)
    (place / "new").write_text("".join(json.dumps(r) + "\n" for r in records))
    (place / "new").rename(place / f"{first}-{until}.jsonl")


def states(spark, path):
    state, _ = log_state.load_state(spark, path)
    return {(r["drive"], r["file_ref"], r["seq"], r["gone"], r["name"]) for r in state.collect()}


def drained(spark, journal, path, offsets, **options):
    query = changes.replay_journal(spark, f"file://{journal}", path, offsets, every="0 seconds", **options)
    try:
        query.processAllAvailable()
        return [p for p in query.recentProgress if p["numInputRows"]]
    finally:
        query.stop()


def test_journal_stream(spark, tmp_path):
    """Batches within their bound, a restart from the stream's own offsets, and the same state as in one batch."""
    rng, journal, path = random.Random(3), tmp_path / "journal", f"file://{tmp_path}/state"
    kinds = [changes.CREATE, changes.DELETE, changes.RENAMED, changes.RENAMED_FROM]
    # positions jump, as those of a real journal do
    make = lambda first, n: [record(first + 8 * k, rng.randrange(20), rng.choice(kinds), f"n{first + k}") for k in range(n)]
    rows = {"C": make(100, 30), "D": make(500, 11)}
    segment(journal, "C", 7, 100, 220, rows["C"][:15])
    segment(journal, "C", 7, 220, 340, rows["C"][15:])
    segment(journal, "D", 9, 500, 600, rows["D"])
    progress = drained(spark, journal, path, f"file://{tmp_path}/offsets", start="first", most_events=8)
    assert sum(p["numInputRows"] for p in progress) == 41 and max(p["numInputRows"] for p in progress) <= 8 and len(progress) >= 6
    assert "7:340" in str(progress[-1]["sources"][0]["endOffset"]) and "9:600" in str(progress[-1]["sources"][0]["endOffset"])
    more = make(340, 9)
    segment(journal, "C", 7, 340, 420, more)
    (journal / "C" / "7" / "100-220.jsonl").unlink()  # the journal forgets what the stream has read
    again = drained(spark, journal, path, f"file://{tmp_path}/offsets", most_events=8)
    assert sum(p["numInputRows"] for p in again) == 9
    whole = [(d, 7 if d == "C" else 9, r["seq"], r["file_ref"], r["parent_ref"], r["name"], r["is_dir"], r["reason"]) for d, own in (("C", rows["C"] + more), ("D", rows["D"])) for r in own]
    other = f"file://{tmp_path}/other"
    changes.apply_batch(spark, other, changes.journal_events(spark.createDataFrame(whole, external.JOURNAL)))
    assert states(spark, path) == states(spark, other)
    # the batch reader has what is left, a partition for each segment
    external.register(spark)
    left = spark.read.format("lodestone_journal").load(f"file://{journal}")
    assert left.rdd.getNumPartitions() == 3 and left.count() == 35
    assert left.where("drive = 'D'").rdd.getNumPartitions() == 1 and left.where("drive = 'D'").count() == 11
    assert spark.read.format("lodestone_journal").load(f"file://{tmp_path}/none").count() == 0


def test_journal_needs_a_rescan(spark, tmp_path):
    """A foreign journal, a position before or after the journal, and a gap are errors; a start at the end has no old events."""
    journal = tmp_path / "journal"
    segment(journal, "C", 7, 100, 200, [record(100 + k, k, changes.CREATE) for k in range(20)])
    start = lambda name, **options: drained(spark, journal, f"file://{tmp_path}/{name}", f"file://{tmp_path}/{name}-offsets", **options)
    assert start("end") == []
    assert sum(p["numInputRows"] for p in start("saved", positions={"C": (7, 115)})) == 5
    for name, positions in (("foreign", {"C": (6, 150)}), ("before", {"C": (7, 99)}), ("after", {"C": (7, 201)}), ("unknown", {"X": (1, 1)})):
        with pytest.raises(StreamingQueryException, match="RescanNeeded"):
            start(name, positions=positions)
    segment(journal, "C", 7, 210, 220, [])
    with pytest.raises(StreamingQueryException, match="nothing from 200 to 210"):
        start("gap")
    # a new journal while the stream was stopped
    (journal / "C" / "7" / "210-220.jsonl").unlink()
    segment(journal, "C", 8, 0, 10, [record(1, 1, changes.CREATE)])
    with pytest.raises(StreamingQueryException, match="isn't 7 any more"):
        start("saved")


def test_a_begun_batch_is_read_again(tmp_path):
    journal = tmp_path / "journal"
    segment(journal, "C", 7, 0, 50, [record(5 * k, k, changes.CREATE) for k in range(10)])
    segment(journal, "D", 1, 0, 9, [record(k, k, changes.CREATE) for k in range(9)])
    reader = external.JournalStream({"path": str(journal), "eventsPerBatch": "7"})
    assert reader.initialOffset() == {"C": "7:50", "D": "1:9"}
    at, seen = {"C": "7:0"}, []
    for _ in range(5):
        rows, end = reader.read(at)
        rows = list(rows)
        assert list(reader.readBetweenOffsets(at, end)) == rows and len(rows) <= 7
        seen, at = seen + rows, end
    assert len(seen) == 19 and at == {"C": "7:50", "D": "1:9"} and len(set(seen)) == 19
    with pytest.raises(ValueError):
        external.JournalStream({"path": "x", "start": "middle"})


def test_tree(spark, tmp_path):
    external.register(spark)
    rng = random.Random(4)
    for k in range(60):
        place = tmp_path / "t" / "/".join(rng.choice("abc") for _ in range(rng.randint(1, 4)))
        place.mkdir(parents=True, exist_ok=True)
        (place / f"é{k}.txt").write_text("x" * k)
    (tmp_path / "t" / "empty").mkdir()
    expected = set()
    for folder, dirs, files in os.walk(tmp_path / "t"):
        for name in dirs + files:
            path = os.path.join(folder, name)
            inside = path.removeprefix(str(tmp_path / "t"))
            expected.add((inside, name, name in dirs, inside.count("/"), None if name in dirs else os.path.getsize(path), int(os.path.getmtime(path))))
    load = lambda n: spark.read.format("lodestone_tree").option("partitions", n).load(f"file://{tmp_path}/t")
    rows = lambda frame: {(r["path"], r["name"], r["is_dir"], r["depth"], r["length"], r["s"]) for r in frame.withColumn("s", F.unix_timestamp("modified")).collect()}
    for n in (1, 4, 500):
        assert rows(load(n)) == expected and load(n).count() == len(expected)
    assert load(8).rdd.getNumPartitions() > 1
    for condition, keep in (("path like '/a/b%'", lambda r: r[0].startswith("/a/b")), ("depth <= 2", lambda r: r[3] <= 2), ("depth < 2 and startswith(path, '/b')", lambda r: r[3] < 2 and r[0].startswith("/b")), ("path = '/a'", lambda r: r[0] == "/a"), ("startswith(path, '/nothing')", lambda r: False)):
        assert rows(load(4).where(condition)) == {r for r in expected if keep(r)}, condition
    # what a condition leaves out isn't listed
    reader = external.TreeReader({"path": str(tmp_path / "t"), "partitions": "3"})
    list(reader.pushFilters([external.StringStartsWith(("path",), "/a/"), external.LessThanOrEqual(("depth",), 2)]))
    listed = [r for p in reader.partitions() for batch in reader.read(p) for r in batch.column("path").to_pylist()]
    assert listed and all(p.startswith("/a/") and p.count("/") <= 2 for p in listed)
    assert {f for p in reader.partitions() for f, _ in p.folders} <= {str(tmp_path / "t"), *(str(tmp_path / "t" / "a" / x) for x in ("", "a", "b", "c")), str(tmp_path / "t" / "a")}
    assert load(4).where("depth <= 1").select("name").count() == sum(r[3] == 1 for r in expected)
    assert spark.read.format("lodestone_tree").load(f"file://{tmp_path}/none").count() == 0
