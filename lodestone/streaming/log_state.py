"""Change state as a log-structured tree: sorted runs of batches over levels of disjoint parts.

A batch writes one run of its own changes, whatever the size of the state. LEVEL0_RUNS runs are merged into level 1, and a level with
more rows than its share passes its oldest part to the next one, each time with those parts alone that the
keys overlap. Levels grow by GROWTH, so a change is rewritten a few times in all. A read takes the latest of each key over
runs and levels. A deletion leaves a tombstone, which goes in the deepest level once no event before it can come again.

The manifest of a version has the runs, the drives' positions and the name of the list of parts, which only
merges rewrite. It is published by optimistic commit: a batch that meets another writer's version adds its run to that one, a
merge whose inputs are gone drops what it wrote. Files of parts that a merge has replaced stay for KEPT versions, for readers.
"""

from __future__ import annotations

import time
import uuid
from bisect import bisect_left
from collections.abc import Iterable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.tables import BROADCAST_ROWS
from lodestone.sources.versions import commit, delete, newest, read_json, write_json



@dataclass(frozen=True)
class Shape:
    """Key and other columns of a table, with their types; the first one of the key is the drive. Each row has seq and gone besides."""

    key: dict[str, str]
    record: dict[str, str]

    @property
    def schema(self) -> str:
        return ", ".join(f"{c} {t}" for c, t in {**self.key, **self.record, "seq": "long", "gone": "boolean"}.items())


CHANGES = Shape({"drive": "string", "file_ref": "long"}, {"parent_ref": "long", "name": "string", "is_dir": "boolean"})
STATE, RECORD = CHANGES.schema, list(CHANGES.record)
#: Runs before they are merged, rows of a part, rows of level 1, and how much larger each level may be than the one before.
LEVEL0_RUNS, PART_ROWS, LEVEL1_ROWS, GROWTH = 8, 1_000_000, 2_000_000, 8
#: Keys that a lookup brings to the driver to choose parts.
LOOKED_UP = 10_000
#: Versions, and replaced files since then, that stay.
KEPT = 16
_EMPTY = {"positions": {}, "batches": 0, "pending": 0, "runs": [], "parts": None, "saved": {}, "saved_at": 0.0, "oldest": {}, "trash": []}


def latest(rows: DataFrame, shape: Shape = CHANGES) -> DataFrame:
    """The last change of each key; of one seq the deletion."""
    last = F.max_by(F.struct(*shape.record, "gone"), F.struct("seq", "gone")).alias("r")
    return rows.groupBy(*shape.key).agg(last, F.max("seq").alias("seq")).select(*shape.key, *[f"r.{c}" for c in shape.record], "seq", "r.gone")


def _log(path: str) -> str:
    return f"{path}/_log"


def _levels(spark: SparkSession, path: str, manifest: dict) -> list[list[dict]]:
    return read_json(spark, f"{path}/_parts/{manifest['parts']}.json")["levels"] if manifest["parts"] else []


def _write(spark: SparkSession, path: str, rows: DataFrame, most: int, shape: Shape) -> list[dict]:
    """Writes at most `most` rows sorted by key, in files of about PART_ROWS rows of disjoint keys, and returns what the manifest says of each."""
    folder = f"data/{uuid.uuid4().hex}"
    files = -(-most // PART_ROWS)
    # one file, too, is a shuffle of its own: coalesced, its task would do what all tasks of the step before do
    spread = rows.repartitionByRange(files, *shape.key) if files > 1 else rows.repartition(1)
    spread.select(*shape.key, *shape.record, "seq", "gone").sortWithinPartitions(*shape.key).write.option("compression", "zstd").parquet(f"{path}/{folder}")
    ends = [f(F.struct(*shape.key)).alias(end) for f, end in ((F.min, "low"), (F.max, "high"))]
    each = spark.read.schema(shape.schema).parquet(f"{path}/{folder}").groupBy(F.input_file_name().alias("file"), "drive").agg(*ends, F.count("*").alias("rows"), F.min("seq").alias("least"))
    parts: dict[str, dict] = {}
    for r in each.orderBy("file", "drive").collect():  # a row for each new file and drive in it
        name = f"{folder}/{r['file'].rpartition('/')[2]}"
        part = parts.setdefault(name, {"file": name, "low": list(r["low"]), "rows": 0, "least": {}})
        part["high"] = list(r["high"])
        part["rows"] += r["rows"]
        part["least"][r["drive"]] = r["least"]
    if not parts:
        delete(spark, f"{path}/{folder}")
    return sorted(parts.values(), key=lambda p: p["low"])


def _rows(spark: SparkSession, path: str, parts: Iterable[dict], shape: Shape) -> DataFrame:
    files = [f"{path}/{p['file']}" for p in parts]
    return spark.read.schema(shape.schema).parquet(*files) if files else spark.createDataFrame([], shape.schema)


def _meeting(parts: list[dict], others: list[dict]) -> list[dict]:
    """Those of the parts whose keys overlap with one of the others."""
    return [p for p in parts if any(p["low"] <= o["high"] and o["low"] <= p["high"] for o in others)]


def load_manifest(spark: SparkSession, path: str) -> tuple[int, dict] | None:
    return newest(spark, _log(path))


def state_of(spark: SparkSession, path: str, manifest: dict, shape: Shape = CHANGES) -> DataFrame:
    """All rows of a version, those that are gone included. Parts that nothing newer overlaps are read as they are; of the others only rows of changed keys are merged, if these are few."""
    levels = _levels(spark, path, manifest)
    newer = manifest["runs"] + [p for level in levels[:-1] for p in level]
    base = levels[-1] if levels else []
    touched = _meeting(base, newer)
    alone = [p for p in base if p not in touched]
    changed = _rows(spark, path, newer, shape)
    if not newer:
        return _rows(spark, path, base, shape)
    below = _rows(spark, path, touched, shape)
    if sum(p["rows"] for p in newer) <= BROADCAST_ROWS:
        keys = F.broadcast(changed.select(*shape.key).distinct())
        found = latest(changed.unionByName(below.join(keys, list(shape.key), "left_semi")), shape).unionByName(below.join(keys, list(shape.key), "left_anti"))
    else:
        found = latest(changed.unionByName(below), shape)
    return found.unionByName(_rows(spark, path, alone, shape)) if alone else found


def lookup(spark: SparkSession, path: str, keys: DataFrame, shape: Shape = CHANGES, whole: bool = False) -> DataFrame:
    """The rows that are there and whose key begins with one of `keys`, whose columns are the first of the shape's key; whole: those that are gone, too, with seq and gone.

    Up to LOOKED_UP keys come to the driver and choose the runs and parts that can hold them; more are joined with all.
    """
    found = load_manifest(spark, path)
    if found is None:
        none = spark.createDataFrame([], shape.schema)
        return none if whole else none.drop("seq", "gone")
    names = keys.columns
    pieces = found[1]["runs"] + [p for level in _levels(spark, path, found[1]) for p in level]
    asked = sorted({tuple(r) for r in keys.dropna().limit(LOOKED_UP + 1).collect()})
    if len(asked) <= LOOKED_UP:
        first = [list(k) for k in asked]
        pieces = [p for p in pieces if (at := bisect_left(first, p["low"][: len(names)])) < len(first) and first[at] <= p["high"][: len(names)]]
        kinds = {"string": pa.string(), "long": pa.int64()}
        columns = zip(*asked, strict=True) if asked else [[] for _ in names]
        keys = F.broadcast(spark.createDataFrame(pa.table({c: pa.array(x, kinds[shape.key[c]]) for c, x in zip(names, columns, strict=True)})))
    else:
        keys = keys.distinct()
    rows = latest(_rows(spark, path, pieces, shape).join(keys, names, "left_semi"), shape)
    return rows if whole else rows.where("not gone").drop("seq", "gone")


def load_state(spark: SparkSession, path: str, shape: Shape = CHANGES) -> tuple[DataFrame, DataFrame] | None:
    """(state, checkpoints: drive, next_seq) after the last batch; None before the first one."""
    last = load_manifest(spark, path)
    if last is None:
        return None
    return state_of(spark, path, last[1], shape), spark.createDataFrame(sorted(last[1]["positions"].items()), "drive string, next_seq long")


def begin(spark: SparkSession, path: str, state: DataFrame, positions: dict[str, int], shape: Shape = CHANGES) -> int:
    """A first version from a scan: its rows (each key once) are the deepest level. Returns the version; an error if there is one."""
    parts = _write(spark, path, state, max(1, state.count()), shape)
    name = uuid.uuid4().hex
    write_json(spark, f"{path}/_parts/{name}.json", {"levels": [parts]})

    def change(manifest):
        if manifest is not None:
            raise ValueError(f"{path} has a state")
        return _EMPTY | {"positions": dict(positions), "parts": name, "saved_at": time.time()}

    return commit(spark, _log(path), change)[0]


def add_run(spark: SparkSession, path: str, rows: DataFrame, positions: dict[str, int], events: int, shape: Shape = CHANGES, most: int | None = None, oldest: dict[str, int] | None = None) -> int:
    """Publishes the rows of a batch as a run, with the drives' positions after it and its number of events; runs and levels that are full are merged. Returns the run's version.

    Rows with a null in their key name no entry and are left out. most: rows at most, if an event makes more than two. oldest: what
    can't come again, if the caller knows it: rows of a drive before that seq.
    """
    most = 2 * events if most is None else most
    run = _write(spark, path, latest(rows.dropna(subset=list(shape.key)), shape), most, shape) if most else []

    def change(manifest):
        manifest = manifest or _EMPTY | {"saved_at": time.time()}
        after = {d: max(s, manifest["positions"].get(d, s)) for d, s in positions.items()}
        return manifest | {"positions": manifest["positions"] | after, "runs": manifest["runs"] + run, "batches": manifest["batches"] + 1, "pending": manifest["pending"] + events, "oldest": manifest["oldest"] | (oldest or {})}

    version, _ = commit(spark, _log(path), change, KEPT)
    while merge_once(spark, path, shape):
        pass
    return version


def _chosen(manifest: dict, levels: list[list[dict]]) -> tuple[list[dict], int] | None:
    """What is to be merged next, and into which level (from 1)."""
    if len(manifest["runs"]) >= LEVEL0_RUNS:
        return manifest["runs"], 1
    for k, level in enumerate(levels, 1):
        if sum(p["rows"] for p in level) > LEVEL1_ROWS * GROWTH ** (k - 1) and (k < len(levels) or len(level) > 1):
            return [min(level, key=lambda p: (p.get("made", 0), p["low"]))], k + 1
    return None


def merge_once(spark: SparkSession, path: str, shape: Shape = CHANGES) -> bool:
    """Merges what is due, once; whether something was. Another writer's merge of the same inputs wins if it comes first."""
    found = load_manifest(spark, path)
    if found is None:
        return False
    version, manifest = found
    levels = _levels(spark, path, manifest)
    chosen = _chosen(manifest, levels)
    if chosen is None:
        return False
    inputs, level = chosen
    levels += [[] for _ in range(level - len(levels))]
    below = _meeting(levels[level - 1], inputs)
    deepest = not any(levels[level:])
    rows = inputs + below
    if below or level == 1:
        merged = latest(_rows(spark, path, rows, shape), shape)
        if deepest:
            above = [p for p in [*manifest["runs"], *(p for k in range(level - 1) for p in levels[k])] if p not in inputs]
            merged = merged.where(~_droppable(manifest["oldest"], _meeting(above, rows)))
        made = _write(spark, path, merged, sum(p["rows"] for p in rows), shape)
    else:
        made = inputs  # nothing below overlaps: the part moves as it is
    made = [p | {"made": version} for p in made]
    after = [[p for p in own if p not in rows] for own in levels]
    after[level - 1] = sorted(after[level - 1] + made, key=lambda p: p["low"])
    name = uuid.uuid4().hex
    write_json(spark, f"{path}/_parts/{name}.json", {"levels": after})
    gone = [p["file"] for p in rows if p["file"] not in {m["file"] for m in made}]

    def change(now):
        if now["parts"] != manifest["parts"] or any(r not in now["runs"] for r in inputs if level == 1):
            return None
        runs = [r for r in now["runs"] if level > 1 or r not in inputs]
        old = [f"_parts/{manifest['parts']}.json"] if manifest["parts"] else []
        return now | {"runs": runs, "parts": name, "trash": now["trash"] + [[version, f] for f in [*gone, *old]]}

    done = commit(spark, _log(path), change, KEPT)
    if done is None:
        delete(spark, f"{path}/_parts/{name}.json", *{f"{path}/{p['file'].rpartition('/')[0]}" for p in made if p["file"] not in {r["file"] for r in rows}})
        return True
    _empty_trash(spark, path)
    return True


def _droppable(oldest: dict[str, int], others: list[dict]):
    """Tombstones that nothing needs: older than all events of their drive that can come again, and than all that other parts with such keys have."""
    out = F.lit(False)
    for drive, seq in oldest.items():
        least = min([seq, *(p["least"][drive] for p in others if drive in p["least"])])
        out = out | ((F.col("drive") == drive) & F.col("gone") & (F.col("seq") < least))
    return out


def _empty_trash(spark: SparkSession, path: str) -> None:
    """Deletes files that were replaced KEPT versions ago, and folders of which no file is used any more."""
    found = load_manifest(spark, path)
    version, manifest = found
    old = [f for v, f in manifest["trash"] if v <= version - KEPT]
    if not old:
        return

    def change(now):
        return now | {"trash": [t for t in now["trash"] if t[1] not in old]}

    commit(spark, _log(path), change, KEPT)
    used = {f.rpartition("/")[0] for f in [*(p["file"] for p in manifest["runs"]), *(p["file"] for level in _levels(spark, path, manifest) for p in level), *(f for _, f in manifest["trash"] if f not in old)]}
    folders = {f.rpartition("/")[0] for f in old if f.startswith("data/")} - used
    delete(spark, *[f"{path}/{f}" for f in [*folders, *(f for f in old if f.rpartition("/")[0] not in folders)]])


def mark_saved(spark: SparkSession, path: str, manifest: dict, now: float | None = None) -> int:
    """Notes that this manifest's state has been saved. What the save before had covered can't come again, so its older tombstones may go."""
    return commit(spark, _log(path), lambda m: m | {"saved": manifest["positions"], "oldest": m["saved"], "saved_at": now or time.time(), "pending": max(0, m["pending"] - manifest["pending"])}, KEPT)[0]


def is_due(manifest: dict, now: float, events: int = 500, seconds: float = 30.0) -> bool:
    """Whether the state is to be saved: so many events are pending and the last save is so long ago."""
    return manifest["pending"] >= events and now - manifest["saved_at"] >= seconds
