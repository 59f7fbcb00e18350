"""Postings of three letters: the names that contain a query, and how much of the files a query reads."""

import random

import pytest

from lodestone.operators import hierarchy, search, substring
from lodestone.sources import tables


@pytest.fixture(scope="module")
def entries(spark):
    rng = random.Random(9)
    names = ["".join(rng.choice("abcdé_. ") for _ in range(rng.randint(1, 9))) for _ in range(500)] + ["Readme.TXT", "readme.txt", "aaaa", "aa", "a", "ab\ncd"]
    rows = [("C", k, 0, n, False) for k, n in enumerate(names, 1)] + [("D", 7, 0, "aaaa", True)]
    return hierarchy.with_ancestry(spark.createDataFrame(rows, tables.SCAN))


def test_same_as_a_scan(spark, entries, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/index"
    assert substring.load(spark, path) is None and substring.build(entries.limit(0), path) is None and substring.build(entries, path) == 1
    index = substring.load(spark, path)
    for most in (2_000, 3):  # by equality, and by a join
        monkeypatch.setattr(substring, "LOOKED_UP", most)
        for query in ("a", "ab", "abc", "aaa", "README", ".t", "me.t", "é", "éa", "nothing", "b c", "b\nc", "aaaa", "abab", ""):
            keys = lambda frame: sorted((r["drive"], r["file_ref"]) for r in frame.collect())
            assert keys(substring.entries_with(index, query)) == keys(entries.where(entries.name_lower.contains(query.lower()))), query
            assert substring.entries_with(index, query).columns == entries.columns
    page = lambda frame: [(r["rank"], r["file_ref"]) for r in search.search_generic(frame, "ab").collect()]
    assert page(substring.entries_with(index, "ab")) == page(entries)


def read_bytes(spark, frame):
    """Bytes that the stages of a frame's job read from files."""
    store = spark.sparkContext._jsc.sc().statusStore()
    spark.sparkContext.setJobGroup("bytes", "bytes")
    try:
        rows = frame.count()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    stages = {s for job in spark.sparkContext.statusTracker().getJobIdsForGroup("bytes") for s in spark.sparkContext.statusTracker().getJobInfo(job).stageIds}
    total = 0
    for s in stages:
        try:
            total += store.lastStageAttempt(s).inputBytes()
        except Exception:  # a stage that was skipped has no attempt
            continue
    return rows, total


def test_a_query_reads_little(spark, tmp_path, monkeypatch):
    """A three-letter query reads under a tenth of what the entries have, postings and entries together."""
    monkeypatch.setattr(substring, "GROUP_BYTES", 1 << 20)
    path = f"file://{tmp_path}/index"
    name = "concat(sha2(cast(id as string), 256), '.', id)"
    scan = spark.range(60_000).selectExpr("'C' as drive", "id + 1 as file_ref", "0L as parent_ref", f"if(id % 5000 = 0, concat('zzq-', id), translate({name}, 'z', 'y')) as name", "false as is_dir")
    substring.build(hierarchy.with_ancestry(scan), path)
    index = substring.load(spark, path)
    size = sum(f.stat().st_size for f in tmp_path.rglob("entries/*.parquet"))
    found, names = read_bytes(spark, substring.names_with(index, "zzq"))
    rows, own = read_bytes(spark, substring.entries_with(index, "zzq"))
    assert found == rows == 12 and names + own < size / 10, (names, own, size)


def test_postings_are_fewer_than_letters(spark, tmp_path):
    """Postings of 20,000 numbered names are of blocks, so they have fewer rows than the entries, and searches find what a scan finds."""
    scan = spark.range(20_000).selectExpr("'C' as drive", "id + 1 as file_ref", "0L as parent_ref", "concat('order_', 1000000 + id, '.o_x') as name", "false as is_dir")
    entries = hierarchy.with_ancestry(scan)
    substring.build(entries, f"file://{tmp_path}/index")
    index = substring.load(spark, f"file://{tmp_path}/index")
    assert index["grams"].count() < 20_000
    for query in ("07", "077", "0077", "der_1", "1019999", "order_1000000.o_x", "77777"):
        assert substring.entries_with(index, query).count() == entries.where(entries.name_lower.contains(query)).count(), query
