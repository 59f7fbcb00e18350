"""What the largest task of a step holds: its rows and its memory."""

import uuid

import pytest

from lodestone.operators import hierarchy
from lodestone.sources import tables
from lodestone.streaming import changes, log_state


def tasks_of(spark, action):
    """(shuffled rows read, peak bytes of memory) of each task of the action's jobs, and the action's result."""
    group, store = uuid.uuid4().hex, spark.sparkContext._jsc.sc().statusStore()
    spark.sparkContext.setJobGroup(group, group)
    try:
        result = action()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    found = []
    for job in spark.sparkContext.statusTracker().getJobIdsForGroup(group):
        for stage in spark.sparkContext.statusTracker().getJobInfo(job).stageIds:
            try:
                tasks = store.taskList(stage, store.lastStageAttempt(stage).attemptId(), 10_000)
            except Exception:  # a stage that was skipped has no attempt
                continue
            for k in range(tasks.size()):
                if tasks.apply(k).taskMetrics().isDefined():
                    m = tasks.apply(k).taskMetrics().get()
                    found.append((m.shuffleReadMetrics().recordsRead(), m.peakExecutionMemory()))
    return found, result


@pytest.fixture
def conf(spark):
    """Sets values of the session for one test."""
    before = {}

    def put(key, value):
        before.setdefault(key, spark.conf.get(key, None))
        spark.conf.set(key, value)

    yield put
    for key, value in before.items():
        spark.conf.set(key, value) if value is not None else spark.conf.unset(key)


def test_pruned_refs_are_no_task_of_their_own(spark, conf, monkeypatch):
    """20,000 pruned refs, one of which holds something: no task has them all, neither as chains that have ended nor as rows at the root."""
    monkeypatch.setattr(hierarchy, "BROADCAST_ROWS", 0)
    for key, value in (("spark.sql.adaptive.coalescePartitions.enabled", "false"), ("spark.sql.autoBroadcastJoinThreshold", "-1"), ("spark.sql.shuffle.partitions", "16")):
        conf(key, value)
    entries = spark.range(2_000).selectExpr("'C' as drive", "id + 1 as file_ref", "if(id < 50, 0L, 1 + id % 50) as parent_ref", "concat('n', id) as name", "id < 50 as is_dir")
    late = spark.createDataFrame([("C", 9_000, 100_005, "late", False)], tables.SCAN)
    pruned = spark.range(20_000).selectExpr("'C' as drive", "100000 + id as file_ref")

    def action():
        now, junk = changes.with_junk(changes.from_scan(entries.unionByName(late)), pruned, junk_dirs=("n7",))
        return {r["file_ref"] for r in now.collect()}, {r["file_ref"] for r in junk.collect()}

    found, (now, junk) = tasks_of(spark, action)
    under = {k + 1 for k in range(50, 2_000) if 1 + k % 50 == 8}
    assert junk == set(range(100_000, 120_000)) | under | {9_000} and now == set(range(1, 2_001)) - under
    assert max(rows for rows, _ in found) < 5_000


def test_large_merges_are_not_one_task_for_each_core(spark, conf):
    """Adaptive execution leaves the partitions of a state's merge apart, so what a task sorts doesn't grow to tens of MB of compressed rows."""
    state = changes.from_scan(spark.range(20_000).selectExpr("'C' as drive", "id as file_ref", "0L as parent_ref", "concat('n', id) as name", "false as is_dir"))
    found, rows = tasks_of(spark, lambda: changes.merged(state, spark.createDataFrame([("C", 1, "deleted", 5, None, 0, "n", False)], tables.EVENTS)).where("not gone").collect())
    assert len(rows) == 19_999 and max(n for n, _ in found) < 2_000


def test_memory_of_a_write_does_not_grow_with_the_tasks_before(spark, conf, tmp_path):
    conf("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rows = spark.range(20_000).selectExpr("'C' as drive", "id as file_ref", "0L as parent_ref", "concat('n', id) as name", "false as is_dir", "1L as seq", "false as gone")
    most = []
    for parts in (2, 32):
        conf("spark.sql.shuffle.partitions", str(parts))
        path = f"file://{tmp_path}/{parts}"
        found, _ = tasks_of(spark, lambda path=path: log_state.add_run(spark, path, rows.repartition(2), {"C": 1}, 20_000))
        assert log_state.load_state(spark, path)[0].count() == 20_000
        most.append(max(memory for _, memory in found))
    assert most[1] <= 2 * most[0], most
