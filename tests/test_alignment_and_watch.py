"""Alignment scores against all ways to place a query, and what a stream's events start."""

import itertools
import json
import random
import time

import pytest

from lodestone.operators import alignment, hierarchy, search
from lodestone.sources import tables
from lodestone.streaming import changes
from lodestone.streaming.watch import Watch, watch


def best_placement(name, query):
    found = -1
    for places in itertools.combinations(range(len(name)), len(query)):
        if query and all(name[p] == c for p, c in zip(places, query, strict=True)):
            score = sum(alignment.MATCH + alignment.WORD_START * (p == 0 or not name[p - 1].isalnum()) for p in places)
            for a, b in zip(places, places[1:], strict=False):
                score += alignment.NEXT if b == a + 1 else -(alignment.OPEN + alignment.MORE * (b - a - 2))
            found = max(found, score)
    return found


def test_scores():
    rng = random.Random(7)
    names = ["".join(rng.choice("ab-é ") for _ in range(rng.randint(0, 11))) for _ in range(300)] + ["", "a", "ab" * 6]
    for query in ("a", "ab", "aba", "b a", "éa", "aaaa", "zz"):
        scores = alignment.alignment_scores(names, query).tolist()
        assert scores == [best_placement(n, query) for n in names], query
        assert all(s <= b for s, b in zip(scores, alignment._bounds(names, query).tolist(), strict=True))
    assert alignment.alignment_scores(["a"], "").tolist() == [-1] and alignment.alignment_scores([], "a").tolist() == []


def test_best_entries(spark, monkeypatch):
    rng = random.Random(8)
    names = ["".join(rng.choice("abc. ") for _ in range(rng.randint(1, 12))) for _ in range(700)] + ["x" * 3000 + "abc", "abc" * 20]
    rows = hierarchy.with_ancestry(spark.createDataFrame([("C", k, 0, n, False) for k, n in enumerate(names, 1)], tables.SCAN)).repartition(5)
    for cells, most in ((1 << 20, 9), (100, 40), (1 << 20, 2000)):
        monkeypatch.setattr(alignment, "CELLS", cells)
        found = [(r["score"], r["name_lower"], r["file_ref"]) for r in alignment.aligned(rows, "ABC", most).collect()]
        scored = [(int(s), n, k) for k, (n, s) in enumerate(zip(names, alignment.alignment_scores(names, "abc"), strict=True), 1) if s >= 0]
        assert found == sorted(scored, key=lambda r: (-r[0], r[1], r[2]))[:most]
    page = lambda rows, q: [r["name"] for r in search.search_paged(hierarchy.with_ancestry(spark.createDataFrame([("C", k, 0, n, False) for k, n in enumerate(rows, 1)], tables.SCAN)), q, 10, by_alignment=True)[0].collect()]
    assert page(["Visual Studio Code.lnk", "Vim.exe", "somethingelse.txt"], "vsc") == ["Visual Studio Code.lnk"]
    assert set(page(["Visual Studio Code.lnk", "visualstudio.exe", "Vim.exe"], "vis")) == {"Visual Studio Code.lnk", "visualstudio.exe"}
    # the leftmost placement isn't the best one
    assert page(["asomewhere visual", "vaxsxc", "a vs code"], "vsc")[0] == "a vs code"


def test_watch(spark, tmp_path):
    """A stream's rows start one save, its state is what was saved, and a quiet or failed stream is stale."""
    folder = tmp_path / "journal" / "C" / "7"
    folder.mkdir(parents=True)
    lines = [{"seq": k, "file_ref": k + 1, "parent_ref": 0, "name": f"n{k}", "is_dir": False, "reason": changes.CREATE} for k in range(600)]
    (folder / "0-600.jsonl").write_text("".join(json.dumps(r) + "\n" for r in lines))
    path, saved = f"file://{tmp_path}/state", f"file://{tmp_path}/saved"
    roots, junk = spark.createDataFrame([("C", "C:\\")], "drive string, root string"), spark.createDataFrame([], "drive string, file_ref long")
    heard = watch(spark, lambda: changes.save_if_due(spark, path, saved, roots, junk, seconds=0), seconds=0, stale_after=0.2)
    query = changes.replay_journal(spark, f"file://{tmp_path}/journal", path, f"file://{tmp_path}/offsets", start="first", most_events=300, every="0 seconds")
    try:
        query.processAllAvailable()
        for _ in range(300):
            if heard.saves:
                break
            time.sleep(0.1)
        assert heard.saves == 1 and heard.pending == 0 and heard.error is None
        assert tables.load_snapshot(spark, saved)["entries"].count() == 600
        (folder / "0-600.jsonl").rename(folder / "700-800.jsonl")
        with pytest.raises(Exception, match="RescanNeeded"):
            query.awaitTermination(60)
        for _ in range(100):
            if str(query.id) in heard.ended:
                break
            time.sleep(0.1)
        assert heard.stale() == [str(query.id)]
    finally:
        query.stop()
        spark.streams.removeListener(heard)


def test_watch_policy():
    class Event:
        def __init__(self, id, rows=0, exception=None):
            self.id, self.exception, self.numInputRows, self.progress = id, exception, rows, self

    now, calls = [0.0], []

    def save():
        calls.append(now[0])
        if len(calls) == 1:
            raise RuntimeError("disk")

    w = Watch(save, events=10, seconds=30, stale_after=60, clock=lambda: now[0])

    def settled():
        while w._saving:
            time.sleep(0.01)

    w.onQueryStarted(Event("q"))
    for at, rows in ((1, 9), (31, 0), (32, 1)):  # too few, too few, due: fails
        now[0] = at
        w.onQueryProgress(Event("q", rows))
        settled()
    assert calls == [32] and w.pending == 10 and str(w.error) == "disk"
    now[0] = 50
    w.onQueryIdle(Event("q"))  # too early
    now[0] = 63
    w.onQueryIdle(Event("q"))
    settled()
    assert calls == [32, 63] and w.pending == 0 and w.saves == 1
    assert w.stale() == []
    now[0] = 124
    assert w.stale() == ["q"]
    w.onQueryTerminated(Event("q"))
    assert w.stale() == []  # ended as it should
    w.onQueryTerminated(Event("q", exception="lost"))
    assert w.stale() == ["q"]
