"""Nearest vectors and hard negatives against brute force over all pairs."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

VECTORS = "vec_id long, vector array<double>, label string, row string, cell int"
ODD = [(5000, None), (5001, [0.0] * 8), (5002, [1.0, None] + [0.0] * 6), (5003, [float("nan")] + [1.0] * 7), (5004, [float("inf")] * 8), (5005, []), (None, [1.0] * 8), (5006, [3.0, 2.0])]


def clustered(n, width, seed):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, width))
    return (centres[rng.integers(0, 12, n)] + 0.6 * rng.standard_normal((n, width))) * rng.uniform(0.3, 2, (n, 1))


@pytest.fixture(scope="module")
def rows():
    vectors = clustered(1500, 8, 1)
    vectors[700:1200] = vectors[700]  # one vector has a third of all rows
    data = [(k, v.tolist()) for k, v in enumerate(vectors)] + [(40, vectors[41].tolist()), (40, vectors[41].tolist())] + ODD
    return [(i, v, None if k % 97 == 5 else "ab"[k % 2] if k % 5 else f"rare{k % 35}", "mine", 3) for k, (i, v) in enumerate(data)]


def taking_part(rows, whole=False):
    return [(k, i, v + [0.0] * (8 - len(v)), label) for k, (i, v, label, *_) in enumerate(rows) if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and (whole or any(v))]


def test_chi_square():
    from lodestone.llm.nearest_vectors import chi_square_cdf, chi_square_quantile

    drawn = (np.random.default_rng(2).standard_normal((200_000, 6)) ** 2).sum(1)
    for p in (0.1, 0.5, 0.95):
        q = chi_square_quantile(p, 6)
        assert chi_square_cdf(q, 6) == pytest.approx(p) and (drawn <= q).mean() == pytest.approx(p, abs=0.005)


def test_cuts_place_every_row():
    from lodestone.llm import vector_cells as c

    values = clustered(3000, 5, 3)
    values[:1000] = values[0]
    for cuts, made in (c.kd_cuts(values[::3], 32), c.str_cuts(values[::3], 32, [3, 1, 0, 2, 4])):
        cell = c.placed(cuts, values)
        assert set(cell.tolist()) <= set(range(made)) and made <= 64 and np.bincount(cell[1000:]).max() < 500
    assert c.kd_cuts(values[:1000], 8) == (0, 1) and c.kd_cuts(values[:0], 8) == (0, 1) and c.str_cuts(values[:0], 8, [0])[1] == 1
    assert c.slab_count(32, 64) == 2 and c.slab_count(27, 3) == 3 and c.slab_count(5, 1) == 5


@pytest.mark.parametrize("small", [False, True])
def test_nearest(spark, rows, small, monkeypatch):
    from lodestone.llm import nearest_vectors, vector_cells

    if small:  # many cells, parts of cells and slices of queries
        for module, name, value in ((vector_cells, "CELL_ROWS", 60), (vector_cells, "SLICE_QUERIES", 20), (nearest_vectors, "LEAF_ROWS", 8)):
            monkeypatch.setattr(module, name, value)
    part = taking_part(rows)
    vectors = np.array([v for _, _, v, _ in part])
    found = defaultdict(list)
    for r in nearest_vectors.nearest(spark.createDataFrame(rows, VECTORS), "vec_id % 20 = 0", 20).collect():
        found[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    hits = total = 0
    by_id = defaultdict(list)
    for place, (_, i, _, _) in enumerate(part):
        by_id[i].append(place)
    assert set(found) == {i for _, i, _, _ in part if i % 20 == 0}
    for i, near in found.items():
        queries = by_id[i]
        assert Counter(r for r, *_ in near) == Counter({r: len(queries) for r in range(1, 21)})
        scores = {j: [float((vectors[place] * vectors[q]).sum()) for q in queries for place in by_id[j]] for _, j, _ in near}
        assert all(any(s == pytest.approx(x, rel=1e-12) for x in scores[j]) for _, j, s in near)
        if len(queries) == 1:
            near = sorted(near)
            assert [(-s, j) for _, j, s in near] == sorted((-s, j) for _, j, s in near)
            true = sorted((-float((v * vectors[queries[0]]).sum()), part[place][1]) for place, v in enumerate(vectors) if place != queries[0])[:20]
            hits += len({j for _, j in true} & {j for _, j, _ in near})
            total += 20
    assert total >= 1000 and hits >= 0.95 * total


def test_nearest_of_few(spark, rows):
    from lodestone.llm.nearest_vectors import nearest

    few = spark.createDataFrame([(k, [float(k), 1.0], "x", "y", 1) for k in range(6)], VECTORS)
    found = [tuple(r) for r in nearest(few, "vec_id % 5 = 0", 20).orderBy("query_id", "rank").collect()]
    assert found == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 3, 1.0), (0, 4, 4, 1.0), (0, 5, 5, 1.0), (5, 1, 4, 21.0), (5, 2, 3, 16.0), (5, 3, 2, 11.0), (5, 4, 1, 6.0), (5, 5, 0, 1.0)]
    for nothing in ([], [ODD[0], ODD[1], ODD[2]]):
        frame = spark.createDataFrame([(*r, "x", "y", 1) for r in nothing], VECTORS)
        assert nearest(frame, "vec_id % 20 = 0").collect() == []
    assert nearest(few, "vec_id > 99").collect() == []
    # equal norms and copies: ties go to smaller ids
    copies = spark.createDataFrame([(k, [0.6, 0.8] if k % 3 else [0.8, 0.6], "x", "y", 1) for k in range(300)], VECTORS)
    ids = [r["vec_id"] for r in nearest(copies, "vec_id = 100", 20).orderBy("rank").collect()]
    assert ids == [k for k in range(300) if k % 3 and k != 100][:20]


def expected_negatives(part, is_anchor):
    out = []
    for k, i, v, label in part:
        if is_anchor(i):
            scored = sorted((-sum(int(x) * int(y) for x, y in zip(v, w, strict=True)), j, other) for m, j, w, other in part if m != k)
            for s, j, _ in [r for r in scored if r[2] == label][:5]:
                fit = [r for r in scored if r[2] != label and 30 * -s <= 100 * -r[0] <= 90 * -s][:10]
                out += [(i, j, rank, r[1], -s, -r[0]) for rank, r in enumerate(fit, 1)]
    return out


@pytest.mark.parametrize("small", [False, True])
def test_hard_negatives(spark, rows, small, monkeypatch):
    from lodestone.llm import hard_negatives, vector_cells

    if small:
        for module, name, value in ((vector_cells, "CELL_ROWS", 60), (vector_cells, "SLICE_QUERIES", 20), (hard_negatives, "LEAF_ROWS", 8), (hard_negatives, "FANOUT", 3)):
            monkeypatch.setattr(module, name, value)
    whole = [(i, v and [x if x is None or not math.isfinite(x) else float(math.floor(20 * x)) for x in v], *rest) for i, v, *rest in rows]
    part = [r for r in taking_part(whole, whole=True) if r[3] is not None]
    found = [tuple(r) for r in hard_negatives.hard_negatives(spark.createDataFrame(whole, VECTORS), "vec_id % 50 = 0").collect()]
    assert len(found) > 800 and Counter(found) == Counter(expected_negatives(part, lambda i: i % 50 == 0))


def test_hard_negatives_large_numbers(spark):
    from lodestone.llm.hard_negatives import hard_negatives

    rng = random.Random(4)
    rows = [(k, [float(rng.randrange(-(2**30), 2**30)) for _ in range(3)], "ab"[k % 2], "x", 1) for k in range(60)]
    part = [(k, i, v, label) for k, (i, v, label, *_) in enumerate(rows)]
    found = [tuple(r) for r in hard_negatives(spark.createDataFrame(rows, VECTORS), "vec_id % 10 = 0").collect()]
    assert found and Counter(found) == Counter(expected_negatives(part, lambda i: i % 10 == 0))
    for few in ([], rows[:1], [(0, None, "a", "x", 1), (100, [1.0], None, "x", 1)]):
        assert hard_negatives(spark.createDataFrame(few, VECTORS), "vec_id % 10 = 0").collect() == []


def test_tree_prunes():
    """Boxes bound their products, far boxes aren't opened, and leaves hold at most LEAF_ROWS."""
    from lodestone.llm import hard_negatives as h

    values = np.floor(20 * clustered(4000, 8, 9))
    tree = h.RTree(values, lambda x: x)
    assert sorted(tree.order.tolist()) == list(range(4000)) and np.diff(tree.first).max() <= h.LEAF_ROWS and len(tree.high[-1]) <= h.FANOUT
    query = values[17]
    least, most = zip(*[[x[0] for x in h.intervals(query[None], *boxes)] for boxes in zip(tree.low, tree.high, strict=True)], strict=True)
    score = tree.values @ query
    for k in range(len(tree.first) - 1):
        own = score[tree.first[k] : tree.first[k + 1]]
        assert least[0][k] <= own.min() and own.max() <= most[0][k]
    opened = []

    class Counting(np.ndarray):
        def __getitem__(self, key):
            opened.append(key)
            return super().__getitem__(key)

    tree.values = tree.values.view(Counting)
    best = h._best_first(tree, list(least), list(most), query, np.ones(4000, bool), tree.order, [-np.inf], [np.inf], [-np.inf], 5)
    assert best[0] == sorted(zip(score.astype(int).tolist(), tree.order.tolist(), strict=True), key=lambda r: (-r[0], r[1]))[:5]
    assert len(opened) < 0.5 * (len(tree.first) - 1)
