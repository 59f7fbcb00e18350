"""Hard negatives by exact inner products: STR-packed R-trees, searched best first.

Rows are dealt into cells by a hash of their label and by sort-tile-recursive cuts; each part of a cell packs its rows
into an R-tree in the same way. A bounding box gives an interval of inner products: coordinate by coordinate the greater and the
smaller end. A queue takes boxes in descending order of their upper ends and passes over those outside all score
windows that the query still has, or strictly below the k-th score of each; equal ones are opened, as a smaller id wins.
All arithmetic is of whole numbers: floating point is used while products stay below 2^53, Python's integers beyond.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.stored import broadcast_if_small, read, small_batches, spread, stored, stored_counting
from lodestone.llm.vector_cells import Cuts, Directory, cells_wanted, finite, in_cells, matrix, placed, sampled, searched, slab_count, str_cuts

#: Labels are dealt into so many groups of cells, so that rows of one label are looked for in a part of the cells.
LABEL_GROUPS = 8
LEAF_ROWS, FANOUT = 64, 8
EXACT = 1 << 53
_LONG = (1 << 63) - 1


def str_order(values: np.ndarray, leaf_rows: int, dimensions: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Sort-tile-recursive packing: an order of the rows, and where each leaf of at most `leaf_rows` begins and the last one ends."""
    order, ends = [], [0]

    def pack(rows: np.ndarray, left: list[int]) -> None:
        leaves = -(-len(rows) // leaf_rows)
        if leaves < 2:
            order.append(rows)
            ends.append(ends[-1] + len(rows))
            return
        rows = rows[np.argsort(values[rows, left[0]], kind="stable")]
        size = leaf_rows if len(left) == 1 else -(-leaves // slab_count(leaves, len(left))) * leaf_rows
        for k in range(0, len(rows), size):
            pack(rows[k : k + size], left[1:])

    pack(np.arange(len(values)), dimensions)
    return np.concatenate(order), np.array(ends)


class RTree:
    """Bounding boxes of rows in levels, the leaves first; a box holds FANOUT of the level below at most."""

    def __init__(self, values: np.ndarray, whole):
        dimensions = np.argsort(-np.ptp(values, axis=0), kind="stable").tolist()
        self.order, self.first = str_order(values, LEAF_ROWS, dimensions)
        values = whole(values[self.order])
        low, high = (f.reduceat(values, self.first[:-1], axis=0) for f in (np.minimum, np.maximum))
        self.values, self.low, self.high = values, [low], [high]
        while len(self.low[-1]) > FANOUT:
            at = np.arange(0, len(self.low[-1]), FANOUT)
            self.low.append(np.minimum.reduceat(self.low[-1], at, axis=0))
            self.high.append(np.maximum.reduceat(self.high[-1], at, axis=0))


def intervals(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of each query with any vector in each box."""
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)
    return up @ low.T + down @ high.T, up @ high.T + down @ low.T


def _whole(exact: bool):
    """Whole numbers as floating point where that is exact, else as Python's integers."""
    return (lambda values: values) if exact else np.vectorize(int, otypes=[object])


def _best_first(tree: RTree, least: list[np.ndarray], most: list[np.ndarray], query: np.ndarray, allowed: np.ndarray, ids: np.ndarray, low: list, high: list, bound: list, k: int) -> list[list[tuple]]:
    """The first k (score, id), in descending order, ascending for ids, of each window from low to high, of rows that are allowed and not below the bound.

    least, most: of each level, the intervals of its boxes for this query.
    """
    found: list[list[tuple]] = [[] for _ in low]
    need = [max(a, b) for a, b in zip(low, bound, strict=True)]  # what a row's score has to reach
    queue = [(-most[-1][x], len(most) - 1, x) for x in range(len(most[-1]))]
    heapq.heapify(queue)
    while queue:
        upper, level, box = heapq.heappop(queue)
        if -upper < min(need):
            break
        lower = least[level][box]
        if not any(-upper >= a and lower <= b for a, b in zip(need, high, strict=True)):
            continue
        if level:
            for x in range(box * FANOUT, min((box + 1) * FANOUT, len(most[level - 1]))):
                heapq.heappush(queue, (-most[level - 1][x], level - 1, x))
            continue
        a, b = tree.first[box], tree.first[box + 1]
        score = tree.values[a:b] @ query
        rows = np.flatnonzero(allowed[a:b] & (score >= min(need)))
        if not len(rows):
            continue
        score, own = score[rows], ids[a:b][rows]
        for p in range(len(low)):
            fits = (score >= need[p]) & (score <= high[p])
            if fits.any():
                best = sorted(found[p] + [(-int(s), i) for s, i in zip(score[fits].tolist(), own[fits].tolist(), strict=True)])[:k]
                found[p] = best
                if len(best) == k:
                    need[p] = max(need[p], -best[-1][0])
    return [[(-s, i) for s, i in best] for best in found]


def _search(width: int, exact: bool, k: int, same: bool, windows):
    """Rows of the query's label, or of all others, best first in each window; windows(batch or table) gives low, high and bound of each query."""
    whole = _whole(exact)

    def search(queries: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if queries.num_rows and rows.num_rows:
            tree = RTree(matrix(rows["vector"], width), whole)
            ids, row = rows["vec_id"].to_numpy()[tree.order], rows["row"].to_numpy()[tree.order]
            label = np.array(rows["label"].to_pylist(), object)[tree.order]
            labels = set(label.tolist())
            asked = whole(matrix(queries["vector"], width))
            bounds = [intervals(asked, *boxes) for boxes in zip(tree.low, tree.high, strict=True)]
            for q, (own, own_label, (low, high, bound)) in enumerate(zip(queries["row"].to_pylist(), queries["label"].to_pylist(), windows(queries), strict=True)):
                if not low or (own_label not in labels if same else labels == {own_label}):
                    continue
                allowed = ((label == own_label) == same) & (row != own)
                best = _best_first(tree, [b[0][q] for b in bounds], [b[1][q] for b in bounds], asked[q], allowed, ids, low, high, bound, k)
                out += [(own, p, i, max(-_LONG, min(_LONG, s))) for p, x in enumerate(best) for s, i in x]
        return pa.table({c: pa.array([x[j] for x in out], pa.int64()) for j, c in enumerate(("row", "positive", "vec_id", "score"))})

    return search


_FOUND = "row long, positive long, vec_id long, score long"


def _whole_windows(table):
    """One window without ends, and what the first round found."""
    return [([-np.inf], [np.inf], [-np.inf if b is None else b]) for b in table["bound"].to_pylist()]


def _score_windows(low: int, high: int):
    """Of each positive's score the percentages from low to high, as whole numbers."""

    def windows(table):
        out = []
        for scores, bounds in zip(table["positive_scores"].to_pylist(), table["bounds"].to_pylist(), strict=True):
            least, most = [-(-low * s // 100) for s in scores], [high * s // 100 for s in scores]
            known = bounds or [None] * len(scores)
            out.append((least, most, [-np.inf if b is None else b for b in known[: len(scores)]]))
        return out

    return windows


def _promise(width: int, exact: bool, windows, groups: np.ndarray | None):
    """Cells promise their greatest inner product; nothing if it is in no window, or if they are of another group of labels (groups: where each one's cells begin)."""
    whole = _whole(exact)

    def promise(batch: pa.RecordBatch, directory: Directory) -> np.ndarray:
        least, most = intervals(whole(matrix(batch.column("vector"), width)), whole(directory.low), whole(directory.high))
        useful = np.zeros(least.shape, bool)
        for q, (low, high, bound) in enumerate(windows(batch)):
            for a, b, c in zip(low, high, bound, strict=True):
                useful[q] |= (most[q] >= max(a, c)) & (least[q] <= b)
        if groups is not None:
            useful &= batch.column("label_group").to_numpy()[:, None] == np.searchsorted(groups, directory.cell, "right") - 1
        return np.where(useful, most, -np.inf).astype(float)

    return promise


def _cell(cuts: list[Cuts], width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, group = matrix(batch.column("vector"), width), batch.column("label_group").to_numpy()
            cell = np.zeros(len(group), np.int32)
            for g in np.unique(group):
                cell[group == g] = placed(cuts[g], values[group == g])
            yield batch.append_column("cell", pa.array(cell))

    return run


def hard_negatives(rows: DataFrame, is_anchor: str, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of rows (vec_id, label, vector of whole numbers).

    Anchors are the rows where the SQL condition is_anchor holds. A score is the inner product with the anchor; higher ones come
    first, ties by smaller vec_id. An anchor's positives are its first rows of the same label, itself left out; for each, the
    negatives are the first rows of other labels with low to high per cent of the positive's score, ranked from 1. A negative
    positive score has no such rows. Rows with no vec_id, no label, no vector or a null or non-finite component take no part;
    shorter vectors count as filled with zeros. Rows that repeat a vec_id are rows of their own, so one positive may come twice.
    Scores beyond 64 bits are cut to the ends of long. Other columns are ignored; an empty table gives no rows.
    """
    small_batches(rows.sparkSession)
    label = F.col("label").cast("string")
    known = rows.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long"), label.alias("label"), F.col("vector").cast("array<double>"), F.coalesce(F.expr(is_anchor), F.lit(False)).alias("asks"))
    known = known.withColumn("label_group", F.pmod(F.xxhash64("label"), F.lit(LABEL_GROUPS)).cast("int"))
    valid = known.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite("vector"))
    largest = F.coalesce(F.array_max(F.transform("vector", F.abs)), F.lit(0.0))
    shares = {f"group_{g}": F.count_if(F.col("label_group") == g) for g in range(LABEL_GROUPS)}
    plain, seen = stored_counting(valid, "vectors", width=F.max(F.size("vector")), largest=F.max(largest), **shares)
    width = max(1, seen.get("width") or 0)
    exact = width * (seen.get("largest") or 0) ** 2 < EXACT
    total = max(1, seen.get("rows", 0))

    sample = sampled(plain.select("label_group", "vector"), total, width)
    values, group, cuts, begins, made = matrix(sample["vector"], width), sample["label_group"].to_numpy(), [], [], 0
    for g in range(LABEL_GROUPS):
        own = values[group == g]
        dimensions = np.argsort(-np.ptp(own, axis=0), kind="stable").tolist() if len(own) else [0]
        begins.append(made)
        cut, made = str_cuts(own, round(cells_wanted(total, width) * seen.get(f"group_{g}", 0) / total), dimensions, made)
        cuts.append(cut)
    schema = "row long, vec_id long, label string, vector array<double>, asks boolean, label_group int"
    in_cell, directory = in_cells(plain.mapInArrow(_cell(cuts, width), f"{schema}, cell int"), "vector", width)
    cells = in_cell.select("row", "vec_id", "label", "vector", "cell", "part")

    anchors = plain.where("asks").select("row", "vec_id", "label", "vector", "label_group")
    queries = anchors.select("row", "label", "vector", "label_group", F.lit(None).cast("long").alias("bound"))
    bounded = lambda found: found.groupBy("row").agg(F.when(F.count("*") >= positives, F.min("score")).alias("bound"))
    same = searched(queries, cells, directory, _promise(width, exact, _whole_windows, np.array(begins)), _search(width, exact, positives, True, _whole_windows), _FOUND, bounded, "positives")
    best = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    ranked = stored(same.withColumn("positive", F.cast("long", best - 1)).where(F.col("positive") < positives), "positives")

    scores = F.transform(F.array_sort(F.collect_list(F.struct("positive", "score"))), lambda x: x.score)
    queries = anchors.select("row", "label", "vector").join(ranked.groupBy("row").agg(scores.alias("positive_scores")), "row").withColumn("bounds", F.lit(None).cast("array<bigint>"))

    def bounds(found: DataFrame) -> DataFrame:
        each = found.groupBy("row", "positive").agg(F.when(F.count("*") >= negatives, F.min("score")).alias("bound"))
        return each.groupBy("row").agg(F.array(*[F.max(F.when(F.col("positive") == p, F.col("bound"))) for p in range(positives)]).alias("bounds"))

    windows = _score_windows(low, high)
    other = searched(queries, cells, directory, _promise(width, exact, windows, None), _search(width, exact, negatives, False, windows), _FOUND, bounds, "negatives")
    rank = F.row_number().over(Window.partitionBy("row", "positive").orderBy(F.desc("score"), "vec_id"))
    mined = other.withColumn("rank", rank).where(F.col("rank") <= negatives).select("row", "positive", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = ranked.join(broadcast_if_small(anchors.select("row", F.col("vec_id").alias("anchor_id"))), "row").select("row", "positive", "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return mined.join(named, ["row", "positive"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = spread(read(spark, sf_dir, "embeddings")).select("vec_id", label.alias("label"), F.transform("embedding", lambda x: F.floor(256 * x.cast("double")).cast("double")).alias("vector"))
    return hard_negatives(rows, "vec_id % 100 = 0")


OP13_SQL = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), anchors AS (SELECT * FROM rows WHERE vec_id % 100 = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM anchors a JOIN rows b ON a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id)::INTEGER AS rank,
  n.vec_id AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same AND 100 * n.score BETWEEN 30 * p.positive_score AND 90 * p.positive_score
QUALIFY rank <= 10
"""
