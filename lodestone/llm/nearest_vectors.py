"""Nearest vectors by inner product: a kd-tree over low-dimensional stable projections, with a chi-square stopping test.

Vectors are scaled by the greatest norm and get one coordinate more that makes all norms 1, so the largest inner
product is the smallest distance. A Gaussian projection to PROJECTED dimensions makes the square of the projected
distance of two vectors their true one times a chi-square variable. A query takes the projected neighbours in ascending
order from the kd-tree and verifies them by the true inner product, until what is left lies so far that a vector as near
as its present k-th would have been seen with probability CONFIDENCE: until the chi-square distribution function of the
next projected square over the k-th true square reaches it. The same test lets it pass over whole cells.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.stored import read, small_batches, spread, stored_counting
from lodestone.llm.vector_cells import Cuts, Directory, cells_wanted, finite, in_cells, kd_cuts, lists, matrix, placed, sampled, searched

#: Even, so that the chi-square distribution function is a finite sum.
PROJECTED = 16
CONFIDENCE = 0.95
LEAF_ROWS = 64
_FOUND = "row long, query_id long, vec_id long, score double"


def chi_square_cdf(x: float, freedom: int) -> float:
    """For an even number of degrees of freedom."""
    term = total = 1.0
    for k in range(1, freedom // 2):
        term *= x / 2 / k
        total += term
    return 1 - math.exp(-x / 2) * total


def chi_square_quantile(p: float, freedom: int) -> float:
    low, high = 0.0, 1.0
    while chi_square_cdf(high, freedom) < p:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square_cdf(middle, freedom) < p else (low, middle)
    return high


def directions(width: int) -> np.ndarray:
    """Gaussian directions for the coordinate that is added, in the first row, and `width` others."""
    return np.random.default_rng(20240601).standard_normal((width + 1, PROJECTED))


def _projected(width: int, greatest: float, as_query: bool):
    """Batches with `near`: the projection of the scaled vectors, as queries of norm 1 or as rows with the coordinate added."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = directions(width)
        for batch in batches:
            norm = batch.column("norm").to_numpy()[:, None]
            scaled = matrix(batch.column("vector"), width) / (norm if as_query else greatest)
            near = scaled @ own[1:]
            if not as_query:
                near += np.sqrt(np.maximum(0, 1 - (norm / greatest) ** 2)) * own[0]
            yield batch.append_column("near", lists(near))

    return run


def _cell(cuts: Cuts):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("cell", pa.array(placed(cuts, matrix(batch.column("near"), PROJECTED))))

    return run


def _box_distances(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squares of the distances of each point to each box."""
    out = np.zeros((len(points), len(low)))
    for k in range(points.shape[1]):
        own = points[:, k, None]
        out += np.maximum(0, np.maximum(low[:, k] - own, own - high[:, k])) ** 2
    return out


def _squares(score: np.ndarray, norm: np.ndarray, greatest: float) -> np.ndarray:
    """Squared distances of scaled vectors from inner products; not less than what rounding makes of 0."""
    return np.maximum(1e-9, 2 - 2 * (score / norm / greatest))


def _promise(greatest: float, reach: float):
    """Nearer cells promise more; one beyond the reach of a query's bound (its k-th score, null without) nothing."""

    def promise(batch: pa.RecordBatch, directory: Directory) -> np.ndarray:
        away = _box_distances(matrix(batch.column("near"), PROJECTED), directory.low, directory.high)
        bound = batch.column("bound").to_numpy(zero_copy_only=False).astype(float)
        with np.errstate(invalid="ignore"):
            limit = reach * _squares(bound, batch.column("norm").to_numpy(), greatest)
        return np.where(away > np.where(np.isnan(bound), np.inf, limit)[:, None], -np.inf, -away)

    return promise


class KdTree:
    """Rows of one part of a cell in leaves of LEAF_ROWS at most, with the bounds of each."""

    def __init__(self, near: np.ndarray):
        self.order, cuts, todo = np.arange(len(near)), [0], [(0, len(near))]
        while todo:
            a, b = todo.pop()
            rows = self.order[a:b]
            wide = np.ptp(near[rows], axis=0)
            if b - a <= LEAF_ROWS or not wide.any():
                cuts.append(b)
                continue
            middle = (b - a) // 2
            self.order[a:b] = rows[np.argpartition(near[rows, wide.argmax()], middle)]
            todo += [(a, a + middle), (a + middle, b)]
        self.first = np.unique(cuts)
        self.near = near[self.order]
        self.low, self.high = (f.reduceat(self.near, self.first[:-1], axis=0) for f in (np.minimum, np.maximum))


def _search(width: int, k: int, greatest: float, reach: float):
    def search(queries: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[tuple[int, int, np.ndarray, np.ndarray]] = []
        if queries.num_rows and rows.num_rows:
            tree = KdTree(matrix(rows["near"], PROJECTED))
            vectors, ids, row = matrix(rows["vector"], width)[tree.order], rows["vec_id"].to_numpy()[tree.order], rows["row"].to_numpy()[tree.order]
            asked, near, norms = matrix(queries["vector"], width), matrix(queries["near"], PROJECTED), queries["norm"].to_numpy()
            bounds = queries["bound"].to_numpy(zero_copy_only=False).astype(float)
            away = _box_distances(near, tree.low, tree.high)
            for q, (own, own_id) in enumerate(zip(queries["row"].to_pylist(), queries["query_id"].to_pylist(), strict=True)):
                leaves = np.argsort(away[q], kind="stable")
                far = np.append(away[q][leaves], np.inf)
                best_score, best_id = np.zeros(0), np.zeros(0, np.int64)
                bound = -np.inf if np.isnan(bounds[q]) else bounds[q]
                limit = np.inf if bound == -np.inf else reach * _squares(bound, norms[q], greatest)
                held, held_away = np.zeros(0, np.int64), np.zeros(0)
                opened, step = 0, 4
                while True:
                    new = [np.arange(tree.first[x], tree.first[x + 1]) for x in leaves[opened : opened + step] if away[q, x] <= limit]
                    opened, step = min(opened + step, len(leaves)), 2 * step
                    if new:
                        fresh = np.concatenate(new)
                        held = np.concatenate([held, fresh])
                        held_away = np.concatenate([held_away, ((tree.near[fresh] - near[q]) ** 2).sum(1)])
                    # neighbours nearer than all that is in leaves not yet opened come next
                    ready = held_away <= min(far[opened], limit)
                    chosen = held[ready]
                    held, held_away = held[~ready], held_away[~ready]
                    chosen = chosen[row[chosen] != own]
                    if len(chosen):
                        score = (vectors[chosen] * asked[q]).sum(1)
                        good = score >= bound
                        best_score, best_id = np.concatenate([best_score, score[good]]), np.concatenate([best_id, ids[chosen][good]])
                        first = np.lexsort((best_id, -best_score))[:k]
                        best_score, best_id = best_score[first], best_id[first]
                        if len(best_score) == k and best_score[-1] > bound:
                            bound = best_score[-1]
                            limit = reach * _squares(bound, norms[q], greatest)
                    if far[opened] > limit or opened == len(leaves):
                        break
                out.append((own, own_id, best_id, best_score))
        n = [len(x[2]) for x in out]
        return pa.table({"row": np.repeat(np.array([x[0] for x in out], np.int64), n), "query_id": np.repeat(np.array([x[1] for x in out], np.int64), n), "vec_id": np.concatenate([np.zeros(0, np.int64), *(x[2] for x in out)]), "score": np.concatenate([np.zeros(0), *(x[3] for x in out)])})

    return search


def _norms():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            width = max([1, *np.diff(batch.column("vector").offsets.to_numpy()).tolist()])
            vectors = matrix(batch.column("vector"), width)
            largest = np.abs(vectors).max(1, initial=0)
            norm = largest * np.linalg.norm(vectors / np.where(largest > 0, largest, 1)[:, None], axis=1)  # whose squares may be too large or small
            yield batch.append_column("norm", pa.array(norm)).append_column("width", pa.array(np.diff(batch.column("vector").offsets.to_numpy()).astype(np.int32)))

    return run


def nearest(rows: DataFrame, is_query: str, k: int = 20, confidence: float = CONFIDENCE) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of rows (vec_id, vector) where the SQL condition is_query holds, its k nearest among all other rows.

    Nearest is the largest inner product, ties go to the smaller vec_id; the score is the inner product in double precision. The
    stopping test misses a true neighbour with a probability of 1 - confidence at most. Rows with no vec_id, no vector, a zero
    or empty one or one with a null or non-finite component take no part; shorter vectors count as filled with zeros.
    Rows that repeat a vec_id are rows of their own, as queries and as neighbours. Fewer other rows than k are all returned; an
    empty table gives no rows. Other columns are ignored.
    """
    small_batches(rows.sparkSession)
    known = rows.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long"), F.col("vector").cast("array<double>"), F.coalesce(F.expr(is_query), F.lit(False)).alias("asks"))
    valid = known.where(F.col("vec_id").isNotNull() & finite("vector"))
    plain = valid.mapInArrow(_norms(), "row long, vec_id long, vector array<double>, asks boolean, norm double, width int").where("norm > 0")
    plain, seen = stored_counting(plain, "vectors", greatest=F.max("norm"), width=F.max("width"))
    if not seen.get("rows"):
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width, greatest, reach = seen["width"], seen["greatest"], chi_square_quantile(confidence, PROJECTED)
    schema = "row long, vec_id long, vector array<double>, asks boolean, norm double, width int, near array<double>"
    near = plain.mapInArrow(_projected(width, greatest, False), schema)
    sample = sampled(near.select("near"), seen["rows"], PROJECTED)
    cuts, _ = kd_cuts(matrix(sample["near"], PROJECTED), cells_wanted(seen["rows"], PROJECTED))
    in_cell, directory = in_cells(near.mapInArrow(_cell(cuts), f"{schema}, cell int"), "near", PROJECTED)
    asking = plain.where("asks").mapInArrow(_projected(width, greatest, True), schema)
    queries = asking.select("row", F.col("vec_id").alias("query_id"), "vector", "near", "norm", F.lit(None).cast("double").alias("bound"))
    bounded = lambda found: found.groupBy("row").agg(F.when(F.count("*") >= k, F.min("score")).alias("bound"))
    found = searched(queries, in_cell.select("row", "vec_id", "vector", "near", "cell", "part"), directory, _promise(greatest, reach), _search(width, k, greatest, reach), _FOUND, bounded, "nearest")
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op11_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(read(spark, sf_dir, "embeddings")).select("vec_id", F.col("embedding").alias("vector"))
    return nearest(rows, "vec_id % 20 = 0", 20)
