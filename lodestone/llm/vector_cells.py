"""Vectors dealt into cells of space that searches visit in blocks of queries.

Cuts are fitted on a bounded sample, every row is placed by them. A cell with more rows than CELL_ROWS, as of
one vector that most rows have, is several parts by a hash of the row. The directory of the cells, with the bounds of
their rows, is of bounded size. A search has two rounds: each query first visits the cell that promises most, then all
cells that can still hold something better than what it found there.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.stored import broadcast_if_small, stored, stored_counting

#: Rows, more or less, that cuts are fitted on, and bytes of their values.
SAMPLE, SAMPLE_BYTES = 20_000, 16 << 20
#: Rows of a cell's part, and queries that meet it in one task.
CELL_ROWS, SLICE_QUERIES = 2_048, 4_096
#: Cells at least, if there are so many rows, and bytes of the directory's bounds at most.
LEAST_CELLS, DIRECTORY_BYTES = 16, 16 << 20
#: Queries that are held against the directory at once.
ASKED_AT_ONCE = 256

#: A tree of cuts: the dimension, the values at which it is cut, and what is in each part; a cell is its number.
Cuts = tuple[int, np.ndarray, list] | int


def finite(vector: str) -> Column:
    """Whether a vector and all its components are there and finite."""
    return F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """The lists of numbers as rows; short ones are filled with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy()[offsets[0] : offsets[-1]]
    lengths = np.diff(offsets)
    if (lengths == width).all():
        return values.reshape(-1, width)
    out = np.zeros((len(lengths), width))
    out[np.arange(width) < lengths[:, None]] = values
    return out


def lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(np.ascontiguousarray(rows, np.float64).ravel()))


def cells_wanted(rows: int, width: int) -> int:
    return max(1, min(max(rows // CELL_ROWS, LEAST_CELLS), rows, DIRECTORY_BYTES // (16 * max(1, width))))


def sampled(rows: DataFrame, n: int, width: int) -> pa.Table:
    """About as many of n rows as the bounds allow, for vectors of a width."""
    return rows.sample(min(1.0, min(SAMPLE, SAMPLE_BYTES // (8 * max(1, width))) / max(1, n)), 20240501).toArrow()


def kd_cuts(values: np.ndarray, cells: int) -> tuple[Cuts, int]:
    """A tree that halves the values at the median of their widest dimension until there are so many cells; also their number."""
    made = 0

    def cut(rows: np.ndarray, wanted: int) -> Cuts:
        nonlocal made
        spread = np.ptp(rows, axis=0) if len(rows) else np.zeros(1)
        if wanted < 2 or not spread.any():
            made += 1
            return made - 1
        dimension = int(spread.argmax())
        own = rows[:, dimension]
        at = np.median(own)
        at = at if (own < at).any() else own[own > at].min()
        return dimension, np.array([at]), [cut(rows[own < at], wanted // 2), cut(rows[own >= at], wanted - wanted // 2)]

    return cut(values, cells), made


def str_cuts(values: np.ndarray, cells: int, dimensions: list[int], first: int = 0) -> tuple[Cuts, int]:
    """Sort-tile-recursive: slabs of equal counts along one dimension after the other, until there are so many cells; also the number after the last cell."""
    made = first

    def cut(rows: np.ndarray, wanted: int, left: list[int]) -> Cuts:
        nonlocal made
        if wanted < 2 or not left or len(rows) < 2:
            made += 1
            return made - 1
        slabs = slab_count(wanted, len(left))
        own = np.sort(rows[:, left[0]])
        at = np.unique(own[[k * len(own) // slabs for k in range(1, slabs)]])
        which = np.searchsorted(at, rows[:, left[0]], "right")
        return left[0], at, [cut(rows[which == k], math.ceil(wanted / slabs), left[1:]) for k in range(len(at) + 1)]

    return cut(values, cells, dimensions), made


def slab_count(tiles: int, dimensions: int) -> int:
    """The least number of slabs a dimension that makes so many tiles."""
    return min(tiles, max(2, math.ceil(tiles ** (1 / dimensions) - 1e-9)))


def placed(cuts: Cuts, values: np.ndarray) -> np.ndarray:
    """The cell of each row."""
    out = np.zeros(len(values), np.int32)

    def place(cuts: Cuts, rows: np.ndarray) -> None:
        if isinstance(cuts, int):
            out[rows] = cuts
            return
        dimension, at, parts = cuts
        which = np.searchsorted(at, values[rows, dimension], "right")
        for k, part in enumerate(parts):
            place(part, rows[which == k])

    place(cuts, np.arange(len(values)))
    return out


@dataclass
class Directory:
    """The cells that have rows: number, parts, least and greatest value of each dimension."""

    cell: np.ndarray
    parts: np.ndarray
    low: np.ndarray
    high: np.ndarray


def _bounds(column: str, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            cells, values = batch.column("cell").to_numpy(), matrix(batch.column(column), width)
            for cell in np.unique(cells).tolist():
                own = values[cells == cell]
                n, low, high = found.get(cell, (0, np.inf, -np.inf))
                found[cell] = (n + len(own), np.minimum(low, own.min(0)), np.maximum(high, own.max(0)))
        for cell, (n, low, high) in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([cell], pa.int32()), pa.array([n]), lists(low[None]), lists(high[None])], ["cell", "n", "low", "high"])

    return run


def _bounds_of_cell(width: int):
    def run(table: pa.Table) -> pa.Table:
        return pa.table({"cell": table["cell"][:1], "n": [table["n"].to_numpy().sum()], "low": lists(matrix(table["low"], width).min(0)[None]), "high": lists(matrix(table["high"], width).max(0)[None])})

    return run


def in_cells(rows: DataFrame, column: str, width: int) -> tuple[DataFrame, Directory]:
    """rows (row, cell, ...) with part, and the directory with the bounds of `column` (lists of `width`). The cuts have bounded the number of cells."""
    schema = "cell int, n long, low array<double>, high array<double>"
    each = rows.select("cell", column).mapInArrow(_bounds(column, width), schema).groupBy("cell").applyInArrow(_bounds_of_cell(width), schema)
    found = each.orderBy("cell").collect()  # a row for each cell
    directory = Directory(np.array([r["cell"] for r in found], np.int32), np.array([-(-r["n"] // CELL_ROWS) for r in found], np.int32), np.array([r["low"] for r in found]).reshape(-1, width), np.array([r["high"] for r in found]).reshape(-1, width))
    parts = rows.sparkSession.createDataFrame([(int(c), int(p)) for c, p in zip(directory.cell, directory.parts, strict=True) if p > 1], "cell int, parts int")
    part = F.coalesce(F.pmod(F.xxhash64("row"), F.col("parts")), F.lit(0)).cast("int")
    return rows.join(F.broadcast(parts), "cell", "left").withColumn("part", part).drop("parts"), directory


#: From a batch of queries: how much each cell of the directory promises to each query; minus infinity where it can hold nothing.
Promise = Callable[[pa.RecordBatch, Directory], np.ndarray]


def _first_visits(directory: Directory, promise: Promise):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, ASKED_AT_ONCE):
                batch = whole.slice(k, ASKED_AT_ONCE)
                promised = promise(batch, directory)
                best = promised.argmax(1)
                there = np.flatnonzero(promised[np.arange(len(best)), best] > -np.inf)
                best = best[there]
                part = batch.column("row").to_numpy()[there] % directory.parts[best]
                yield _visits(batch, there, directory.cell[best], part)

    return run


def _other_visits(directory: Directory, promise: Promise):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, ASKED_AT_ONCE):
                batch = whole.slice(k, ASKED_AT_ONCE)
                query, at = np.nonzero(promise(batch, directory) > -np.inf)
                parts = directory.parts[at].astype(np.int64)
                query, at = np.repeat(query, parts), np.repeat(at, parts)
                part = np.arange(len(at)) - np.repeat(np.cumsum(parts) - parts, parts)
                seen_cell, seen_part = (np.asarray(batch.column(c).fill_null(-1))[query] for c in ("seen_cell", "seen_part"))
                new = (directory.cell[at] != seen_cell) | (part != seen_part)
                yield _visits(batch, query[new], directory.cell[at[new]], part[new])

    return run


def _visits(batch: pa.RecordBatch, query: np.ndarray, cell: np.ndarray, part: np.ndarray) -> pa.RecordBatch:
    kept = batch.take(pa.array(query))
    names = [c for c in batch.schema.names if c not in ("seen_cell", "seen_part")]
    return pa.RecordBatch.from_arrays([*(kept.column(c) for c in names), pa.array(cell.astype(np.int32)), pa.array(part.astype(np.int32))], [*names, "cell", "part"])


def _met(queries: DataFrame, n_queries: int, rows: DataFrame, visits, search, schema: str, name: str) -> tuple[DataFrame, DataFrame]:
    """(visits, what the search found): every part of a cell meets the queries that visit it, in slices of SLICE_QUERIES or so."""
    visited = [c for c in queries.schema if c.name not in ("seen_cell", "seen_part")]
    visit_schema = ", ".join([*(f"{c.name} {c.dataType.simpleString()}" for c in visited), "cell int, part int"])
    slices = F.pmod(F.xxhash64("row"), F.lit(max(1, n_queries // SLICE_QUERIES))).cast("int")
    asked = stored(queries.mapInArrow(visits, visit_schema).withColumn("slice", slices), f"{name}-visits")
    met = rows.join(broadcast_if_small(asked.select("cell", "part", "slice").distinct()), ["cell", "part"])
    keys = ["cell", "part", "slice"]
    asked_side, met_side = (side.select(*[F.col(c).alias(c) for c in side.columns]) for side in (asked, met))  # new names, as both may come from one table
    return asked, asked_side.groupBy(*keys).cogroup(met_side.groupBy(*keys)).applyInArrow(search, schema)


def searched(queries: DataFrame, rows: DataFrame, directory: Directory, promise: Promise, search, schema: str, bounded: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """What a search finds for queries (row, ...) among rows (row, cell, part, ...), in two rounds.

    search(queries, rows) gets the queries of one slice and the rows of one part of a cell as tables. bounded(found) gives what the
    second round has to beat: a row for each query (row, ...), whose columns replace those of `queries` of the same name.
    """
    if not len(directory.cell):
        return queries.sparkSession.createDataFrame([], schema)
    queries, counted = stored_counting(queries, f"{name}-queries")
    n_queries = counted.get("rows", 0)
    asked, first = _met(queries, n_queries, rows, _first_visits(directory, promise), search, schema, f"{name}-first")
    first = stored(first, f"{name}-found-first")
    limits = bounded(first)
    seen = asked.select("row", F.col("cell").alias("seen_cell"), F.col("part").alias("seen_part"))
    kept = [c for c in queries.columns if c == "row" or c not in limits.columns]
    again = queries.select(*kept).join(limits, "row", "left").join(seen, "row", "left").select(*queries.columns, "seen_cell", "seen_part")
    _, other = _met(again, n_queries, rows, _other_visits(directory, promise), search, schema, f"{name}-other")
    return first.unionByName(other)
