"""How well a query fits a name as an abbreviation: a local alignment with affine gaps, in Arrow batches, best ones alone.

All letters of the query are matched in order. A match gives MATCH, WORD_START more at a word's beginning and NEXT more right behind the
one before; a gap costs OPEN and MORE for each further letter; what is before the first match and behind the last one is free.
The matrix of a block of names is filled a letter of the query at a time: the best way over a gap is a running maximum.

A name can't have more than all matches in a row at as many word beginnings as have letters of the query. Names come in descending order
of this bound, and the ones under what the k-th best has are not aligned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MATCH, WORD_START, NEXT, OPEN, MORE = 16, 8, 4, 3, 1
#: Letters that are aligned at once.
CELLS = 1 << 20
_NONE = -(1 << 30)


def _codes(names: list[str]) -> np.ndarray:
    """Code points of the names as rows, 0 behind their ends."""
    lengths = np.array([len(n) for n in names])
    out = np.zeros((len(names), max(1, int(lengths.max(initial=0)))), np.uint32)
    out[np.arange(out.shape[1]) < lengths[:, None]] = np.frombuffer("".join(names).encode("utf-32-le", "surrogatepass"), np.uint32)
    return out


def _starts(names: list[str], codes: np.ndarray) -> np.ndarray:
    """Whether a word begins at a letter: at the first one and behind what is neither letter nor digit."""
    inside = np.zeros(codes.shape, bool)
    inside[codes > 0] = np.array([c.isalnum() for n in names for c in n if c != "\0"], bool) if (codes > 0).any() else []
    starts = np.ones(codes.shape, bool)
    starts[:, 1:] = ~inside[:, :-1]
    return starts & (codes > 0)


def alignment_scores(names: list[str], query: str) -> np.ndarray:
    """The best score of the query in each name; -1 where it isn't a subsequence, as for an empty query."""
    if not names or not query:
        return np.full(len(names), -1)
    codes = _codes(names)
    gain = MATCH + WORD_START * _starts(names, codes)
    at = np.arange(codes.shape[1])
    best = gap = None
    for letter in query:
        own = gain.astype(np.int64)
        if best is not None:
            before = np.full(own.shape, _NONE)
            before[:, 1:] = np.maximum(best[:, :-1] + NEXT, gap[:, :-1])
            own = own + before
        best = np.where((codes == ord(letter)) & (own > 0), own, _NONE)
        gap = np.full(own.shape, _NONE)
        gap[:, 1:] = np.maximum.accumulate(best + MORE * at, axis=1)[:, :-1] - OPEN - MORE * (at[1:] - 1)
    found = best.max(axis=1)
    return np.where(found > 0, found, -1)


def _bounds(names: list[str], query: str) -> np.ndarray:
    """What no alignment of the query exceeds, from the word beginnings with letters of the query."""
    codes = _codes(names)
    starts = (_starts(names, codes) & np.isin(codes, [ord(c) for c in query])).sum(axis=1)
    return len(query) * MATCH + (len(query) - 1) * NEXT + WORD_START * np.minimum(starts, len(query))


def _best_of(query: str, most: int, column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None
        for batch in batches:
            names = [n or "" for n in batch.column(column).to_pylist()]
            lowest = -1 if kept is None or kept.num_rows < most else kept["score"].to_numpy().min()
            scores = np.full(len(names), -1)
            for block in _blocks(names):
                own = [names[k] for k in block]
                bound = _bounds(own, query)
                order = np.argsort(-bound, kind="stable")
                for a in range(0, len(order), 256):
                    part = order[a : a + 256]
                    part = part[bound[part] >= lowest]
                    if not len(part):
                        break
                    scores[block[part]] = alignment_scores([own[k] for k in part], query)
                    done = scores[scores >= 0]
                    if len(done) >= most:
                        lowest = max(lowest, np.partition(done, len(done) - most)[len(done) - most])
            there = np.flatnonzero(scores >= max(lowest, 0))
            new = pa.Table.from_batches([batch]).take(pa.array(there)).append_column("score", pa.array(scores[there].astype(np.int32)))
            kept = new if kept is None else pa.concat_tables([kept, new])
            if kept.num_rows > 4 * most:
                kept = _first(kept, most)
        if kept is not None:
            yield from _first(kept, most).to_batches()

    return run


def _blocks(names: list[str]) -> Iterator[np.ndarray]:
    """The names' numbers in groups of similar lengths, of CELLS letters or so."""
    lengths = np.array([len(n) for n in names])
    order = np.argsort(lengths, kind="stable")
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and (end + 1 - at) * lengths[order[end]] <= CELLS:
            end += 1
        yield order[at:end]
        at = end


def _first(table: pa.Table, most: int) -> pa.Table:
    """The rows that the `most`-th best score isn't above; ties at it all stay, as later columns order them."""
    scores = table["score"].to_numpy()
    if len(scores) <= most:
        return table
    lowest = np.partition(scores, len(scores) - most)[len(scores) - most]
    return table.filter(pa.array(scores >= lowest))


def aligned(entries: DataFrame, query: str, most: int, column: str = "name_lower", order: tuple[str, ...] = ("name_lower", "drive", "file_ref")) -> DataFrame:
    """The `most` entries whose name fits the query best, with score; ties in the given order. A null name is empty; a name fits if the query is a subsequence of it."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in entries.schema) + ", score int"
    return entries.mapInArrow(_best_of(query.lower(), most, column), schema).orderBy(F.desc("score"), *order).limit(most)
