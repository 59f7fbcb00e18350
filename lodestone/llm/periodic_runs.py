"""Stretches of consecutive words that repeat with a period, found by a suffix automaton with link-cut access.

A run with period q has every word equal to the one q before it, and no neighbour extends it. Each text is
read whole. Appending word i to the automaton makes its prefix's state; the access of that state in the tree
of suffix links walks the segments of its path to the root, each of which holds suffixes that ended last
at one earlier word e, up to a length L. If i - e <= L, a square of period i - e ends at i: the run
begins where its first square does and is followed to its end. The access recolours the path with i.
The last occurrence makes i - e the smallest period, so each run is found once, when its first square ends.

Only windows that can hold a run with the asked exponent come to the automaton: inside such a run, after its
first q words, all words occurred at most q words before. For each power of two that bounds q, stretches
of such words that are long enough, with what lies before them, are the windows; no run is cut by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.stored import read, small_batches, spread
from lodestone.llm.text_arrays import SPACE, slices, word_hashes, word_spans

#: A run counts from this many periods and this many words on.
LEAST_PERIODS, LEAST_WORDS = 4, 6
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, strongest struct<start: long, length: long, period: long>, collapsed string"


def suffix_automaton(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Suffix links (-1 for the root, state 0), lengths of the longest strings of the states, and the state of each prefix.

    Most states have one transition, which is kept in two lists; the further ones are in a dictionary.
    """
    link, length, word, to, more, prefixes = [-1], [0], [-1], [0], [None], []
    last = 0
    for w in words:
        new, p = len(link), last
        link.append(0)
        length.append(length[last] + 1)
        word.append(-1)
        to.append(0)
        more.append(None)
        prefixes.append(new)
        last, q = new, -1
        while p >= 0:
            if word[p] == w:
                q = to[p]
                break
            others = more[p]
            if others is not None and w in others:
                q = others[w]
                break
            if word[p] < 0:
                word[p], to[p] = w, new
            elif others is None:
                more[p] = {w: new}
            else:
                others[w] = new
            p = link[p]
        if q < 0:
            continue
        if length[q] == length[p] + 1:
            link[new] = q
            continue
        clone = len(link)
        link.append(link[q])
        length.append(length[p] + 1)
        word.append(word[q])
        to.append(to[q])
        more.append(None if more[q] is None else dict(more[q]))
        link[q] = link[new] = clone
        while p >= 0:
            if word[p] == w:
                if to[p] != q:
                    break
                to[p] = clone
            elif more[p] is not None and more[p].get(w) == q:
                more[p][w] = clone
            else:
                break
            p = link[p]
    return link, length, prefixes


class LastOccurrences:
    """A link-cut forest over a tree, each preferred path (a splay tree by depth) with one colour: the last access that took it."""

    def __init__(self, parents: list[int]):
        self.up, self.left, self.right = list(parents), [-1] * len(parents), [-1] * len(parents)
        self.colour = [-1] * len(parents)  # holds at the root of a path's splay tree

    def _rotate(self, x: int) -> None:
        up, left, right = self.up, self.left, self.right
        y = up[x]
        z = up[y]
        if z >= 0:
            if left[z] == y:
                left[z] = x
            elif right[z] == y:
                right[z] = x
        if left[y] == x:
            inner = left[y] = right[x]
            right[x] = y
        else:
            inner = right[y] = left[x]
            left[x] = y
        if inner >= 0:
            up[inner] = y
        up[y], up[x] = x, z

    def _splay(self, x: int) -> None:
        up, left, right = self.up, self.left, self.right
        while (y := up[x]) >= 0 and (left[y] == x or right[y] == x):
            z = up[y]
            if z < 0 or (left[z] != y and right[z] != y):
                self.colour[x] = self.colour[y]
                self._rotate(x)
                return
            self.colour[x] = self.colour[z]
            self._rotate(y if (left[z] == y) == (left[y] == x) else x)
            self._rotate(x)

    def access(self, node: int, colour: int) -> Iterator[tuple[int, int]]:
        """(deepest node, colour before) of each segment of the path from the node to the root, which then has the new colour."""
        below, u = -1, node
        while u >= 0:
            if (y := self.up[u]) >= 0 and (self.left[y] == u or self.right[y] == u):
                self._splay(u)
            before, cut = self.colour[u], self.right[u]
            if cut >= 0:
                self.colour[cut] = before
            yield u, before
            self.right[u] = below
            below, u = u, self.up[u]
        self.colour[below] = colour


def runs_of(words: list[int], least_periods: int = LEAST_PERIODS, least_words: int = LEAST_WORDS) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of at least `least_periods` (2 or more) periods and `least_words` words, by start, then period."""
    link, length, prefixes = suffix_automaton(words)
    seen, found, n = LastOccurrences(link), [], len(words)
    ends: dict[int, int] = {}  # of the last run of each period
    for i, state in enumerate(prefixes):
        for node, before in seen.access(state, i):
            period = i - before
            if before < 0 or period > length[node] or ends.get(period, 0) > i:
                continue
            end = i + 1
            while end < n and words[end] == words[end - period]:
                end += 1
            ends[period] = end
            start = i - 2 * period + 1
            if end - start >= max(least_words, least_periods * period):
                found.append((start, end - start, period))
    return sorted(found, key=lambda r: (r[0], r[2]))


def _windows(hashes: np.ndarray, first: np.ndarray, least_periods: int, least_words: int) -> Iterator[tuple[int, int]]:
    """(from, to) of the parts of the words that can hold runs, apart from each other and each within one text."""
    n = len(hashes)
    if not n:
        return
    order = np.argsort(hashes, kind="stable")
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    same = (hashes[order[1:]] == hashes[order[:-1]]) & (text[order[1:]] == text[order[:-1]])
    distance = np.full(n, n + 1)
    distance[order[1:][same]] = (order[1:] - order[:-1])[same]
    starts, ends, bound = [], [], 1
    longest = int(np.diff(first).max())
    while bound * least_periods <= longest:  # periods from bound to 2 * bound - 1
        near = np.zeros(n + 2, np.int8)
        near[1:-1] = distance < 2 * bound
        edges = np.flatnonzero(near[1:] != near[:-1])
        a, b = edges[::2], edges[1::2]
        enough = b - a >= max((least_periods - 1) * bound, least_words - 2 * bound + 1)
        starts.append(np.maximum(a[enough] - 2 * bound + 1, first[text[a[enough]]]))
        ends.append(b[enough])
        bound *= 2
    if not starts:
        return
    a, b = np.concatenate(starts), np.concatenate(ends)
    order = np.argsort(a, kind="stable")
    at = until = -1
    for x, y in zip(a[order].tolist(), b[order].tolist(), strict=True):
        if x >= until:
            if until > 0:
                yield at, until
            at, until = x, y
        else:
            until = max(until, y)
    if until > 0:
        yield at, until


def _found(least_periods: int, least_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in slices(batch.column("text")):
                starts, ends, first = word_spans(data, offsets)
                hashes = word_hashes(data, starts, ends, lower=False)
                runs: list[list[tuple[int, int, int]]] = [[] for _ in range(len(offsets) - 1)]
                kept = np.ones(len(starts), bool)
                for a, b in _windows(hashes, first, least_periods, least_words):
                    text = int(np.searchsorted(first, a, "right")) - 1
                    for at, length, period in runs_of(np.unique(hashes[a:b], return_inverse=True)[1].tolist(), least_periods, least_words):
                        runs[text].append((a + at - int(first[text]), length, period))
                        kept[a + at + period : a + at + length] = False
                # whole quotients with 64 further bits tell any two exponents apart
                strongest = [min(r, key=lambda x: (-((x[1] << 64) // x[2]), x[0], x[2])) if r else None for r in runs]
                # kept words with one space behind each but the last one of its text
                word = np.flatnonzero(kept)
                last = np.ones(len(word), bool)
                text = np.searchsorted(first, word, "right")
                last[:-1] = text[1:] != text[:-1]
                inside = np.zeros(len(data) + 1, np.int8)
                inside[starts[word]] += 1
                inside[ends[word] + ~last] -= 1
                stays = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
                at = np.concatenate([[0], np.cumsum(stays)])[offsets].astype(np.int32)
                collapsed = pa.StringArray.from_buffers(len(runs), pa.py_buffer(at.tobytes()), pa.py_buffer(np.where(SPACE[data], 32, data)[stays].astype(np.uint8).tobytes()))
                columns = [
                    batch.column("doc_id").slice(row, len(runs)),
                    pa.array(np.diff(first)),
                    pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in x] for x in runs], pa.list_(_RUN)),
                    pa.array([r and dict(zip(("start", "length", "period"), r, strict=True)) for r in strongest], _RUN),
                    collapsed,
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "strongest", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, least_periods: int = LEAST_PERIODS, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, n_words, runs (start, length, period), strongest and collapsed of each row of docs (doc_id, text); other columns are ignored.

    Words are numbered from 0. strongest is the run with the greatest exact length / period, of equal ones the first by start, then
    period; null without runs. collapsed is the text without what runs repeat: of each run the first period stays, kept
    words are joined by one space. A null or empty text has no words, no runs and an empty collapsed text. Repeated rows and
    rows without doc_id each have their answer; texts of any length are read whole; an empty table gives no rows.
    Words are compared by 64-bit hashes.
    """
    if least_periods < 2:
        raise ValueError("a run has two periods at least")
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(_found(least_periods, least_words), SCHEMA)


def with_planted_period(docs: DataFrame) -> DataFrame:
    """(doc_id, text): with h = crc32(doc_id as text) and g = h / 10, where h % 10 = 0 the words from g % n on repeat with period 1 + (n - g % n) / (3 + g % 8); the other texts stay."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split("text", "[ \\t-\\r]+"), lambda w: w != "")
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumns({"g": F.floor(h / 10), "words": F.when(h % 10 == 0, words)})
    n = F.size("words")
    rows = rows.withColumn("a", F.when(n > 0, (F.col("g") % n).cast("int")))
    rows = rows.withColumn("p", (1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    times = F.ceil((n - F.col("a")) / F.col("p")).cast("int")
    repeated = F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), times))
    whole = F.slice(F.concat(F.slice("words", F.lit(1), F.col("a")), repeated), F.lit(1), n)
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(whole, " ")).otherwise(F.col("text")).alias("text"))


def _digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_planted_period(spread(read(spark, sf_dir, "documents"))))
    lines = F.transform("runs", lambda r: F.concat(r.start.cast("string"), F.lit(","), r.length.cast("string"), F.lit(","), r.period.cast("string"), F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "strongest.*",
        F.floor(1000 * F.col("strongest.length") / F.col("strongest.period")).alias("exponent_milli"),
        _digest(F.array_join(lines, "")).alias("runs_sha256"),
        _digest(F.col("collapsed")).alias("collapsed_sha256"),
    )
