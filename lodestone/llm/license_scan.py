"""Licence notices in texts by patience alignment.

A window of a text is aligned with a notice: words that are unique to both anchor them, the longest
increasing subsequence of anchors stays, and the gaps between anchors are aligned in the same way.
The aligned share of the notice's words is its coverage. A licence is named only if the words that tell
it from others (its name, version and variant) are aligned as well, and if its sentence doesn't deny it.
Tags of the form SPDX-License-Identifier name each licence of their expression.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.notices import all_notices, identifiers, titles
from lodestone.llm.stored import read, small_batches, spread

COVERAGE = 0.75
#: Around each hit of an anchor word a window of a notice's length either way is aligned; from this length on, hits within half of it share one.
LONG = 100

NOTICES = all_notices()
IDENTIFIERS = identifiers(list(NOTICES))
TITLES = titles(list(NOTICES))

_WORD = re.compile(r"\w+")
#: Words that are in too many texts to look for a form by them, if it has others.
_FREQUENT = {"clause", "license", "the"}
#: So many words before a notice may deny it ("not released under"), back to the end of a sentence or a word of contrast.
DENIES = 6
_DENIAL, _CONTRAST, _STRESS = {"cannot", "neither", "never", "nor", "not"}, {"but", "except", "however", "instead", "rather", "unless"}, {"just", "merely", "only"}
_SENTENCE = re.compile(r"[.!?;](?:\s|$)|\n\s*\n")
_TAG = re.compile(r"SPDX-License-Identifier:[ \t]*([A-Za-z0-9(][A-Za-z0-9.+() -]*)", re.IGNORECASE)


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _increasing(anchors: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of anchors, which are in order of their first place, whose second places increase."""
    tails: list[int] = []
    ends: list[int] = []
    before: list[int] = []
    for k, (_, y) in enumerate(anchors):
        at = bisect_left(tails, y)
        before.append(ends[at - 1] if at else -1)
        tails[at:] = [y, *tails[at + 1 :]]
        ends[at:] = [k, *ends[at + 1 :]]
    found, k = [], ends[-1] if ends else -1
    while k >= 0:
        found.append(anchors[k])
        k = before[k]
    return found[::-1]


def patience(text: list[str], notice: list[str]) -> list[tuple[int, int]]:
    """Aligned places (in the text, in the notice), both increasing."""
    found, gaps = [], [(0, len(text), 0, len(notice))]
    while gaps:
        a, b, x, y = gaps.pop()
        while a < b and x < y and text[a] == notice[x]:
            found.append((a, x))
            a, x = a + 1, x + 1
        while a < b and x < y and text[b - 1] == notice[y - 1]:
            b, y = b - 1, y - 1
            found.append((b, y))
        if a >= b or x >= y:
            continue
        here, there = Counter(text[a:b]), Counter(notice[x:y])
        place = {w: k for k, w in enumerate(notice[x:y], x) if there[w] == 1}
        anchors = _increasing([(k, place[w]) for k, w in enumerate(text[a:b], a) if here[w] == 1 and w in place])
        if not anchors:
            continue
        found += anchors
        for (a1, x1), (a2, x2) in zip([(a - 1, x - 1), *anchors], [*anchors, (b, y)], strict=True):
            gaps.append((a1 + 1, a2, x1 + 1, x2))
    return sorted(found)


@dataclass
class Form:
    name: str
    words: list[str]
    needed: Counter
    anchors: list[str]  # each text that has enough of the form has one of them
    must: list[tuple[int, bool]]  # places that must be aligned, and whether right after the place before


def forms_of(notices: dict[str, list[str]], coverage: float) -> list[Form]:
    found = []
    for name, forms in notices.items():
        for form in forms:
            marked = re.findall(r"[*+]?\w+", form.lower())
            words = [w.lstrip("*+") for w in marked]
            must = [(k, w[0] == "+") for k, w in enumerate(marked) if w[0] in "*+"]
            needed = Counter(words)
            anchors = [max((words[k] for k, _ in must), key=lambda w: (w not in _FREQUENT, len(w)))] if must else []
            missed = 0
            # without such words: the longest ones, until a text without all of them has too few of the form's words
            for w in [] if must else sorted(needed, key=lambda w: (-len(w), w)):
                if missed > len(words) - math.ceil(coverage * len(words)):
                    break
                anchors.append(w)
                missed += needed[w]
            found.append(Form(name, words, needed, anchors, must))
    return found


def denied(text: str, words: list[str], starts: list[int], at: int) -> bool:
    """Whether a word before the notice that begins with word `at` denies it. text: lowered; starts: where its words begin."""
    for k in range(at - 1, max(-1, at - 1 - DENIES), -1):
        w = words[k]
        if w in _CONTRAST or _SENTENCE.search(text, starts[k] + len(w), starts[k + 1]):
            return False
        if w in _DENIAL and words[k + 1] not in _STRESS or (w, words[k + 1]) == ("no", "longer") or w == "t" and k and words[k - 1].endswith("n"):
            return True
    return False


def tags(text: str, names: list[str]) -> tuple[list[tuple[str, float, int, int]], list[str]]:
    """What tags state: like the result of scan for each licence of `names` in an expression, and the expressions, each once.

    An expression goes on as long as identifiers and AND, OR or WITH, in capitals, alternate. "X-only", "X-or-later" and
    "X+" name X-only and X-or-later; an exception after WITH names no licence.
    """
    known = {name.lower(): name for name in names}
    found: dict[str, tuple[float, int, int]] = {}
    expressions: dict[str, None] = {}
    word = place = 0
    for m in _TAG.finditer(text):
        word += len(_WORD.findall(text, place, m.start()))
        place = m.start()
        taken: list[str] = []
        for part in re.findall(r"[()]|[A-Za-z0-9.+-]+", m[1]):
            joins = part in ("AND", "OR", "WITH")
            last = next((t for t in reversed(taken) if t not in "()"), "AND")
            if part not in "()" and joins == (last in ("AND", "OR", "WITH")):
                break
            taken.append(part)
            plain, _, variant = re.sub(r"\+$", "-or-later", part.rstrip(".-").lower()).partition("-o")
            if not joins and last != "WITH" and plain in known and variant in ("", "nly", "r-later"):
                name = known[plain] + ("-o" + variant if variant else "")
                found.setdefault(name, (1.0, 3 + len(_WORD.findall(name)), word))
        while taken and taken[-1] in ("AND", "OR", "WITH", "("):
            taken.pop()
        if taken:
            expressions[" ".join(taken).rstrip(".-").replace("( ", "(").replace(" )", ")")] = None
    return [(name, *rest) for name, rest in found.items()], list(expressions)


def _ordered(found: list[tuple[str, float, int, int]]) -> list[tuple[str, float, int, int]]:
    """Each licence once, the best first; one that is also found as -only or -or-later goes."""
    best: dict[str, tuple[float, int, int]] = {}
    for name, share, n, at in found:
        best[name] = max(best.get(name, (0.0, 0, 0)), (share, n, -at))
    return sorted(((name, share, n, -at) for name, (share, n, at) in best.items() if f"{name}-only" not in best and f"{name}-or-later" not in best), key=lambda r: (-r[1], -r[2], r[0]))


def scan(text: str, forms: list[Form], coverage: float = COVERAGE) -> list[tuple[str, float, int, int]]:
    """(licence, coverage, aligned words, first aligned word) of each licence with a notice that is covered and not denied, best first."""
    text = text.lower()
    words = words_of(text)
    starts: list[int] = []
    hits: dict[str, list[int]] = {w: [] for form in forms for w in form.anchors}
    for k, w in enumerate(words):
        if w in hits:
            hits[w].append(k)
    if not any(hits.values()):
        return []
    has = set(words)
    best: dict[str, tuple[float, int, int]] = {}
    for form in forms:
        n, last, until = len(form.words), -1, -1
        if len(words) < coverage * n or any(form.words[k] not in has for k, _ in form.must):
            continue
        for k in sorted(h for w in form.anchors for h in hits[w]):
            if k < until:
                continue
            beyond = n // 2 if n >= LONG else 0
            until = k + beyond
            a, b = max(0, k - n), min(len(words), k + n + 1 + beyond)
            if b <= last:
                continue
            last = b
            if (Counter(words[a:b]) & form.needed).total() < coverage * n:
                continue
            aligned = patience(words[a:b], form.words)
            if len(aligned) < coverage * n:
                continue
            place = {x: y for y, x in aligned}
            if not all(x in place and (not after or place.get(x - 1) == place[x] - 1) for x, after in form.must):
                continue
            starts = starts or [m.start() for m in _WORD.finditer(text)]
            if not denied(text, words, starts, a + aligned[0][0]):
                best[form.name] = max(best.get(form.name, (0.0, 0, 0)), (len(aligned) / n, len(aligned), -(a + aligned[0][0])))
    return _ordered([(name, share, n, -at) for name, (share, n, at) in best.items()])


def _scanned(notices: dict[str, list[str]] | None, coverage: float):
    tables = [notices] if notices else [NOTICES, IDENTIFIERS, TITLES]
    forms = [form for table in tables for form in forms_of(table, coverage)]
    names = [] if notices else list(IDENTIFIERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            stated = [tags(t, names) for t in texts]
            found = [_ordered(scan(t, forms, coverage) + named) for t, (named, _) in zip(texts, stated, strict=True)]
            best = [f[0] if f else (None, 0.0, 0, None) for f in found]
            columns = {
                "license": pa.array([b[0] for b in best], pa.string()),
                "coverage": pa.array([b[1] for b in best], pa.float64()),
                "n_aligned": pa.array([b[2] for b in best], pa.int64()),
                "first_word": pa.array([b[3] for b in best], pa.int64()),
                "licenses": pa.array([[f[0] for f in x] for x in found], pa.list_(pa.string())),
                "expressions": pa.array([e for _, e in stated], pa.list_(pa.string())),
            }
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns.values()], ["doc_id", *columns])

    return run


def license_scan(docs: DataFrame, notices: dict[str, list[str]] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, license, coverage, n_aligned, first_word, licenses, expressions for each row of docs (doc_id, text); other columns are ignored.

    license is the best covered one, of equal ones the one with more aligned words, then the smaller name;
    null with coverage 0 if no notice has `coverage` of its words aligned, as for null and empty texts.
    licenses has all that are covered, expressions what SPDX tags state ("MIT OR Apache-2.0"). A notice that its sentence
    denies ("not released under") isn't one. Texts are read whole; repeated rows get equal answers.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scanned(notices, coverage), "doc_id long, license string, coverage double, n_aligned long, first_word long, licenses array<string>, expressions array<string>")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(spread(read(spark, sf_dir, "documents")))
