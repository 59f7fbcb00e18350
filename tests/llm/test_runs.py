"""Runs of words against a plain search of all periods."""

import hashlib
import random
import re
import time
import zlib

import pytest
from pyspark.sql import functions as F

WORD = re.compile("[^\x20\x09-\x0d]+")


def all_runs(words, least_periods=4, least_words=6):
    """(start, length, smallest period) of each maximal stretch, by trying all periods."""
    found, n = {}, len(words)
    for q in range(1, n // 2 + 1):
        i = q
        while i < n:
            if words[i] != words[i - q]:
                i += 1
                continue
            j = i
            while j < n and words[j] == words[j - q]:
                j += 1
            start, length = i - q, j - i + q
            if length >= 2 * q:
                found.setdefault((start, length), q)  # the smallest comes first
            i = j
    return sorted(((s, m, q) for (s, m), q in found.items() if m >= max(least_words, least_periods * q)), key=lambda r: (r[0], r[2]))


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return list(b[:n])


def digest(text):
    words = WORD.findall(text or "")
    runs = all_runs(words)
    gone = {k for s, m, q in runs for k in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-((r[1] * 10**12) // r[2]), r[0], r[2])) if runs else (None, None, None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join("%d,%d,%d\n" % r for r in runs)), sha(" ".join(w for k, w in enumerate(words) if k not in gone)))


def test_runs_of():
    from lodestone.llm.periodic_runs import runs_of

    rng = random.Random(3)
    cases = [[], [0], [0] * 2, [0] * 50, [0, 1] * 30, fibonacci(200), list(range(40)) * 5, ([0, 0, 0, 1] * 6 + [2]) * 5]
    cases += [[rng.randrange(k) for _ in range(rng.randrange(80))] for k in (1, 2, 2, 3, 5) for _ in range(60)]
    for _ in range(60):  # blocks, repeated at some places
        block = [rng.randrange(4) for _ in range(rng.randint(1, 9))]
        cases.append([rng.randrange(4) for _ in range(rng.randrange(9))] + block * rng.randint(2, 6) + block[: rng.randrange(len(block) + 1)] + [rng.randrange(4) for _ in range(9)])
    for words in cases:
        known = {w: k for k, w in enumerate(dict.fromkeys(words))}
        for periods, least in ((4, 6), (2, 2), (3, 1)):
            assert runs_of([known[w] for w in words], periods, least) == all_runs(words, periods, least), words


def test_periodic_runs(spark):
    from lodestone.llm.periodic_runs import _digest, periodic_runs

    rng = random.Random(5)
    texts = [None, "", " \n\t", "one", "a a a a a a", "a a a a a", "\x0ba\x0ca\x0da  a\ta\na ", "é é é é é é b c", "x y x y x y x y z", " ".join("abc" * 7)]
    texts += [" ".join(str(rng.randrange(k)) for _ in range(rng.randrange(200))) for k in (1, 2, 3, 30) for _ in range(12)]
    for _ in range(40):
        block = [rng.choice("abcdefgh") for _ in range(rng.randint(1, 30))]
        texts.append("  ".join([rng.choice("xyz") for _ in range(rng.randrange(20))] + block * rng.randint(3, 7) + block[: rng.randrange(len(block) + 1)] + [rng.choice("xyz") for _ in range(rng.randrange(20))]))
    texts += ["ab " * 3, " ".join(fibonacci(300))]
    rows = [(k, t, 7) for k, t in enumerate(texts)] + [(None, "a " * 9, 7), (4, texts[4], 7)]
    found = periodic_runs(spark.createDataFrame(rows, "doc_id long, text string, runs int")).select("*", _digest(F.col("collapsed")).alias("sha")).collect()
    assert len(found) == len(rows)
    for r, (i, t, _) in zip(sorted(found, key=lambda r: (r["doc_id"] is None, r["doc_id"])), sorted(rows, key=lambda r: (r[0] is None, r[0])), strict=True):
        words = WORD.findall(t or "")
        assert (r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["sha"]) == (i, len(words), all_runs(words), digest(t)[-1]), t
        assert (tuple(r["strongest"]) if r["strongest"] else (None,) * 3) == digest(t)[1:4]
    loose = periodic_runs(spark.createDataFrame(rows, "doc_id long, text string, runs int"), least_periods=2, least_words=2).where("doc_id is not null").collect()
    assert all([tuple(x) for x in r["runs"]] == all_runs(WORD.findall(texts[r["doc_id"]] or ""), 2, 2) for r in loose)
    assert periodic_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        periodic_runs(spark.createDataFrame(rows, "doc_id long, text string, runs int"), least_periods=1)


def test_long_text_takes_n_log_n():
    from lodestone.llm.periodic_runs import runs_of

    began = time.process_time()
    assert runs_of(list(range(25_000)) * 4) == [(0, 100_000, 25_000)]
    assert runs_of([0] * 100_000) == [(0, 100_000, 1)]
    assert time.process_time() - began < 20


def test_op12(spark, tmp_path):
    from lodestone.llm.periodic_runs import op12_periodic_runs

    rng = random.Random(8)
    rows = [(k, " ".join(rng.choice("abcdefghijkl") for _ in range(rng.randrange(120)))) for k in range(300)] + [(None, "a " * 8), (1000, None), (1001, " b" * 7)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    expected = set()
    for i, text in rows:
        words = WORD.findall(text or "")
        h = 1 if i is None else zlib.crc32(str(i).encode())
        if h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k if k < a else a + (k - a) % p] for k in range(n)]
        expected.add((i, *digest(" ".join(words))))
    found = op12_periodic_runs(spark, str(tmp_path))
    assert found.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert set(map(tuple, found.collect())) == expected
