"""Codes within a few bits of each other against all pairs, and fingerprints of sets."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import near
from lodestone.sources import tables


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


@pytest.mark.parametrize("hot", [500, 3])
def test_near_codes(spark, hot, monkeypatch):
    monkeypatch.setattr(near, "HOT", hot)
    rng, codes = random.Random(hot), []
    centres = [rng.getrandbits(64) for _ in range(12)]
    for _ in range(260):
        code = rng.choice(centres)
        for _ in range(rng.randint(0, 4)):
            code ^= 1 << rng.choice([rng.randrange(64), rng.randrange(5), 63])
        codes.append(signed(code))
    rows = [(k, c, rng.choice(["x", "y", None])) for k, c in enumerate(codes)] + [(900 + k, codes[0], "x") for k in range(40)] + [(990, None, "x"), (None, codes[1], "x")]
    frame = spark.createDataFrame(rows, "k long, c long, g string")
    for most, bits, group in ((3, 64, "g"), (1, 64, None), (2, 20, "g")):
        least = {}
        for k, c, g in rows:
            if k is not None and c is not None:
                key = (g if group else 0, c)
                least[key] = min(k, least.get(key, k))
        expected = sorted((str(g), a, b, d) for (g, x), a in least.items() for (h, y), b in least.items() if g == h and x < y and (d := ((x ^ y) & ((1 << bits) - 1)).bit_count()) <= most)
        found = near.near_codes(frame, "c", "k", group, most, bits)
        assert sorted((str(r["within"]), r["a"], r["b"], r["distance"]) for r in found.collect()) == expected and expected
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert near.different_codes(frame, "c", "k").where(F.col("code") == codes[0]).first()["copies"] >= 41
    assert near.near_codes(frame.limit(0), "c", "k").count() == 0
    with pytest.raises(ValueError):
        near.near_codes(frame, "c", "k", most=0)


def test_set_fingerprint(spark):
    make = lambda values: tables.set_fingerprint(spark.createDataFrame([(v,) for v in values], "p string").repartition(3), F.col("p"))
    values = [f"p{k}" for k in range(500)]
    assert make(values) == make(values[::-1]) and len({make(v) for v in (values, values[:-1], [*values, "p0"], [*values[:-1], "q"], [*values, None], [])}) == 6
    assert make([]) == make([]) and make([]).startswith("0:")
