"""Pairs of bit strings that differ in a few bits, by multi-index hashing.

Two hashes that differ in at most `most` bits are equal in one of most + 1 bands of bits. Rows meet by equality of a
band alone, and a pair counts in the first band that is equal, so none is found twice. A band's value that many different
hashes share is split by bands of the other bits, in the same way. Equal hashes are one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Different hashes with one value of a band from which it is split.
HOT = 500


def bands_of(bits: list[int], bands: int) -> list[list[int]]:
    """The bits dealt into so many runs of about equal length."""
    cuts = [k * len(bits) // bands for k in range(bands + 1)]
    return [bits[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def _mask(bits: list[int]) -> Column:
    value = sum(1 << b for b in bits)
    return F.lit(value - (1 << 64) if value >= 1 << 63 else value).cast("long")


def _value(code: Column, bits: list[int]) -> Column:
    return code.bitwiseAND(_mask(bits))


def _first_equal(a: Column, b: Column, bands: list[list[int]]) -> Column:
    found = F.lit(len(bands))
    for k in reversed(range(len(bands))):
        found = F.when(_value(a, bands[k]) == _value(b, bands[k]), k).otherwise(found)
    return found


def different_codes(rows: DataFrame, code: str, key: str, within: str | None = None) -> DataFrame:
    """(within, code, least, copies): each different code of each group, its smallest key and how many rows have it; rows without a code or a key are left out."""
    group = F.col(within) if within else F.lit(0)
    return rows.where(F.col(code).isNotNull() & F.col(key).isNotNull()).groupBy(group.alias("within"), F.col(code).cast("long").alias("code")).agg(F.min(key).alias("least"), F.count("*").alias("copies"))


def near_codes(rows: DataFrame, code: str, key: str, within: str | None = None, most: int = 3, bits: int = 64) -> DataFrame:
    """(within, a, b, distance): all pairs of different codes of one group that differ in at most `most` of the lowest `bits` bits, by the smallest keys of their rows, a's code below b's.

    Codes are longs; rows of one code are one (see different_codes for their number). A null group is a group.
    """
    if not 0 < most < bits <= 64:
        raise ValueError("at least one bit may differ, and not all")
    whole = list(range(bits))
    bands = bands_of(whole, most + 1)
    subs = [bands_of([b for b in whole if b not in band], most + 1) for band in bands]
    codes = different_codes(rows, code, key, within)
    placed = codes.select("within", "code", "least", F.posexplode(F.array(*[_value(F.col("code"), band) for band in bands])).alias("band", "value"))
    hot = placed.groupBy("within", "band", "value").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select(F.col("within").alias("_within"), F.col("band").alias("_band"), F.col("value").alias("_value"), F.lit(True).alias("hot"))
    marked = placed.join(hot, F.col("within").eqNullSafe(F.col("_within")) & (F.col("band") == F.col("_band")) & (F.col("value") == F.col("_value")), "left")
    whole_bucket = F.array(F.struct(F.lit(-1).alias("sub"), F.lit(0).cast("long").alias("part")))
    split = [F.array(*[F.struct(F.lit(k).alias("sub"), _value(F.col("code"), sub).alias("part")) for k, sub in enumerate(own)]) for own in subs]
    parts = F.when(F.col("hot"), F.coalesce(*[F.when(F.col("band") == k, s) for k, s in enumerate(split)])).otherwise(whole_bucket)
    keyed = marked.select("within", "code", "least", "band", "value", F.explode(parts).alias("p")).select("within", "code", "least", "band", "value", "p.sub", "p.part")
    a, b = keyed.alias("a"), keyed.alias("b")
    same = F.col("a.within").eqNullSafe(F.col("b.within"))
    for c in ("band", "value", "sub", "part"):
        same = same & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    x, y = F.col("a.code"), F.col("b.code")
    distance = F.bit_count(_value(x.bitwiseXOR(y), whole))
    once = _first_equal(x, y, bands) == F.col("a.band")
    first_sub = F.coalesce(*[F.when(F.col("a.band") == k, _first_equal(x, y, own)) for k, own in enumerate(subs)])
    once = once & ((F.col("a.sub") == -1) | (first_sub == F.col("a.sub")))
    pairs = a.join(b, same & (x < y) & (distance <= most) & once)
    return pairs.select(F.col("a.within").alias("within"), F.col("a.least").alias("a"), F.col("b.least").alias("b"), distance.alias("distance"))
