"""What comes before a row in its key's order, without a task for each key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.sources.tables import drop_stored, stored

#: Values of the order that one window holds.
WIDTH = 4096


def with_previous(rows: DataFrame, key: str, order: str, value: str, name: str, width: int = WIDTH) -> DataFrame:
    """rows with the value of the row before in the key's order (a whole number, once in a key) as `name`; null for the first.

    Windows hold ranges of the order, so a key with most of the rows is many of them; the first row of a range takes the
    last of the range before. What comes before a range is found in the same way over ranges of ranges, until all of them
    fit in one window: however sparse the order is (time stamps), no window holds more than `width` rows. Rows without
    an order come before none and after none that have one; an empty table gives an empty result.
    """
    low, high = rows.agg(F.min(order), F.max(order)).first()
    return _with_previous(rows, key, order, value, name, width, low or 0, high or 0)


def _with_previous(rows: DataFrame, key: str, order: str, value: str, name: str, width: int, low: int, high: int) -> DataFrame:
    """low, high: the least and the greatest value of the order."""
    if high - low < width:
        before = F.lag(F.struct(value)).over(Window.partitionBy(key, F.col(order).isNull()).orderBy(order))
        return rows.withColumn(name, before[value])
    # division of whole numbers, rounded down: a quotient in floating point is wrong beyond 2^53
    placed = rows.withColumn("_range", F.expr(f"`{order}` div {width} - if(`{order}` < 0 and `{order}` % {width} <> 0, 1, 0)"))
    inside = placed.withColumn("_before", F.lag(F.struct(value)).over(Window.partitionBy(key, "_range").orderBy(order)))
    last = placed.where(F.col(order).isNotNull()).groupBy(F.col(key).alias("_key"), F.col("_range").alias("_at")).agg(F.max_by(F.struct(value), order).alias("_last"))
    nested = high // width - low // width >= width
    if nested:  # read by this level and the next one
        last = stored(last, "last")
    carried = _with_previous(last, "_key", "_at", "_last", "_carried", width, low // width, high // width)
    if nested:
        carried = stored(carried, "carried")
        drop_stored(last)
    whole = inside.join(carried.select(F.col("_key").alias("_of"), F.col("_at").alias("_in"), F.col("_carried").alias("_from")), F.col(key).eqNullSafe(F.col("_of")) & (F.col("_range") == F.col("_in")), "left")
    return whole.withColumn(name, F.coalesce("_before", "_from")[value]).drop("_range", "_before", "_of", "_in", "_from")
