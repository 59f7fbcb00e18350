"""Searches for parts of names by postings of three letters, so that a query reads the blocks that can have it and not all entries.

The index has two tables: entries, sorted by name and numbered in blocks of 2^BLOCK_BITS rows, and grams, each three letters of the names
of a block with that block, sorted by the letters. Neighbours in the order share most of their letters, so grams has far fewer rows than names
have letters. Row groups and pages of both hold ranges, whose statistics Parquet keeps, so a read with equal letters or blocks skips
the others. A query's blocks are those in the postings of all its letters; their entries are then tested by their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.tables import load_snapshot, save_snapshot

LETTERS = 3
#: Rows of a block, as a power of two, and blocks that are looked up by equality; with more, all entries are tested.
BLOCK_BITS, LOOKED_UP = 12, 2_000
#: Bytes of a row group and rows of a page, so that few are read.
GROUP_BYTES, PAGE_ROWS = 4 << 20, 1_000


def grams_of(entries: DataFrame) -> DataFrame:
    """(gram, _block), once each, of entries (name_lower, _block): the parts of LETTERS letters of their names; shorter names have themselves."""
    starts = F.sequence(F.lit(1), F.greatest(F.char_length("name_lower") - LETTERS + 1, F.lit(1)))
    parts = entries.select("name_lower", "_block").where("name_lower is not null").select("name_lower", "_block", F.explode(starts).alias("at"))
    return parts.select(F.col("name_lower").substr(F.col("at"), F.lit(LETTERS)).alias("gram"), "_block").distinct()


def build(entries: DataFrame, path: str) -> int | None:
    """Saves the index of entries (with name_lower) under path as a new version; no version if there are no entries."""
    sorted_by = lambda frame, *by: frame.repartitionByRange(*by).sortWithinPartitions(*by)
    small = {"parquet.block.size": str(GROUP_BYTES), "parquet.page.row.count.limit": str(PAGE_ROWS)}
    numbered = sorted_by(entries, "name_lower").withColumn("_block", F.shiftright(F.monotonically_increasing_id(), BLOCK_BITS))
    # the postings are of the blocks as they were written: another run of the sort could number them differently
    return save_snapshot({"entries": numbered, "grams": lambda saved: sorted_by(grams_of(saved("entries")), "gram", "_block")}, path, keep_if_empty="entries", options=small)


def load(spark: SparkSession, path: str) -> dict[str, DataFrame] | None:
    return load_snapshot(spark, path)


def blocks_with(index: dict[str, DataFrame], query: str) -> DataFrame:
    """(_block) of the blocks that can have the lower-case query in a name: all its letters, or of fewer than LETTERS letters a part that has it."""
    grams, query = index["grams"], query.lower()
    if len(query) < LETTERS:
        return grams.where(F.col("gram").contains(query)).select("_block").distinct()
    asked = sorted({query[k : k + LETTERS] for k in range(len(query) - LETTERS + 1)})
    found = grams.where(F.col("gram").isin(asked))
    return found.groupBy("_block").agg(F.count("*").alias("n")).where(F.col("n") == len(asked)).select("_block")


def names_with(index: dict[str, DataFrame], query: str) -> DataFrame:
    """(name_lower) of the different names that have the lower-case query in them."""
    return entries_with(index, query).select("name_lower").dropna().distinct()


def entries_with(index: dict[str, DataFrame], query: str) -> DataFrame:
    """The entries whose lower-case name has the query in it, all columns; an empty query is in all names.

    Up to LOOKED_UP blocks are a condition that reaches the files; with more, all are read. Either way each name is tested.
    """
    entries = index["entries"]
    whole = entries.drop("_block")
    if not query:
        return whole
    has = F.col("name_lower").contains(query.lower())
    found = [r["_block"] for r in blocks_with(index, query).limit(LOOKED_UP + 1).collect()]
    if len(found) > LOOKED_UP:
        return whole.where(has)
    if not found:
        return whole.limit(0)
    # the range and each value: statistics of row groups decide by both
    few = reduce(lambda a, b: a | b, [F.col("_block").isin(found[k : k + 500]) for k in range(0, len(found), 500)])
    return entries.where(F.col("_block").between(min(found), max(found))).where(few).where(has).drop("_block")
