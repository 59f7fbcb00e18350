"""Benchmark items inside long documents: size-partitioned MinHash containment search, then an exact check.

An item's shingles are hashed, and the smallest hashes are its MinHash sketch (a bottom sketch). Items are
partitioned by size, to powers of two, and the partition sets its sketches' length: if three quarters
of an item are in a document, then so is one at least of its `size - need + 1` smallest hashes, whatever
else the document has. Documents have no sketch: all their shingles are looked up, so the search misses
nothing at any length of document. Candidates are checked on their shingles themselves. Everything is joins and SQL functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.stored import broadcast_if_small, read, spread, stored

SHINGLE = 5
#: Of 100: so much of an item's distinct shingles makes a document contaminated.
CONTAINED = 75
SPACES = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: Column) -> Column:
    """Runs other than white space, A to Z lowered; for null or no words an array with one empty string."""
    plain = F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER)
    return F.split(F.btrim(plain, F.lit(SPACES)), r"[\x20\x09-\x0D]+")


def _shingle_hashes(words: Column) -> Column:
    """A hash of each window of SHINGLE words, from hashes of its words; of fewer words one hash of all."""

    def windows(hashes: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(hashes) - SHINGLE), lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(SHINGLE)]))

    # an array of one element names the words' hashes, so that they are made once
    whole = F.get(F.transform(F.array(F.transform(words, lambda w: F.xxhash64(w))), windows), F.lit(0))
    return F.when(F.size(words) >= SHINGLE, whole).when(F.get(words, F.lit(0)) != "", F.array(F.xxhash64(F.concat_ws(" ", words)))).otherwise(F.array().cast("array<long>"))


def _shingles(words: Column) -> Column:
    whole = F.transform(F.sequence(F.lit(0), F.size(words) - SHINGLE), lambda i: F.concat_ws(" ", *[F.get(words, i + j) for j in range(SHINGLE)]))
    return F.when(F.size(words) >= SHINGLE, whole).when(F.get(words, F.lit(0)) != "", F.array(F.concat_ws(" ", words))).otherwise(F.array().cast("array<string>"))


def _sketches(items: DataFrame, contained: int) -> DataFrame:
    """(h, item) of items (item, words): the smallest hashes of each, as many as the item's partition needs."""
    hashed = items.select("item", F.array_sort(F.array_distinct(_shingle_hashes(F.col("words")))).alias("hashes"))
    largest = F.pow(F.lit(2), F.ceil(F.log2(F.size("hashes"))))
    length = (largest - F.ceil(largest * contained / 100) + 1).cast("int")
    return hashed.where(F.size("hashes") > 0).select("item", F.explode(F.slice("hashes", F.lit(1), length)).alias("h"))


def _text_key() -> list[Column]:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return [F.xxhash64(text).alias("text_key"), F.xxhash64(F.lit(17), text).alias("text_check")]


def contained_items(docs: DataFrame, benchmark: DataFrame, contained: int = CONTAINED) -> DataFrame:
    """doc_id, item_id, n_item_shingles, n_matched, containment, text_key, text_check: one row for each document and item that it contains.

    docs: doc_id, text; benchmark: item_id, text; other columns are ignored. Null and wordless texts contain
    nothing and are contained nowhere. An item of fewer words than a shingle is one shingle, which only a
    text of just these words has. Repeated items count once, repeated documents each; null ids stay null.
    An empty table on either side gives an empty result.
    """
    items = benchmark.select("item_id", F.col("text").cast("string")).distinct().withColumn("words", _words(F.col("text"))).withColumn("item", F.xxhash64("item_id", "text"))
    items = stored(items.select("item", "item_id", "words"), "items")
    sketches = broadcast_if_small(stored(_sketches(items, contained), "sketches"))
    worded = docs.select(*_text_key(), _words(F.col("text")).alias("words"))  # a column, so that no expression splits again for each shingle
    hashes = worded.select("text_key", "text_check", F.explode(_shingle_hashes(F.col("words"))).alias("h"))
    candidates = stored(hashes.join(sketches, "h").select("text_key", "text_check", "item").distinct(), "candidates")

    # each different text with a candidate is exploded into its shingles once, whatever its copies and candidates
    found_texts = broadcast_if_small(candidates.select("text_key", "text_check").distinct())
    texts = docs.select(*_text_key(), F.col("text")).join(found_texts, ["text_key", "text_check"], "left_semi").select("text_key", "text_check", _words(F.col("text")).alias("words"))
    shingles = texts.select("text_key", "text_check", F.explode(F.array_distinct(_shingles(F.col("words")))).alias("shingle"))
    own = items.select("item", F.explode(F.array_distinct(_shingles(F.col("words")))).alias("shingle"))
    own = stored(own.join(candidates.select("item").distinct(), "item", "left_semi"), "item-shingles")
    sizes = own.groupBy("item").agg(F.count("*").alias("n_item_shingles"))
    matched = shingles.join(broadcast_if_small(own), "shingle").distinct().groupBy("text_key", "text_check", "item").agg(F.count("*").alias("n_matched"))
    whole = matched.join(sizes, "item").where(100 * F.col("n_matched") >= contained * F.col("n_item_shingles")).join(items.select("item", "item_id"), "item")
    whole = broadcast_if_small(stored(whole.drop("item"), "contained"))
    found = docs.select(F.col("doc_id").cast("long"), *_text_key()).join(whole, ["text_key", "text_check"])
    return found.select("doc_id", "item_id", "n_item_shingles", "n_matched", (F.col("n_matched") / F.col("n_item_shingles")).alias("containment"), "text_key", "text_check")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contained_items(spread(read(spark, sf_dir, "documents")), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_item_shingles", "n_matched", "containment")


def without_items(docs: DataFrame, benchmark: DataFrame, contained: int = CONTAINED) -> DataFrame:
    """The rows of docs whose text contains no item of the benchmark, with their own columns.

    Rows are told apart by their text, so each copy of a contaminated text goes, whatever its doc_id;
    null and empty texts stay.
    """
    found = stored(contained_items(docs, benchmark, contained).select("text_key", "text_check").distinct(), "contaminated")
    names = [f"kept_{k}" for k in range(len(docs.columns))]
    carried = docs.select(*[F.col(f"`{c}`").alias(name) for name, c in zip(names, docs.columns, strict=True)], *_text_key())
    clean = carried.join(broadcast_if_small(found), ["text_key", "text_check"], "left_anti")
    return clean.select(*[F.col(name).alias(c) for name, c in zip(names, docs.columns, strict=True)])


OP10_SQL = r"""
with words as (
  select 'd' as kind, doc_id as id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
  union all
  select 'b', item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') from benchmark),
places as (select kind, id, w, unnest(case when len(w) >= 5 then range(1, len(w) - 3) when len(w) > 0 then [1] else [] end) as i from words),
shingles as (select distinct kind, id, array_to_string(w[i:i + 4], ' ') as s from places),
sizes as (select id, count(*) as n from shingles where kind = 'b' group by id)
select d.id as doc_id, b.id as item_id, n as n_item_shingles, count(*) as n_matched, count(*) / n as containment
from shingles d join shingles b on d.s = b.s and d.kind = 'd' and b.kind = 'b' join sizes on sizes.id = b.id
group by d.id, b.id, n having 100 * count(*) >= 75 * n
"""
