"""Documents linked by the Jaccard similarity of their word n-gram sets: a blocked sparse matrix product.

Rows of the incidence matrix are distinct shingle sets, columns are shingles (64-bit hashes, so a set's
size or an overlap could be off by one with a chance of about 1e-19 a pair of shingles). Only the
products that can matter are formed, in four steps, none of which can lose a link:

1. Equal sets collapse to one row. A set's key is a 64-bit sum of its shingles' hashes.
2. Rows without enough columns in common with others go. If two sets link, then of the smallest
   `size - need + k` hashes of either, k at least are in the other one (pigeonhole; `need` is the
   threshold's share of the size), so at most `size - need` of them are columns of that row alone. A block
   of documents sends each of its columns once, and columns are counted with partial sums.
3. The rows that are left are built whole; columns of one row go. A row with fewer shared columns than
   `need` goes. Its columns are ordered from rare to frequent, and those before the last `need - 1`
   index the candidates.
4. Overlaps are counted in blocks of the product: some rows (a block) against slices of others, over the
   columns they have in common, within the bounds that sizes set. First, in a few turns, the rows that head
   columns against the rows that have most index columns under them, which joins large groups of near copies
   by stars; then the rows whose index columns still hold several components against the rows of those.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.components import connected_components
from lodestone.llm.stored import BROADCAST_ROWS, broadcast_if_small, drop_stored, read, small_batches, spread, stored, stored_counting
from lodestone.llm.text_arrays import mix, shingle_sets

#: Of 100: two sets link from this similarity on.
SIMILARITY = 75
#: Share of a set (its smallest hashes) that step 2 looks at.
LOOKED_AT = 0.36
#: Shingles that step 2 combines before it sends them on.
BLOCK = 1 << 19
#: Turns of step 4 by stars: partners that a row is compared with in each.
PARTNERS = (1, 4)
#: Rows of a block of the product, and of a slice of others that it meets in one task.
BLOCK_ROWS, SLICE_ROWS = 1_000, 1_500
#: Keys that a task remembers so that it sends the columns of a set once; it then starts anew.
REMEMBERED = 50_000


def set_key(shingles: np.ndarray) -> np.int64:
    return mix(shingles).sum(dtype=np.uint64).astype(np.int64)


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, key = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for row, shingles in shingle_sets(batch.column("text"), size):
                n[row], key[row] = len(shingles), set_key(shingles)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(n), pa.array(key)], ["doc_id", "text_key", "n", "key"])

    return run


def _need(n, similarity: int):
    return -(-n * similarity // 100)


def _looked_at(size: int, similarity: int):
    """Step 2's entries (h, key, several): each column of a block once, with a row that has it; several: other rows of the block have it, too."""

    def combined(keys: list, hashes: list) -> pa.RecordBatch:
        h, key = np.concatenate(hashes), np.repeat(np.array(keys, np.int64), [len(x) for x in hashes])
        order = np.argsort(h, kind="stable")
        h, key = h[order], key[order]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        last = np.append(new[1:], True)
        return pa.RecordBatch.from_arrays([pa.array(h[new].view(np.int64)), pa.array(key[new]), pa.array(~last[new])], ["h", "key", "several"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, hashes, held, seen = [], [], 0, set()
        for batch in batches:
            for _, shingles in shingle_sets(batch.column("text"), size):
                if not len(shingles) or (key := set_key(shingles)) in seen:
                    continue
                seen.add(key)
                n = len(shingles)
                hashes.append(shingles[: n - _need(n, similarity) + _least(n, similarity)])
                keys.append(key)
                held += len(hashes[-1])
                if held >= BLOCK:
                    yield combined(keys, hashes)
                    keys, hashes, held, seen = [], [], 0, set()
        if keys:
            yield combined(keys, hashes)

    return run


def _least(n: int, similarity: int) -> int:
    """k of step 2 for a set of n: what makes the part that is looked at LOOKED_AT of the set."""
    return max(1, int((LOOKED_AT - 1 + similarity / 100) * n))


def _rows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            for _, shingles in shingle_sets(batch.column("text"), size):
                if (n := len(shingles)) and (key := set_key(shingles)) not in seen:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add(key)
                    yield pa.RecordBatch.from_arrays([pa.array(shingles.view(np.int64)), pa.array(np.full(n, key)), pa.array(np.full(n, n, np.int32))], ["h", "key", "n"])

    return run


def _within_bounds(similarity: int):
    """What the sizes n and the shared columns c of two rows a and b allow: an overlap of at least s / (100 + s) of both."""
    least, most = F.least("a.n", "b.n"), F.greatest("a.n", "b.n")
    return (100 * least >= similarity * most) & ((100 + similarity) * F.least("a.c", "b.c") >= similarity * (F.col("a.n") + F.col("b.n")))


def _size_class(similarity: int):
    """Rows that link are in one class of sizes or in neighbouring ones."""
    return F.floor(F.ln("n") / float(np.log(100 / similarity))).cast("int")


def _star_pairs(index: DataFrame, parts: DataFrame, similarity: int, turn: int, partners: int) -> DataFrame:
    """(a, b): for each row b in more than one component's columns, the `partners` rows a that head most of them.

    A column has one head: in the first turn its smallest set, later one drawn by a hash of row and column.
    """
    placed = index.join(parts.select("key", "component"), "key")
    first = F.struct("n", "key") if turn == 0 else F.struct(F.xxhash64("key", "h", F.lit(turn)), "key")
    heads = placed.groupBy("h").agg(F.min_by(F.struct("key", "n", "c", "component"), first).alias("head"), F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    star = placed.alias("b").join(heads.selectExpr("h", "head.key", "head.n", "head.c", "head.component").alias("a"), F.col("a.h") == F.col("b.h"))
    votes = star.where((F.col("a.component") != F.col("b.component")) & _within_bounds(similarity)).groupBy(F.col("b.key").alias("b"), F.col("a.key").alias("a")).agg(F.count("*").alias("votes"))
    best = F.slice(F.sort_array(F.collect_list(F.struct("votes", "a")), asc=False), 1, partners)
    return votes.groupBy("b").agg(best.alias("best")).select(F.explode("best.a").alias("a"), "b")


def _product(similarity: int):
    """Overlap counts of a block's rows with a slice of others, from the postings of the block's columns; gives the pairs that link."""

    def links(block: pa.Table, others: pa.Table) -> pa.Table:
        def columns(table: pa.Table) -> tuple[np.ndarray, ...]:
            grams = table["grams"].combine_chunks()
            grams = pa.concat_arrays(grams.chunks) if isinstance(grams, pa.ChunkedArray) else grams
            return (*(table[c].to_numpy() for c in ("key", "n", "component")), grams.offsets.to_numpy(), grams.values.to_numpy())

        found_a, found_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if block.num_rows and others.num_rows:
            key, n, part, at, grams = columns(block)
            owner = np.repeat(np.arange(len(key)), np.diff(at))
            grams = grams[at[0] : at[-1]]
            order = np.argsort(grams, kind="stable")
            distinct, first = np.unique(grams[order], return_index=True)
            owner, first = owner[order], np.append(first, len(grams))
            o_key, o_n, o_part, o_at, o_grams = columns(others)
            for k in range(len(o_key)):
                own = o_grams[o_at[k] : o_at[k + 1]]
                place = np.minimum(np.searchsorted(distinct, own), len(distinct) - 1)
                place = place[distinct[place] == own]
                count = first[place + 1] - first[place]
                each = np.repeat(first[place] - np.cumsum(count) + count, count) + np.arange(count.sum())
                overlap = np.bincount(owner[each], minlength=len(key))
                linked = np.flatnonzero(((100 + similarity) * overlap >= similarity * (n.astype(np.int64) + o_n[k])) & (part != o_part[k]))
                found_a.append(np.full(len(linked), o_key[k]))
                found_b.append(key[linked])
        return pa.table({"a": np.concatenate(found_a), "b": np.concatenate(found_b)})

    return links


def _block_links(in_block: DataFrame, members: DataFrame, parts: DataFrame, rows: DataFrame, similarity: int) -> DataFrame:
    """(a, b) that link, of the rows of each block (in_block: key, block) and those it meets (members: block, key); not those of one component."""
    cuts = broadcast_if_small(members.groupBy("block").agg(F.ceil(F.count("*") / SLICE_ROWS).cast("int").alias("cuts")))
    whole = rows.select("key", "n", "grams").join(parts.select("key", "component"), "key")
    asked = in_block.join(cuts, "block").select("block", "key", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("cut")).join(whole, "key")
    others = members.join(cuts, "block").select("block", "key", F.pmod(F.xxhash64("key"), "cuts").cast("int").alias("cut")).join(whole, "key")
    names = ["block", "cut", "key", "n", "component", "grams"]
    asked, others = (side.select(*[F.col(c).alias(c) for c in names]) for side in (asked, others))  # new names, as both have rows' columns
    return asked.groupBy("block", "cut").cogroup(others.groupBy("block", "cut")).applyInArrow(_product(similarity), "a long, b long")


def _star_links(pairs: DataFrame, n_pairs: int, parts: DataFrame, rows: DataFrame, similarity: int) -> DataFrame:
    """(a, b) that link, from blocks of heads a and the rows b that chose one of the block.

    Heads of one component share a block, or as few as hold them, so that a row meets all its heads there in few blocks.
    """
    placed = pairs.join(parts.select(F.col("key").alias("a"), "component"), "a")
    heads = placed.groupBy("component").agg(F.ceil(F.approx_count_distinct("a") / BLOCK_ROWS).alias("blocks")).where("blocks > 1")
    block = F.xxhash64(F.pmod(F.xxhash64("component"), F.lit(max(1, n_pairs // BLOCK_ROWS))), F.pmod(F.xxhash64("a"), F.coalesce("blocks", F.lit(1))))
    placed = stored(placed.join(broadcast_if_small(heads), "component", "left").select("a", "b", block.alias("block")), "placed")
    in_block, members = (placed.select("block", F.col(c).alias("key")).distinct() for c in ("a", "b"))
    return _block_links(in_block, members, parts, rows, similarity)


def _crossing_links(index: DataFrame, parts: DataFrame, rows: DataFrame, similarity: int) -> DataFrame | None:
    """(a, b): every pair of rows that links and isn't in one component, of those with a column in common.

    In a column of several components the rows outside the most frequent one are looked up: they are put
    into blocks of BLOCK_ROWS or so of one class of sizes, those of one component together, and a block meets the rows of all
    components that its columns have, of its own and the neighbouring classes. A hot column is so never paired with itself.
    None if there are no such rows.
    """
    placed = index.join(parts.select("key", "component"), "key").withColumn("class", _size_class(similarity))
    by_part = stored(placed.groupBy("h", "component", "class").agg(F.count("*").alias("m")), "by-part")
    sums = by_part.groupBy("h", "component").agg(F.sum("m").alias("m"))
    main = sums.groupBy("h").agg(F.max_by("component", F.struct("m", "component")).alias("main"), F.count("*").alias("components")).where("components > 1").select("h", "main")
    asking, found = stored_counting(placed.join(main, "h").where("component <> main").select("h", "key", "class", "main"), "asking")
    if not found.get("rows", 0):
        return None
    near = stored(asking.groupBy("key", "class").agg(F.min("main").alias("near")), "near")
    blocks = near.groupBy("class").agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("blocks"))  # a row for each class of sizes
    large = near.groupBy("near", "class").agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("parts")).where("parts > 1")
    block = F.xxhash64("class", F.pmod(F.xxhash64("near"), "blocks"), F.pmod(F.xxhash64("key"), F.coalesce("parts", F.lit(1))))
    in_block = stored(near.join(F.broadcast(blocks), "class").join(broadcast_if_small(large), ["near", "class"], "left").select("key", block.alias("block")), "in-block")
    columns = asking.join(in_block, "key").select("h", "block", "class").distinct()
    around = columns.select("h", "block", F.explode(F.sequence(F.col("class") - 1, F.col("class") + 1)).alias("class"))
    met = stored(around.join(by_part, ["h", "class"]).select("block", "component", "class").distinct(), "met")
    classed = parts.withColumn("class", _size_class(similarity)).select("key", "component", "class")
    members = stored(classed.join(broadcast_if_small(met), ["component", "class"]).select("block", "key"), "members")
    return _block_links(in_block, members, parts, rows, similarity)


def _joined(parts: DataFrame, links: DataFrame, broadcast) -> DataFrame:
    """The parts (key, n, component) after links (a, b) between rows have joined components."""
    ends = links.join(parts.select(F.col("key").alias("a"), F.col("component").alias("of_a")), "a").join(parts.select(F.col("key").alias("b"), F.col("component").alias("of_b")), "b")
    between, found = stored_counting(ends.select(F.col("of_a").alias("a"), F.col("of_b").alias("b")).where("a <> b").distinct(), "between")
    if not found.get("rows", 0):
        return parts
    merged = connected_components(parts.select(F.col("component").alias("key")), between).select(F.col("key").alias("component"), F.col("component").alias("merged"))
    return broadcast(stored(parts.join(merged, "component").select("key", "n", F.col("merged").alias("component")), "parts"))


def _set_components(docs: DataFrame, size: int, similarity: int) -> DataFrame:
    """doc_id, text_key, n, part of each row: a hash of its text, the size of its set, and the key of its component; null without shingles."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64("text").alias("text_key"))
    sets = stored(docs.mapInArrow(_sets(size), "doc_id long, text_key long, n long, key long"), "sets")
    texts = docs.where(F.col("text").isNotNull())
    need = F.ceil(F.col("n") * similarity / 100).cast("int")

    # Step 2
    looked = texts.select("text").mapInArrow(_looked_at(size, similarity), "h long, key long, several boolean")
    column = looked.groupBy("h").agg(F.min("key").alias("key"), F.max("key").alias("last"), F.max("several").alias("several"))
    alone = column.where("key = last and not several").groupBy("key").agg(F.count("*").alias("alone"))
    different = sets.where("n > 0").groupBy("key", "n").agg(F.min(F.struct("doc_id", "text_key")).alias("one"))
    chosen = different.join(alone, "key", "left").where(F.coalesce("alone", F.lit(0)) <= F.col("n") - need)
    chosen = stored(chosen.select(F.col("one.doc_id").alias("chosen_id"), F.col("one.text_key").alias("chosen_key")).distinct(), "chosen")

    # Step 3: one text of each set that is left, found by its id, if it has one, and its hash
    of_chosen = F.col("doc_id").eqNullSafe(F.col("chosen_id")) & (F.col("text_key") == F.col("chosen_key"))
    entries = stored(texts.join(broadcast_if_small(chosen), of_chosen, "left_semi").select("text").mapInArrow(_rows(size), "h long, key long, n int"), "entries")
    frequent = entries.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    grams = F.array_sort(F.collect_set(F.struct("df", "h")))
    rows = entries.join(frequent, "h").groupBy("key", "n").agg(grams.alias("grams")).withColumn("c", F.size("grams"))
    rows, counted = stored_counting(rows.where(F.col("c") >= need).select("key", "n", "c", F.col("grams.h").alias("grams")), "rows")
    drop_stored(entries)

    # Step 4; the parts have as many rows as `rows`
    index = stored(rows.select("key", "n", "c", F.explode(F.slice("grams", F.lit(1), F.col("c") - need + 1)).alias("h")), "index")
    small = F.broadcast if counted.get("rows", 0) <= BROADCAST_ROWS else lambda frame: frame
    parts = small(rows.select("key", "n", F.col("key").alias("component")))
    for k, partners in enumerate(PARTNERS):
        pairs, found = stored_counting(_star_pairs(index, parts, similarity, k, partners), f"pairs-{k}")
        if found.get("rows", 0):
            parts = _joined(parts, stored(_star_links(pairs, found["rows"], parts, rows, similarity), f"links-{k}"), small)
    crossing = _crossing_links(index, parts, rows, similarity)
    if crossing is not None:
        parts = _joined(parts, stored(crossing, "crossing"), small)
    drop_stored(index)

    named = sets.join(parts.select("key", "component"), "key", "left")
    return named.select("doc_id", "text_key", "n", F.when(F.col("n") > 0, F.coalesce("component", "key")).alias("part"))


def jaccard_components(docs: DataFrame, size: int = 5, similarity: int = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links, its own included) of each row.

    docs: doc_id, text; other columns are ignored. A null text, an empty one and one without words have
    no shingles, link with nothing and are their own component. Fewer words than `size` are one shingle.
    Repeated rows are returned as often as they come; rows of one doc_id with several texts each have
    their own set. A row without doc_id takes part; its component_id is null if no row it reaches has one.
    An empty table gives an empty result.
    """
    named = _set_components(docs, size, similarity)
    smallest = named.where("n > 0").groupBy("part").agg(F.min("doc_id").alias("component_id"))
    linked = named.where("n > 0").join(smallest, "part").select("doc_id", "n", "component_id")
    alone = named.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return linked.union(alone).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def op3_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spread(read(spark, sf_dir, "documents")))


def one_of_each(docs: DataFrame, size: int = 5, similarity: int = SIMILARITY) -> DataFrame:
    """One row of each component: of its texts the one with the smallest doc_id (rows without one come last), then the smallest hash, and of its copies one.

    Rows of one doc_id with different texts are judged each for itself. Rows without shingles link with nothing and stay as often as
    they come. Of rows with equal doc_id and text that differ in other columns the one with the smallest hash of all columns stays.
    """
    named = stored(_set_components(docs, size, similarity).where("n > 0").groupBy("doc_id", "text_key", "part").agg(F.count("*").alias("copies")), "named")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")
    first = named.groupBy("part").agg(F.min(order).alias("first"), F.count("*").alias("texts")).where("texts > 1").select("part", "first")
    other = ~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key")))
    gone = stored(named.join(first, "part").where(other).select(F.col("doc_id").alias("_lodestone_id"), F.col("text_key").alias("_lodestone_key")), "gone")
    copied, counted = stored_counting(named.where("copies > 1").select(F.col("doc_id").alias("_lodestone_id"), F.col("text_key").alias("_lodestone_key")), "copied")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_lodestone_id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("_lodestone_key"))
    kept = docs.join(broadcast_if_small(gone), same, "left_anti")
    if not counted.get("rows", 0):
        return kept
    copied = broadcast_if_small(copied)
    one = kept.join(copied, same, "left_semi").groupBy(F.col("doc_id").alias("_lodestone_id"), F.xxhash64("text").alias("_lodestone_key")).agg(F.min_by(F.struct(*kept.columns), F.xxhash64(*kept.columns)).alias("_lodestone_row"))
    return kept.join(copied, same, "left_anti").unionByName(one.select("_lodestone_row.*"))


OP3_SQL = r"""
with recursive words as (
  select row_number() over () as row, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents),
shingled as (
  select row, doc_id, case when len(w) < 5 then [array_to_string(w, ' ')] else list_distinct([array_to_string(w[k:k + 4], ' ') for k in range(1, len(w) - 3)]) end as grams, len(w) as n_words
  from words),
sets as (select row, doc_id, n_words, len(grams) as n, md5(array_to_string(list_sort(grams), chr(10))) as key, grams from shingled),
entries as (select key, n, unnest(grams) as gram from (select key, any_value(n) as n, any_value(grams) as grams from sets where n_words > 0 group by key)),
links as (
  select a.key as a, b.key as b from entries a join entries b on a.gram = b.gram and a.key <> b.key
  group by a.key, b.key, a.n, b.n having 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach(start, key) as (select distinct key, key from entries union select reach.start, links.b from reach join links on links.a = reach.key),
components as (select reach.start as key, min(sets.doc_id) as component_id from reach join sets on sets.key = reach.key group by reach.start)
select s.doc_id, case when n_words > 0 then s.n else 0 end as n_shingles, case when n_words > 0 then c.component_id else s.doc_id end as component_id
from sets s left join components c on c.key = s.key and s.n_words > 0
"""
