"""Documents into shards of nearly equal bytes: a minimax contiguous partition of atomic groups.

Equal texts stay together: a group. Groups are in the order of a hash of their text. One of more than a
FINEth part of a shard is an atom of its own; the others are joined to atoms in the order's cells, so that
there are about as many atoms at every input size, each a small part of a shard. An atom of more than an even
share (a group of copies) gets a shard of its own. The smallest capacity that lets the rest be filled
greedily into the other shards is found by binary search, and the order is cut where shards are nearest to an
even share of what is left, as far as that capacity lets the rest follow. It is SQL over one array of sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.stored import read, stored, stored_counting

SHARDS = 40
CELL_BITS = 14
#: A group of at least a shard's even share over this is an atom of its own.
FINE = 400
#: Bytes that a row counts besides its text.
ROW_BYTES = 16
#: Rows that are numbered together.
RUN = 20_000


def _filled(cells: Column, capacity: Column) -> Column:
    """Greedy filling: struct(shard, filled) after all cells (size, cell), from shard 0."""
    start = F.struct(F.lit(0).alias("shard"), F.lit(0).cast("long").alias("filled"))
    return F.aggregate(cells, start, lambda acc, c: F.when(acc["filled"] + c["size"] > capacity, F.struct((acc["shard"] + 1).alias("shard"), c["size"].alias("filled"))).otherwise(F.struct(acc["shard"].alias("shard"), (acc["filled"] + c["size"]).alias("filled"))))


def _reach(cells: Column, capacity: Column) -> Column:
    """By a number of shards the bytes before the first cell from which on the rest fits into so many, as far as that isn't 0."""
    start = F.struct(F.lit(0).cast("long").alias("filled"), F.aggregate(cells, F.lit(0).cast("long"), lambda n, c: n + c["size"]).alias("before"))
    state = F.struct(start["filled"].alias("filled"), start["before"].alias("before"), F.array(start["before"]).alias("bounds"))

    def back(acc: Column, c: Column) -> Column:
        full = acc["filled"] + c["size"] > capacity
        return F.struct(F.when(full, c["size"]).otherwise(acc["filled"] + c["size"]).alias("filled"), (acc["before"] - c["size"]).alias("before"), F.when(full, F.array_append(acc["bounds"], acc["before"])).otherwise(acc["bounds"]).alias("bounds"))

    return F.aggregate(F.reverse(cells), state, back)["bounds"]


def _even_cuts(cells: Column, capacity: Column, shards: Column, total: Column, reach: Column) -> Column:
    """The cells that begin shards 1, 2, ...: where a shard is nearest to an even share of what is left, if the rest can follow."""
    zero = F.lit(0).cast("long")
    start = F.struct(F.lit(0).alias("shard"), zero.alias("filled"), zero.alias("before"), F.array().cast("array<long>").alias("cuts"))

    def fill(acc: Column, c: Column) -> Column:
        even = (total - acc["before"] + acc["filled"]) / (shards - acc["shard"])
        follows = acc["before"] >= F.coalesce(F.get(reach, shards - 1 - acc["shard"]), zero)
        cut = (acc["filled"] > 0) & (acc["shard"] < shards - 1) & ((acc["filled"] + c["size"] > capacity) | (follows & (acc["filled"] + c["size"] / 2 > even)))
        return F.struct(
            F.when(cut, acc["shard"] + 1).otherwise(acc["shard"]).alias("shard"), F.when(cut, c["size"]).otherwise(acc["filled"] + c["size"]).alias("filled"), (acc["before"] + c["size"]).alias("before"),
            F.when(cut, F.array_append(acc["cuts"], c["cell"])).otherwise(acc["cuts"]).alias("cuts"),
        )

    return F.aggregate(cells, start, fill)["cuts"]


def minimax_shards(sizes: DataFrame, shards: int) -> DataFrame:
    """(cell, shard) for sizes (cell, size): contiguous in the order of cells, but for cells that fill a shard alone.

    Equal sizes of cells are taken in the order of cells. At most `shards` shards; an empty table gives none.
    """
    whole = sizes.agg(F.sum("size").alias("total"), F.collect_list(F.struct("size", "cell")).alias("cells")).where("total is not null")
    pick = F.slice(F.sort_array("cells", asc=False), 1, shards)
    alone = F.aggregate(
        pick,
        F.struct(F.col("total").alias("left"), F.lit(shards).alias("open"), F.array().cast("array<long>").alias("taken")),
        lambda acc, c: F.when(
            (acc["open"] > 1) & (F.size(acc["taken"]) == shards - acc["open"]) & (c["size"] * acc["open"] >= acc["left"]),
            F.struct((acc["left"] - c["size"]).alias("left"), (acc["open"] - 1).alias("open"), F.array_append(acc["taken"], c["cell"]).alias("taken")),
        ).otherwise(acc),
    )
    plan = stored(whole.withColumn("alone", alone), "alone").select("cells", F.col("alone.left").alias("left"), F.col("alone.open").alias("open"), F.col("alone.taken").alias("taken"))
    plan = plan.withColumn("rest", F.array_sort(F.transform(F.filter("cells", lambda c: ~F.array_contains(F.col("taken"), c["cell"])), lambda c: F.struct(c["cell"].alias("cell"), c["size"].alias("size")))))
    plan = stored(plan.select("taken", "left", "open", "rest"), "rest")
    largest = F.coalesce(F.array_max(F.transform("rest", lambda c: c["size"])), F.lit(0).cast("long"))
    bounds = F.struct(F.greatest(largest, F.ceil(F.col("left") / F.col("open")).cast("long")).alias("low"), (F.ceil(F.col("left") / F.col("open")).cast("long") + largest).alias("high"))

    def halve(acc: Column, _: Column) -> Column:
        middle = F.floor((acc["low"] + acc["high"]) / 2).cast("long")
        fits = _filled(F.col("rest"), middle)["shard"] < F.col("open")
        return F.when(acc["low"] >= acc["high"], acc).when(fits, F.struct(acc["low"].alias("low"), middle.alias("high"))).otherwise(F.struct((middle + 1).alias("low"), acc["high"].alias("high")))

    plan = stored(plan.withColumn("bounds", bounds), "bounds")
    plan = stored(plan.withColumn("capacity", F.aggregate(F.sequence(F.lit(1), F.lit(63)), F.col("bounds"), halve)["high"]), "capacity")
    plan = stored(plan.withColumn("reach", _reach(F.col("rest"), F.col("capacity"))), "reach")
    cut = stored(plan.withColumn("cuts", _even_cuts(F.col("rest"), F.col("capacity"), F.col("open"), F.col("left"), F.col("reach"))), "cuts")
    contiguous = cut.select("cuts", "taken", F.explode("rest.cell").alias("cell")).select("cell", (F.size("taken") + F.size(F.filter("cuts", lambda x: x <= F.col("cell")))).alias("shard"))
    single = cut.select(F.posexplode("taken").alias("shard", "cell")).select("cell", "shard")
    return contiguous.union(single)


def shard_documents(docs: DataFrame, shards: int = SHARDS, cell_bits: int = CELL_BITS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row of docs (doc_id, text); other columns are ignored.

    size: UTF-8 bytes of the text (null: none) and 16. law is `bytes`: sums of size are near equal, as far as
    groups of equal texts allow. slot numbers a shard's rows from 0 without gaps, in an order of hashes of
    their doc_id and text, then of doc_id. text_crc32 of a null text is that of no bytes; a null and an
    empty text are one group. grown_shard is null under this law. An empty table gives an empty result.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("group"),
        F.shiftrightunsigned(F.xxhash64(text), 64 - cell_bits).alias("cell"),
        F.shiftrightunsigned(F.xxhash64(F.lit(3), "doc_id", text), 1).alias("place"),
    )
    rows, seen = stored_counting(rows, "sizes", total=F.sum("size"))
    runs = max(1, seen.get("rows", 0) // RUN)
    rows = rows.withColumn("run", F.floor(F.col("place") / float(1 << 63) * runs).cast("long"))
    groups = rows.groupBy("cell", "group").agg(F.sum("size").alias("size"))
    own = F.when(F.col("size") * shards * FINE >= (seen.get("total") or 0), F.col("group"))
    atoms = groups.groupBy("cell", own.alias("own")).agg(F.sum("size").alias("size"))  # 2 to the power of cell_bits and shards times FINE at most
    atoms = stored(atoms.selectExpr("cell as hash_cell", "own", "size", "row_number() over (order by cell, own) - 1L as cell"), "atoms")
    shard_of = stored(atoms.join(minimax_shards(atoms.select("cell", "size"), shards), "cell").select("hash_cell", "own", "shard"), "shards")
    single = shard_of.where("own is not null").select(F.col("own").alias("group"), F.col("shard").alias("own_shard"))
    together = shard_of.where("own is null").select(F.col("hash_cell").alias("cell"), "shard")
    rows = rows.join(F.broadcast(single), "group", "left").join(F.broadcast(together), "cell", "left").withColumn("shard", F.coalesce("own_shard", "shard"))
    counts = rows.groupBy("shard", "run").agg(F.count("*").alias("n"))
    before = counts.selectExpr("shard", "run", "sum(n) over (partition by shard order by run) - n as before")
    ranked = rows.selectExpr("*", "row_number() over (partition by shard, run order by place, doc_id, text_crc32, size) - 1 as rank")
    placed = ranked.join(before, ["shard", "run"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("before") + F.col("rank")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(read(spark, sf_dir, "documents"))
