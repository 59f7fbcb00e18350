"""Training sequences without padding: each document is cut into pieces of power-of-two lengths.

A document of n ids has as many pieces of the longest length as fit, then one for each further binary
digit of n. A piece is a sequence of its own, so no sequence crosses documents and none is padded;
equal lengths are numbered together, as batches take them from one bucket.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.stored import broadcast_if_small, read, small_batches, spread, stored
from lodestone.llm.tokens import encoder

LONGEST = 4096
COLUMNS = {"doc_id": "long", "start": "long", "length": "long", "ids_crc32": "long", "doc_tokens": "long", "part": "int", "rank": "long"}
ROWS_AT_ONCE = 750


def piece_lengths(n: int, longest: int) -> list[int]:
    """Lengths of the pieces of n ids, from long to short."""
    return [longest] * (n // longest) + [1 << k for k in reversed(range(longest.bit_length() - 1)) if n % longest >> k & 1]


def _pieces(tokenizer: str, end_id: int, longest: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(tokenizer), TaskContext.get().partitionId()
        ranks = np.zeros(longest.bit_length(), np.int64)
        for whole in batches:
            for k in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(k, ROWS_AT_ONCE)
                owner, starts, lengths, sums, totals, order, ids = [], [], [], [], [], [], []
                for row, text in enumerate(encode.texts(batch.column("text"), end_id)):
                    text, at = text.astype("<u4"), 0
                    for length in piece_lengths(len(text), longest):
                        bucket = length.bit_length() - 1
                        owner.append(row)
                        starts.append(at)
                        lengths.append(length)
                        sums.append(zlib.crc32(text[at : at + length]))
                        totals.append(len(text))
                        order.append(ranks[bucket])
                        if with_ids:
                            ids.append(text[at : at + length].astype(np.int32))
                        ranks[bucket] += 1
                        at += length
                columns = [batch.column("doc_id").take(pa.array(owner, pa.int32())), *(pa.array(np.array(x, np.int64)) for x in (starts, lengths, sums, totals)), pa.array(np.full(len(owner), part, np.int32)), pa.array(np.array(order, np.int64))]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32))))
                yield pa.RecordBatch.from_arrays(columns, [*COLUMNS, *["ids"] * with_ids])

    return run


def pack(docs: DataFrame, tokenizer: str, end_id: int, longest: int = LONGEST, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids if asked for.

    docs: doc_id, text; other columns are ignored. A null text is empty: one piece, the end id. Rows
    without doc_id or with one that repeats are documents of their own. Texts of any length are cut
    whole; an empty table has no pieces. Sequences are numbered from 0 without gaps, the shortest first.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    schema = ", ".join(f"{k} {v}" for k, v in COLUMNS.items()) + ", ids array<int>" * with_ids
    pieces = stored(docs.mapInArrow(_pieces(tokenizer, end_id, longest, with_ids), schema), "pieces")
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = counts.selectExpr("length", "part", "sum(n) over (order by length, part) - n as before")  # a row for each task and length
    placed = pieces.join(broadcast_if_small(before), ["length", "part"])
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("before") + F.col("rank")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), *["ids"] * with_ids)


def op9_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    return pack(spread(read(spark, sf_dir, "documents")), tokenizer or public_tokenizers.path("word_bpe_49k.json"), 2, with_ids=False)
