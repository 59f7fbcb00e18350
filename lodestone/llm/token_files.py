"""Token ids as Parquet files in document order, read back by column, by document and by row group.

The ids are a list column with a dictionary (a vocabulary fits its page), the numbers beside them are
delta-encoded; row groups and pages have set sizes, and page indexes let a read of some documents or
of the numbers alone skip the rest.
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

from lodestone.llm.stored import broadcast_if_small, new_folder, read, small_batches
from lodestone.llm.tokens import encoder

ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10
SCHEMA = "doc_id long, part int, start_in_part long, n_tokens long, ids array<int>"
ROWS_AT_ONCE = 750


def _encode(tokenizer: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, start = encoder(tokenizer), TaskContext.get().partitionId(), 0
        for whole in batches:
            for k in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(k, ROWS_AT_ONCE)
                texts = list(encode.texts(batch.column("text"), end_id))
                n = np.array([len(x) for x in texts], np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(np.concatenate(texts)))
                starts = start + np.cumsum(n) - n
                start += int(n.sum())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.full(len(n), part, np.int32)), pa.array(starts), pa.array(n), lists], ["doc_id", "part", "start_in_part", "n_tokens", "ids"])

    return run


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, row_group_bytes: int = ROW_GROUP_BYTES, page_bytes: int = PAGE_BYTES) -> None:
    """Encodes every whole text and writes the ids in ascending doc_id order to Parquet files under path.

    docs: doc_id, text; other columns are ignored. A null text is empty, so it has the end id alone.
    Rows without doc_id come first; rows of one doc_id are ordered by a hash of their text, equal rows
    stay as often as they come. An empty table gives files without rows.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    order = ["doc_id", F.xxhash64("text")]
    ids = docs.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_encode(tokenizer, end_id), SCHEMA)
    options = {
        "compression": "zstd",
        "parquet.writer.version": "v2",
        "parquet.block.size": row_group_bytes,
        "parquet.page.size": page_bytes,
        "parquet.dictionary.page.size": 2 << 20,
        **{f"parquet.enable.dictionary#{name}": "false" for name in ("doc_id", "start_in_part", "n_tokens")},
    }
    ids.write.options(**options).parquet(path)


def read_token_files(spark: SparkSession, path: str, columns: tuple[str, ...] = ("ids",)) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, and of `columns` those of SCHEMA that are asked for.

    A filter on doc_id reads the pages that can have it; without "ids" no id is read.
    """
    rows = spark.read.schema(SCHEMA).parquet(path)
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("tokens"))
    before = totals.selectExpr("part", "sum(tokens) over (order by part) - tokens as before")  # a row for each file
    rows = rows.join(broadcast_if_small(before), "part")
    return rows.select("doc_id", (F.col("before") + F.col("start_in_part")).alias("start"), "n_tokens", *columns)


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        values, at = ids.values.to_numpy().astype("<u4", copy=False), ids.offsets.to_numpy()
        crc = np.array([zlib.crc32(values[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)], np.int64)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "start", "n_tokens")), pa.array(crc)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def op4_token_files(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    path = new_folder(spark, "tokens")
    write_token_files(read(spark, sf_dir, "documents"), path, tokenizer or public_tokenizers.path("byte_bpe_50k.json"), 0)
    return read_token_files(spark, path).mapInArrow(_checksums, "doc_id long, start long, n_tokens long, ids_crc32 long")
