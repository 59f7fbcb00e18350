"""What operators over texts have in common: stored tables, batches to Python, reading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.sources import tables
from lodestone.sources.tables import drop_stored, new_folder, spread, stored, stored_counting

__all__ = ["broadcast_if_small", "drop_stored", "new_folder", "read", "small_batches", "spread", "stored", "stored_counting"]

#: A side of a join is broadcast up to so many rows (of a few numbers each); beyond it Spark joins by shuffles.
BROADCAST_ROWS = 500_000
BATCH_ROWS, BATCH_BYTES = 1_500, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Rows go to Python in batches of BATCH_ROWS and BATCH_BYTES at most: whole texts are long, and a batch is in memory several times."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        spark.conf.set(f"spark.sql.execution.arrow.{name}", most)


def broadcast_if_small(frame: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    return tables.broadcast_if_small(frame, rows)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
