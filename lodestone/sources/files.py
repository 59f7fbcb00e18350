"""Listings, drives, application sources and file metadata, each read with a fixed schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.tables import SCAN, save_snapshot, set_fingerprint, snapshot_notes

DRIVES = "drive string, root string, device_path string, file_system string"
#: One row for each entry of a source; ordinal is its place there, src_prio that of the source.
APP_SOURCES = "source string, src_prio int, ordinal int, name string, path string, install_location string, publisher string, uninstall_string string, quiet_uninstall_string string, icon string"
FORMATS = ("parquet", "json", "csv")


def _typed(spark: SparkSession, path: str, schema: str, form: str) -> DataFrame:
    """Rows of a file or folder with this schema; rows that don't fit it go, columns that it lacks are null."""
    if form not in FORMATS:
        raise ValueError(f"{form} isn't one of {FORMATS}")
    reader = spark.read.schema(schema)
    return reader.parquet(path) if form == "parquet" else reader.option("mode", "DROPMALFORMED").option("header", True).format(form).load(path)


def read_listing(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    """Scan records (SCAN) of a dumped listing; records without a ref or a name go."""
    return _typed(spark, path, SCAN, form).where("file_ref is not null and name is not null")


def read_drives(spark: SparkSession, path: str, form: str = "json") -> DataFrame:
    """The drives whose file system's name begins with NTFS."""
    return _typed(spark, path, DRIVES, form).where(F.upper("file_system").startswith("NTFS"))


def read_app_sources(spark: SparkSession, path: str, form: str = "json") -> DataFrame:
    """Entries of application sources that have a name."""
    return _typed(spark, path, APP_SOURCES, form).where("name <> ''")


def file_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, modified) of all files under a path; no content is read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return rows.select("path", "length", F.col("modificationTime").alias("modified"))


def refresh_pool(apps: DataFrame, path: str) -> int | None:
    """Publishes the catalogue (name, path) under path if it isn't empty and its lower paths differ from the published one's; returns the new revision, None if nothing changed.

    Paths alone decide: an entry that only has another name isn't published. The paths' fingerprint is kept beside
    the catalogue, so what was published isn't read again.
    """
    fingerprint = set_fingerprint(apps, F.lower("path"))
    notes = snapshot_notes(apps.sparkSession, path)
    if notes is not None and notes.get("paths") == fingerprint:
        return None
    return save_snapshot({"apps": apps}, path, keep_if_empty="apps", notes={"paths": fingerprint})
