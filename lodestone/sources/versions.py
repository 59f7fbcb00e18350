"""Numbered versions of a small JSON document, each a file of its own that is created without overwriting.

Of two writers that make the same version one creates its file and the other one finds that it exists, reads what is
new and tries the next number, so neither change is lost. Readers list names and read one file.
"""

from __future__ import annotations

import json
import random
import re
import time
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

#: Tries of a commit before it gives up.
TRIES = 100


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def _is(error: Py4JJavaError, name: str) -> bool:
    return name in error.java_exception.getClass().getName()


def read_json(spark: SparkSession, path: str) -> dict:
    place, files = _place(spark, path)
    stream = files.open(place)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def write_json(spark: SparkSession, path: str, document: dict) -> None:
    place, files = _place(spark, path)
    stream = files.create(place, True)
    try:
        stream.write(json.dumps(document, sort_keys=True).encode())
    finally:
        stream.close()


def delete(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        place, files = _place(spark, path)
        files.delete(place, True)


def versions(spark: SparkSession, folder: str) -> list[int]:
    """The numbers of the versions that are there, in ascending order."""
    place, files = _place(spark, folder)
    if not files.exists(place):
        return []
    names = [f.getPath().getName() for f in files.listStatus(place)]
    return sorted(int(n[:-5]) for n in names if re.fullmatch(r"\d{20}\.json", n))


def file_of(folder: str, version: int) -> str:
    return f"{folder}/{version:020d}.json"


def newest(spark: SparkSession, folder: str) -> tuple[int, dict] | None:
    """The newest version and its document; None before the first one."""
    while there := versions(spark, folder):
        try:
            return there[-1], read_json(spark, file_of(folder, there[-1]))
        except Py4JJavaError as error:  # deleted since it was listed, as there are many newer ones
            if not _is(error, "FileNotFound"):
                raise
    return None


def publish(spark: SparkSession, folder: str, version: int, document: dict) -> bool:
    """Whether this call has created the version; False if it was there. A reader never sees a part of it.

    The document is written aside and then gets its name by a hard link on a local disk, elsewhere by a rename that doesn't
    overwrite; both fail if the name is taken.
    """
    aside = f"{folder}/.{uuid.uuid4().hex}"
    write_json(spark, aside, document)
    (source, files), (target, _) = _place(spark, aside), _place(spark, file_of(folder, version))
    jvm = spark._jvm
    try:
        uri = files.makeQualified(target).toUri()
        if uri.getScheme() == "file":
            named = lambda path: jvm.java.nio.file.Paths.get(files.makeQualified(path).toUri())
            jvm.java.nio.file.Files.createLink(named(target), named(source))
        else:
            options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(uri, spark._jsc.hadoopConfiguration()).rename(source, target, options)
        return True
    except Py4JJavaError as error:
        if _is(error, "FileAlreadyExists"):
            return False
        raise
    finally:
        files.delete(source, False)


def commit(spark: SparkSession, folder: str, change: Callable[[dict | None], dict | None], kept: int | None = None) -> tuple[int, dict] | None:
    """Publishes change(newest document) as the next version, anew after each conflict; None if the change gives None.

    kept: of the versions so many stay, all if it isn't given.
    """
    for k in range(TRIES):
        last = newest(spark, folder)
        document = change(last and last[1])
        if document is None:
            return None
        version = last[0] + 1 if last else 1
        if publish(spark, folder, version, document):
            if kept is not None:
                delete(spark, *[file_of(folder, v) for v in versions(spark, folder) if v <= version - kept])
            return version, document
        time.sleep(random.uniform(0, 0.02 * min(k + 1, 10)))
    raise TimeoutError(f"{TRIES} other writers came first in {folder}")
