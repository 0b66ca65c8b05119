"""New archives as a stream: each file is read once, its rows follow when its checks have passed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import tables

_FILES = "path string, modificationTime timestamp, length long, content binary"


def stream_archives(spark: SparkSession, path: str, glob: str | None = None, files_per_batch: int = 1000) -> DataFrame:
    """A streaming DataFrame of files (path, modificationTime, length, content)."""
    reader = spark.readStream.format("binaryFile").schema(_FILES).option("maxFilesPerTrigger", files_per_batch)
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def stream_table(files: DataFrame, table: str, format: str, **how) -> DataFrame:
    """The named table (entries, contents, archives, verify) of a stream of files. Failing files are error rows unless another mode is
    given, as one bad file shouldn't stop a stream."""
    f: Callable[..., DataFrame] = {"entries": tables.entries, "contents": tables.contents, "archives": tables.archives, "verify": tables.verify}[table]
    return f(files, format, **({"mode": "PERMISSIVE"} if table != "verify" else {}) | how)
