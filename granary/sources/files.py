"""Archives from any store that Spark reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_archives(spark: SparkSession, path: str | list[str], glob: str | None = None, recursive: bool = False, most_bytes: int | None = None) -> DataFrame:
    """path, length, modificationTime and content of files. The glob and the size are tested before bytes are read; a file isn't split,
    so a task holds whole archives."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    df = reader.load(path)
    return df.where(df.length <= most_bytes) if most_bytes is not None else df
