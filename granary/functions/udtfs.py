"""SQL functions: table functions for LATERAL, and scalar functions over Arrow batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..errors import ArchiveError
from ..formats import open_archive
from ..formats.streams import StreamReader, detect


class ArchiveEntries:
    def eval(self, content: bytes, format: str):
        for e in open_archive(content, format).entries if content is not None else ():
            kind = e.get("kind") or ("directory" if e.get("is_directory") else "symlink" if e.get("is_symlink") else "file")
            yield e["idx"], e["name"], kind, e["size"], e.get("crc32"), e["is_safe_path"]


class ArchiveContents:
    def eval(self, content: bytes, format: str):
        if content is not None:
            a = open_archive(content, format)
            for i, data in a.members():
                yield i, a.entries[i]["name"], len(data), data


class ArchiveVerify:
    def eval(self, content: bytes, format: str):
        try:
            n = open_archive(content, format).verify() if content is not None else None
            yield n is not None, n, None, None
        except ArchiveError as e:
            yield False, None, e.kind, e.detail


def _each(f):
    return lambda x: None if x is None else f(x)


def register(spark: SparkSession) -> None:
    """archive_entries, archive_contents and archive_verify (content, format) as table functions; unpack_stream(content),
    stream_format(content) and archive_extract(content, format, idx) as scalar ones."""
    spark.udtf.register("archive_entries", F.udtf(ArchiveEntries, returnType="idx bigint, name string, kind string, size bigint, crc32 bigint, is_safe_path boolean"))
    spark.udtf.register("archive_contents", F.udtf(ArchiveContents, returnType="idx bigint, name string, size bigint, content binary"))
    spark.udtf.register("archive_verify", F.udtf(ArchiveVerify, returnType="ok boolean, members bigint, error_kind string, error_detail string"))

    @F.pandas_udf("binary")
    def unpack_stream(content: pd.Series) -> pd.Series:
        return content.map(_each(lambda x: StreamReader(x).read()))

    @F.pandas_udf("string")
    def stream_format(content: pd.Series) -> pd.Series:
        return content.map(_each(detect))

    @F.pandas_udf("binary")
    def archive_extract(content: pd.Series, format: pd.Series, idx: pd.Series) -> pd.Series:
        def one(c, f, i):
            a = open_archive(c, f) if c is not None else None
            return a.read(int(i)) if a is not None and 0 <= i < len(a.entries) else None

        return pd.Series([one(*x) for x in zip(content, format, idx)], dtype=object)

    for name, f in (("unpack_stream", unpack_stream), ("stream_format", stream_format), ("archive_extract", archive_extract)):
        spark.udf.register(name, f)
