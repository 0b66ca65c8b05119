"""A Python data source: spark.read.format("granary").option("format", "zip").option("table", "entries").load(path).

One archive is one partition. Files come through pyarrow's file systems (local paths and the URIs it knows);
`read_archives` reads whatever Spark reads. Filters on path and idx are pushed down: files that don't match aren't
opened, and of contents only the asked-for members are decoded.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from .. import schemas
from ..formats import open_archive
from ..formats.streams import StreamReader
from ..limits import Context, Limits

_TABLES = ("entries", "archives", "contents")


@dataclass
class File(InputPartition):
    path: str


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "granary"

    def _what(self) -> tuple[str, str]:
        format, table = self.options.get("format", "zip"), self.options.get("table", "entries")
        if table not in _TABLES:
            raise ValueError(f"table is one of {_TABLES}")
        return format, table

    def schema(self) -> str:
        format, table = self._what()
        if format == "stream":
            return schemas.STREAM_CONTENTS if table == "contents" else schemas.STREAM_INFO
        return {"entries": schemas.ENTRIES, "archives": schemas.ARCHIVES}[table][format] if table != "contents" else schemas.CONTENTS

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(*self._what(), dict(self.options), [f.name for f in schema])


class ArchiveReader(DataSourceReader):
    def __init__(self, format: str, table: str, options: dict, columns: list[str]) -> None:
        self.format, self.table, self.options, self.columns = format, table, options, columns
        self.paths: set[str] | None = None
        self.idx: set[int] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is not None and f.attribute == ("path",):
                self.paths = values if self.paths is None else self.paths & values
            elif values is not None and f.attribute == ("idx",) and self.table != "archives" and self.format != "stream":
                self.idx = values if self.idx is None else self.idx & values
            else:
                yield f

    def _system(self):
        from pyarrow import fs

        path = self.options["path"]
        return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, path = self._system()
        info = system.get_file_info(path)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path, recursive=self.options.get("recursive") == "true"))
        files = sorted(x.path for x in found if x.type == fs.FileType.File)
        return [File(f) for f in files if self.paths is None or f in self.paths]

    def read(self, partition: File) -> Iterator[tuple]:
        system, _ = self._system()
        with system.open_input_stream(partition.path) as f:
            data = f.read()
        ctx = Context(Limits.of(self.options))
        for row in self._rows(data, ctx):
            row["path"] = partition.path
            yield tuple(self._value(row.get(c)) for c in self.columns)

    @staticmethod
    def _value(x):
        return tuple(x.values()) if isinstance(x, dict) else x

    def _rows(self, data: bytes, ctx: Context) -> Iterator[dict]:
        if self.format == "stream":
            s = StreamReader(data, ctx)
            if self.table != "contents":
                yield s.info
                return
            out = s.read()
            yield {"format": s.format, "size": len(out), "frames_decoded": s.frames, "checksums_verified": s.checksums, "content": out}
            return
        a = open_archive(data, self.format, ctx)
        if self.table == "archives":
            yield a.archive | {"input_bytes": len(data), "entries": len(a.entries)}
        elif self.table == "entries":
            yield from (e for e in a.entries if self.idx is None or e["idx"] in self.idx)
        else:
            pairs = a.members() if self.idx is None else ((i, a.read(i)) for i in sorted(self.idx) if 0 <= i < len(a.entries))
            for i, content in pairs:
                yield {"idx": i, "name": a.entries[i]["name"], "size": len(content), "content": content}


def register(spark: SparkSession) -> None:
    """Registers the source; it needs filter pushdown for Python sources, which this turns on."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ArchiveSource)
