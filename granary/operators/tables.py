"""DataFrames of archive bytes in, typed rows out.

Every function takes a DataFrame with `path` and `content` (what `binaryFile` gives) and a format's name. An archive is one
unit of work: it is parsed where its bytes are, in Arrow batches, and nothing is collected. Headers are read without
decoding members by `entries`; `contents` gives a member's row only after all of its check sums were tested.

mode: FAILFAST raises the typed error; PERMISSIVE adds a column `error` and gives what is good and then one row with the
error; DROPMALFORMED leaves failing archives' remaining rows out.

password: a column with each archive's own password (a string or bytes; null: none), before `secret`, an environment variable of
the executors for all of them.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .. import schemas
from ..errors import ArchiveError, FormatError, MissingVolumeError
from ..formats import open_archive
from ..formats.base import Reader
from ..formats.streams import StreamReader
from ..limits import Budget, Context, Limits

MODES = ("FAILFAST", "PERMISSIVE", "DROPMALFORMED")
#: Rows of output are handed on when they hold about so many bytes, or so many rows.
FLUSH_BYTES, FLUSH_ROWS = 16 << 20, 4096

Rows = Callable[[bytes, Context], Iterator[dict]]


def _context(limits: Limits, units: int, secret: str | None, password: str | bytes | None) -> Context:
    """An archive's own password, or the one that `secret` names: an environment variable of the executors, so that it stands in no
    plan and no column."""
    return Context(limits, Budget(units), password if password is not None else os.environ.get(secret) if secret else None)


def _table(df: DataFrame, rows: Rows, schema: str, mode: str, limits: Limits | None, units: int, secret: str | None, password: str | None = None) -> DataFrame:
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    limits = limits or Limits()
    schema = f"{schema}, {schemas.ERROR}" if mode == "PERMISSIVE" else schema
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    keep = [F.col(c) for c in ("path", "content", "expected") if c in df.columns]
    if password is not None:
        keep.append(F.col(password).alias("_password"))

    def of(path: str | None, content: bytes | None, expected: str | None, own: str | bytes | None) -> Iterator[dict]:
        try:
            if content is None:
                raise FormatError("no bytes")
            yield from rows(content, _context(limits, units, secret, own))
        except Exception as e:
            # whatever a reader trips over is the fault of one file: it gets a typed row like any other
            e = e if isinstance(e, ArchiveError) else ArchiveError(f"{type(e).__name__}: {e}")
            if expected and "needs" in e.fields:
                e = MissingVolumeError(f"a part is missing: {expected}", expected=expected)
            if mode == "FAILFAST":
                e.detail = f"{path}: {e.detail}"
                e.args = (e.detail,)
                raise e
            if mode == "PERMISSIVE":
                yield {"error": e.as_row()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                for r in of(row["path"], row["content"], row.get("expected"), row.get("_password")):
                    r["path"] = row["path"]
                    out.append(r)
                    size += len(r.get("content") or b"") + 100
                    if size >= FLUSH_BYTES or len(out) >= FLUSH_ROWS:
                        yield pa.RecordBatch.from_pylist(out, schema=arrow)
                        out, size = [], 0
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return df.select(*keep).mapInArrow(run, schema)


def _of(format: str, each: Callable[[Reader], Iterator[dict]]) -> Rows:
    return lambda content, ctx: each(open_archive(content, format, ctx))


def entries(df: DataFrame, format: str, mode: str = "FAILFAST", limits: Limits | None = None, secret: str | None = None, units: int = 1_000_000_000, password: str | None = None) -> DataFrame:
    """A row for each member, in archive order (`idx`)."""
    return _table(df, _of(format, lambda a: iter(a.entries)), schemas.ENTRIES[format], mode, limits, units, secret, password)


def archives(df: DataFrame, format: str, mode: str = "FAILFAST", limits: Limits | None = None, secret: str | None = None, units: int = 1_000_000_000, password: str | None = None) -> DataFrame:
    """A row for each archive: what its own headers say, its bytes and number of members."""
    return _table(df, _of(format, lambda a: iter([a.archive | {"input_bytes": len(a.data), "entries": len(a.entries)}])), schemas.ARCHIVES[format], mode, limits, units, secret, password)


def _contents(a: Reader, wanted: set[int] | None) -> Iterator[dict]:
    pairs = a.members() if wanted is None else ((i, a.read(i)) for i in sorted(wanted) if 0 <= i < len(a.entries))
    for i, data in pairs:
        yield {"idx": i, "name": a.entries[i]["name"], "size": len(data), "content": data}


def contents(df: DataFrame, format: str, idx: list[int] | None = None, mode: str = "FAILFAST", limits: Limits | None = None, secret: str | None = None, units: int = 1_000_000_000, password: str | None = None) -> DataFrame:
    """A row with the verified bytes of each member, or of those with the given numbers alone. Shared data is decoded once.
    7z has no rows for directories and anti-items; other formats have a row for every member."""
    wanted = None if idx is None else set(idx)
    return _table(df, _of(format, lambda a: _contents(a, wanted)), schemas.CONTENTS, mode, limits, units, secret, password)


def _verified(a: Reader) -> Iterator[dict]:
    n = a.verify()
    yield {"ok": True, "members": n, "output_bytes": a.ctx.produced}


def verify(df: DataFrame, format: str, limits: Limits | None = None, secret: str | None = None, units: int = 1_000_000_000, password: str | None = None) -> DataFrame:
    """A row for each archive: ok, members, output_bytes, and the error of the first check that failed."""
    out = _table(df, _of(format, _verified), schemas.VERIFY, "PERMISSIVE", limits, units, secret, password)
    return out.withColumn("ok", F.coalesce("ok", F.lit(False)))


def deb_members(df: DataFrame, mode: str = "FAILFAST", limits: Limits | None = None, units: int = 1_000_000_000) -> DataFrame:
    """The outer members of Debian packages."""
    return _table(df, _of("deb", lambda a: ({k: v for k, v in m.items() if k != "at"} for m in a.outer)), schemas.DEB_MEMBERS, mode, limits, units, None)


def deb_member_contents(df: DataFrame, mode: str = "FAILFAST", limits: Limits | None = None, units: int = 1_000_000_000) -> DataFrame:
    """The outer members' bytes as they are stored."""
    each = lambda a: ({"idx": i, "name": m["name"], "size": m["size"], "content": a.read_outer(i)} for i, m in enumerate(a.outer))
    return _table(df, _of("deb", each), schemas.CONTENTS, mode, limits, units, None)


def rpm_tags(df: DataFrame, mode: str = "FAILFAST", limits: Limits | None = None, units: int = 1_000_000_000) -> DataFrame:
    """A row for each header tag, in order, duplicates included; of duplicates the last counts."""
    return _table(df, _of("rpm", lambda a: iter(a.tags())), schemas.RPM_TAGS, mode, limits, units, None)


def folders_7z(df: DataFrame, mode: str = "FAILFAST", limits: Limits | None = None, secret: str | None = None, units: int = 1_000_000_000, password: str | None = None) -> DataFrame:
    """A row for each 7z folder: its coder graph and sizes."""
    return _table(df, _of("7z", lambda a: iter(a.folders())), schemas.FOLDERS_7Z, mode, limits, units, secret, password)


def pack_streams_7z(df: DataFrame, mode: str = "FAILFAST", limits: Limits | None = None, secret: str | None = None, units: int = 1_000_000_000, password: str | None = None) -> DataFrame:
    return _table(df, _of("7z", lambda a: iter(a.pack_streams())), schemas.PACK_STREAMS_7Z, mode, limits, units, secret, password)


def symlink_targets(df: DataFrame, format: str = "cpio", mode: str = "FAILFAST", limits: Limits | None = None, units: int = 1_000_000_000) -> DataFrame:
    """The targets of CPIO or RPM symbolic links, as contents."""

    def each(a: Reader) -> Iterator[dict]:
        for e in a.entries:
            if e["is_symlink"]:
                data = a.read(e["idx"])
                yield {"idx": e["idx"], "name": e["name"], "size": len(data), "content": data}

    return _table(df, _of(format, each), schemas.CONTENTS, mode, limits, units, None)


def stream_info(df: DataFrame, format: str | None = None, mode: str = "FAILFAST", limits: Limits | None = None, units: int = 1_000_000_000) -> DataFrame:
    """A row for each compressed stream, from its frames' headers alone. Without a format it is told by its magic number."""
    return _table(df, lambda content, ctx: iter([StreamReader(content, ctx, format).info]), schemas.STREAM_INFO, mode, limits, units, None)


def unpack_streams(df: DataFrame, format: str | None = None, mode: str = "FAILFAST", limits: Limits | None = None, units: int = 1_000_000_000) -> DataFrame:
    """A row with each stream's verified bytes, and how many frames and check sums that took."""

    def rows(content: bytes, ctx: Context) -> Iterator[dict]:
        s = StreamReader(content, ctx, format)
        out = s.read()
        yield {"format": s.format, "size": len(out), "frames_decoded": s.frames, "checksums_verified": s.checksums, "content": out}

    return _table(df, rows, schemas.STREAM_CONTENTS, mode, limits, units, None)


def members(**entry_tables: DataFrame) -> DataFrame:
    """One narrow view over entries of several formats: members(zip=..., deb=..., sevenz=...) ->
    path, format, member_index, name, size, kind, is_safe_path."""

    def narrow(format: str, df: DataFrame) -> DataFrame:
        kind: Column = F.col("kind") if "kind" in df.columns else F.when(F.col("is_directory"), "directory").when(F.col("is_symlink"), "symlink").otherwise("file")
        return df.select("path", F.lit("7z" if format == "sevenz" else format).alias("format"), F.col("idx").alias("member_index"), "name", "size", kind.alias("kind"), "is_safe_path")

    return reduce(DataFrame.unionByName, [narrow(k, v) for k, v in entry_tables.items()])


def assemble_volumes(df: DataFrame) -> DataFrame:
    """Volume sets (name.001, name.002, ...) as whole archives: path (the name without a number), content, volumes, expected.

    Parts are joined up to the first that is missing, whose name is `expected`; whether more was needed is for the
    header to say, and then a reader's error names it. Files without a number stay as they are. A set is one archive
    and so one unit of work; its parts meet in one task.
    """
    number = F.regexp_extract("path", r"\.(\d{3,})$", 1)
    marked = df.select("path", "content", F.when(number != "", F.regexp_replace("path", r"\.\d{3,}$", "")).alias("base"), F.when(number != "", number.cast("int")).alias("seq"), F.length(number).alias("digits"))
    single = marked.where("base is null").select("path", "content", F.lit(1).alias("volumes"), F.lit(None).cast("string").alias("expected"))
    sets = marked.where("base is not null").groupBy("base").agg(F.sort_array(F.collect_list(F.struct("seq", "content"))).alias("parts"), F.min("digits").alias("digits"))
    schema = "path string, content binary, volumes int, expected string"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                held, n = [], 0
                for p in r["parts"]:
                    if p["seq"] != n + 1:
                        break
                    held.append(p["content"])
                    n += 1
                row = {"path": r["base"], "content": b"".join(held) if n else None, "volumes": n, "expected": f"{r['base']}.{n + 1:0{r['digits']}d}"}
                yield pa.RecordBatch.from_pylist([row], schema=arrow)

    return single.unionByName(sets.mapInArrow(run, schema))
