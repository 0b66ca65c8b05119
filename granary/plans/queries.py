"""Round-trip queries: rows of a table are packed into archives, and only the archives' bytes feed the result.

The SQL twin is told over the source table, so it shares nothing with the readers. Archives are made in a distributed
way, in pieces of bounded size: rows are dealt by a hash of their key into `parts` archives.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns, register, rpm
from ..operators import tables
from . import authoring, coded

#: Rows of an archive, about.
PER_ARCHIVE = 200


def _packed(df: DataFrame, name: Column, data: Column, write: Callable[[str, list[tuple[str, bytes]]], bytes], key: Column, suffix: str = "") -> DataFrame:
    """path, content: df's rows as members of archives of about PER_ARCHIVE rows."""
    parts = max(1, df.count() // PER_ARCHIVE)
    rows = df.select(F.pmod(F.xxhash64(key), F.lit(parts)).cast("int").alias("part"), name.alias("name"), F.coalesce(data.cast("binary"), F.lit(b"")).alias("data"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        path = f"part-{pdf['part'].iloc[0]:05d}{suffix}"
        members = sorted(zip(pdf["name"], map(bytes, pdf["data"])))
        return pd.DataFrame({"path": [path], "content": [write(path, members)]})

    return rows.groupBy("part").applyInPandas(one, "path string, content binary")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")


def _doc_archives(spark: SparkSession, sf_dir: str, write) -> DataFrame:
    d = _docs(spark, sf_dir)
    return _packed(d, F.concat_ws("/", "source", F.concat("doc_id", F.lit(".txt"))), F.col("text"), write, F.col("doc_id"))


def _id() -> Column:
    return F.regexp_extract("name", r"(\d+)\.txt$", 1).cast("long")


def _source() -> Column:
    return F.regexp_extract("name", "^([^/]*)/", 1)


def _digests(contents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, sha of each member."""
    return contents.select(_id().alias("doc_id"), F.col("size").alias("n_bytes"), F.sha2("content", 256).alias("sha"))


_DIGESTS = "SELECT doc_id, CAST(strlen(text) AS BIGINT) AS n_bytes, sha256(text) AS sha FROM documents"


def zip_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members, bytes and distinct contents by source, from verified ZIP members."""
    c = tables.contents(_doc_archives(spark, sf_dir, lambda _, m: authoring.zip_archive(m)), "zip")
    c = c.select(_source().alias("source"), "size", F.sha2("content", 256).alias("sha"))
    return c.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.countDistinct("sha").alias("uniq"))


def zip_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ZIP headers alone: sizes, check sums' presence, kinds, methods."""
    e = tables.entries(_doc_archives(spark, sf_dir, lambda _, m: authoring.zip_archive(m)), "zip")
    return e.select(_id().alias("doc_id"), "size", "compression_method", "encryption", "is_directory", "is_safe_path", (F.col("crc32") >= 0).alias("has_crc"), F.col("modified.year").alias("year"))


def _zip_method(method: int):
    return lambda spark, sf_dir: _digests(tables.contents(_doc_archives(spark, sf_dir, lambda _, m: authoring.zip_archive(m, method)), "zip"))


def zip_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every archive verified; totals over all of them."""
    v = tables.verify(_doc_archives(spark, sf_dir, lambda _, m: authoring.zip_archive(m)), "zip")
    return v.agg(F.sum("members").alias("members"), F.sum("output_bytes").alias("bytes"), F.min("ok").alias("ok"))


def zip_damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives whose last member's data is damaged: the good members, and one check sum error each."""

    def write(_: str, members):
        data = bytearray(authoring.zip_archive(members, zipfile.ZIP_STORED))
        spot = data.index(b"PK\1\2") - 1
        data[spot] ^= 1
        return bytes(data)

    d = _docs(spark, sf_dir).where("length(text) > 0")
    a = _packed(d, F.concat("doc_id", F.lit(".txt")), F.col("text"), write, F.col("doc_id"))
    c = tables.contents(a, "zip", mode="PERMISSIVE")
    n = a.select("path").distinct()
    told = c.groupBy("path").agg(F.count("error").alias("errors"), F.max("error.kind").alias("kind"), F.max("error.scope").alias("scope"))
    return told.join(n, "path").agg(F.min("errors").alias("least"), F.max("errors").alias("most"), F.max("kind").alias("kind"), F.max("scope").alias("scope"))


def deb_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _doc_archives(spark, sf_dir, lambda path, m: authoring.deb_archive(m, list(authoring.PACKERS)[int(path[5:10]) % len(authoring.PACKERS)]))
    c = tables.contents(a, "deb").where("name <> 'control'")
    return _digests(c)


def deb_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = tables.deb_members(_doc_archives(spark, sf_dir, lambda _, m: authoring.deb_archive(m)))
    return m.groupBy("kind", "name").agg((F.count("*") > 0).alias("present"), F.max("idx").alias("idx"))


def _cpio(layout: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        a = _doc_archives(spark, sf_dir, lambda _, m: authoring.cpio_archive(m, layout))
        return _digests(tables.contents(a, "cpio"))

    return run


def cpio_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as CSV lines in CPIO members, read back, parsed and summed by priority."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    line = F.concat_ws("|", "o_orderkey", "o_orderpriority", "o_totalprice")
    a = _packed(o, F.concat("o_orderkey", F.lit(".csv")), line, lambda _, m: authoring.cpio_archive(m, "crc"), F.col("o_orderkey"))
    parts = F.split(F.decode("content", "UTF-8"), r"\|")
    c = tables.contents(a, "cpio").select(parts[1].alias("priority"), parts[0].cast("long").alias("orderkey"))
    return c.groupBy("priority").agg(F.count("*").alias("n"), F.sum("orderkey").alias("keys"), F.min("orderkey").alias("first_key"))


def rpm_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digests(tables.contents(_doc_archives(spark, sf_dir, lambda path, m: authoring.rpm_archive(path, m)), "rpm"))


def rpm_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages' tags by name."""
    t = tables.rpm_tags(_doc_archives(spark, sf_dir, lambda path, m: authoring.rpm_archive(path, m)))
    named = rpm.named_tags(t).where("section = 'main' and tag_name in ('VERSION', 'PAYLOADFORMAT', 'PAYLOADCOMPRESSOR')")
    return named.select("tag_name", F.get("texts", F.lit(0)).alias("value")).distinct()


def sevenzip_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Solid LZMA2 archives with encoded headers."""
    a = _doc_archives(spark, sf_dir, lambda _, m: authoring.sevenzip_archive(m, "lzma2", True, True))
    return _digests(tables.contents(a, "7z"))


def sevenzip_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-solid archives: one folder for each member with data."""
    a = _doc_archives(spark, sf_dir, lambda _, m: authoring.sevenzip_archive(m, "copy", False))
    f = tables.folders_7z(a)
    return f.agg(F.count("*").alias("folders"), F.sum(F.get("unpack_sizes", F.lit(0))).alias("bytes"), F.max(F.col("is_encrypted").cast("int")).alias("encrypted"), F.max(F.get("coders", F.lit(0))["method"]).alias("method"))


def sevenzip_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """7z archives cut into three parts, put together again."""
    a = _doc_archives(spark, sf_dir, lambda _, m: authoring.sevenzip_archive(m))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                step = -(-len(r["content"]) // 3)
                rows += [{"path": f"{r['path']}.7z.{k + 1:03d}", "content": r["content"][k * step : (k + 1) * step]} for k in range(3)]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("path", pa.string()), ("content", pa.binary())]))

    return _digests(tables.contents(tables.assemble_volumes(a.mapInArrow(cut, "path string, content binary")), "7z"))


def arj_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digests(tables.contents(_doc_archives(spark, sf_dir, lambda _, m: authoring.arj_archive(m)), "arj"))


def _stream(write: Callable[[bytes], bytes]) -> Callable[[SparkSession, str], DataFrame]:
    """Events as JSON lines in one compressed stream for each of some groups."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = spark.read.parquet(f"{sf_dir}/events.parquet")
        line = F.concat_ws("|", "event_id", "event_type")
        a = _packed(e, F.format_string("%020d", "event_id"), line, lambda _, m: write(b"\n".join(d for _, d in m)), F.col("event_id"))
        lines = tables.unpack_streams(a).select(F.explode(F.split(F.decode("content", "UTF-8"), "\n")).alias("line"))
        parts = F.split("line", r"\|")
        return lines.groupBy(parts[1].alias("event_type")).agg(F.count("*").alias("n"), F.sum(parts[0].cast("long")).alias("ids"))

    return run


def _frames(data: bytes, kind: str) -> bytes:
    """Two frames."""
    half = len(data) // 2
    out = b""
    for part in (data[:half], data[half:]):
        sink = pa.BufferOutputStream()
        with pa.CompressedOutputStream(sink, kind) as f:
            f.write(part)
        out += sink.getvalue().to_pybytes()
    return out


def stream_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame counts of two-frame streams, without decoding."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    a = _packed(e, F.col("event_id").cast("string"), F.col("event_type"), lambda _, m: _frames(b"".join(d for _, d in m), "zstd"), F.col("event_id"))
    i = tables.stream_info(a)
    return i.groupBy("format").agg(F.min("frame_count").alias("least"), F.max("frame_count").alias("most"), F.max("skippable_frame_count").alias("skippable"))


def safe_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The path policy as a column expression, over names made from the parts of urls."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    raw = F.regexp_replace("url", "^https?:", "")
    name = F.element_at(F.array(raw, F.concat(F.lit("a/../"), raw), F.concat(F.lit("C:"), raw), F.substr(raw, F.lit(3)), F.lit("")), (F.col("page_id") % 5 + 1).cast("int"))
    return p.select("page_id", columns.unsafe_path_reason(name).alias("reason"))


def members_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One view over the entries of three formats."""
    write = {"zip": authoring.zip_archive, "cpio": authoring.cpio_archive, "arj": authoring.arj_archive}
    e = {f: tables.entries(_doc_archives(spark, sf_dir, lambda _, m, w=w: w(m)), f) for f, w in write.items()}
    return tables.members(**e).groupBy("format").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.min("is_safe_path").alias("safe"))


def _rewritten(format: str, write: Callable[[str, list[tuple[str, bytes]]], bytes]) -> Callable[[SparkSession, str], DataFrame]:
    """Digests of all documents out of archives that `write` makes."""
    return lambda spark, sf_dir: _digests(tables.contents(_doc_archives(spark, sf_dir, write), format))


def _zip_as_it_comes(members: list[tuple[str, bytes]], seekable: bool, zip64: bool) -> bytes:
    """A ZIP archive whose sizes follow the data, as a pipe's writer leaves them, or in ZIP64 fields."""
    out = io.BytesIO()

    class Pipe(io.RawIOBase):
        writable = lambda self: True

        def write(self, data) -> int:
            return out.write(data)

    with zipfile.ZipFile(out if seekable else Pipe(), "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in members:
            with z.open(zipfile.ZipInfo(name, (2020, 1, 1, 0, 0, 0)), "w", force_zip64=zip64) as f:
                f.write(data)
    return out.getvalue()


def _entry_sizes(format: str, write) -> Callable[[SparkSession, str], DataFrame]:
    """Headers alone: a member's number and size."""
    return lambda spark, sf_dir: tables.entries(_doc_archives(spark, sf_dir, write), format).select(_id().alias("doc_id"), F.col("size").alias("n_bytes"), "is_safe_path")


def _verified(format: str, write) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        v = tables.verify(_doc_archives(spark, sf_dir, write), format)
        return v.agg(F.sum("members").alias("members"), F.sum("output_bytes").alias("bytes"), F.min("ok").alias("ok"))

    return run


def deb_long_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members whose names don't fit a tar header."""
    d = _docs(spark, sf_dir)
    name = F.concat_ws("/", "source", F.repeat(F.lit("deep/"), 40), F.concat("doc_id", F.lit(".txt")))
    return _digests(tables.contents(_packed(d, name, F.col("text"), lambda _, m: authoring.deb_archive(m), F.col("doc_id")), "deb").where("name <> 'control'"))


def sql_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table functions from SQL."""
    register(spark)
    a = _doc_archives(spark, sf_dir, lambda _, m: authoring.zip_archive(m))
    return _digests(spark.sql("SELECT e.* FROM {files} f, LATERAL archive_contents(f.content, 'zip') e", files=a))


_SIZES = "SELECT doc_id, CAST(strlen(text) AS BIGINT) AS n_bytes, true AS is_safe_path FROM documents"
_TOTALS = "SELECT count(*) AS members, CAST(sum(strlen(text)) AS BIGINT) AS bytes, true AS ok FROM documents"

_EVENTS = "SELECT event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY event_type"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "zip_inventory": zip_inventory,
    "zip_entries": zip_entries,
    "zip_stored": _zip_method(zipfile.ZIP_STORED),
    "zip_deflate": _zip_method(zipfile.ZIP_DEFLATED),
    "zip_bzip2": _zip_method(zipfile.ZIP_BZIP2),
    "zip_lzma": _zip_method(zipfile.ZIP_LZMA),
    "zip_verify": zip_verify,
    "zip_damaged": zip_damaged,
    "deb_contents": deb_contents,
    "deb_members": deb_members,
    **{f"cpio_{x}": _cpio(x) for x in ("newc", "crc", "odc", "binary_le", "binary_be")},
    "cpio_orders": cpio_orders,
    "rpm_contents": rpm_contents,
    "rpm_names": rpm_names,
    "sevenzip_contents": sevenzip_contents,
    "sevenzip_folders": sevenzip_folders,
    "sevenzip_volumes": sevenzip_volumes,
    "arj_contents": arj_contents,
    "stream_zstd": _stream(lambda d: _frames(d, "zstd")),
    "stream_lz4": _stream(lambda d: _frames(d, "lz4")),
    "stream_unix_compress": _stream(authoring.z_stream),
    "stream_info": stream_info,
    "safe_paths": safe_paths,
    "members_view": members_view,
    "zip_sfx": _rewritten("zip", lambda _, m: b"MZ program " * 40 + authoring.zip_archive(m)),
    "zip_descriptors": _rewritten("zip", lambda _, m: _zip_as_it_comes(m, False, False)),
    "zip_zip64": _rewritten("zip", lambda _, m: _zip_as_it_comes(m, True, True)),
    "sevenzip_sfx": _rewritten("7z", lambda _, m: b"MZ program " * 40 + authoring.sevenzip_archive(m)),
    "sevenzip_entries": _entry_sizes("7z", lambda _, m: authoring.sevenzip_archive(m)),
    "rpm_entries": _entry_sizes("rpm", lambda path, m: authoring.rpm_archive(path, m)),
    "arj_entries": _entry_sizes("arj", lambda _, m: authoring.arj_archive(m)),
    "cpio_verify": _verified("cpio", lambda _, m: authoring.cpio_archive(m, "crc")),
    "rpm_verify": _verified("rpm", lambda path, m: authoring.rpm_archive(path, m)),
    "arj_verify": _verified("arj", lambda _, m: authoring.arj_archive(m)),
    "sevenzip_verify": _verified("7z", lambda _, m: authoring.sevenzip_archive(m)),
    "deb_long_names": deb_long_names,
    "sql_contents": sql_contents,
}

ORACLE_SQL: dict[str, str] = {
    "zip_inventory": "SELECT source, count(*) AS n, CAST(sum(strlen(text)) AS BIGINT) AS bytes, count(DISTINCT sha256(text)) AS uniq FROM documents GROUP BY source",
    "zip_entries": "SELECT doc_id, CAST(strlen(text) AS BIGINT) AS size, 'deflate' AS compression_method, 'none' AS encryption, false AS is_directory, true AS is_safe_path, true AS has_crc, CAST(2020 AS INTEGER) AS year FROM documents",
    "zip_verify": "SELECT count(*) AS members, CAST(sum(strlen(text)) AS BIGINT) AS bytes, true AS ok FROM documents",
    "zip_damaged": "SELECT CAST(1 AS BIGINT) AS least, CAST(1 AS BIGINT) AS most, 'checksum' AS kind, 'member' AS scope",
    "deb_members": "SELECT * FROM (VALUES ('version', 'debian-binary', true, CAST(0 AS BIGINT)), ('control', 'control.tar.gz', true, CAST(1 AS BIGINT)), ('data', 'data.tar.xz', true, CAST(2 AS BIGINT))) t(kind, name, present, idx)",
    "cpio_orders": "SELECT o_orderpriority AS priority, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys, min(o_orderkey) AS first_key FROM orders GROUP BY 1",
    "rpm_names": "SELECT * FROM (VALUES ('VERSION', '1.0'), ('PAYLOADFORMAT', 'cpio'), ('PAYLOADCOMPRESSOR', 'zstd')) t(tag_name, value)",
    "sevenzip_folders": "SELECT count(*) AS folders, CAST(sum(strlen(text)) AS BIGINT) AS bytes, CAST(0 AS INTEGER) AS encrypted, 'copy' AS method FROM documents WHERE strlen(text) > 0",
    "stream_zstd": _EVENTS,
    "stream_lz4": _EVENTS,
    "stream_unix_compress": _EVENTS,
    "stream_info": "SELECT 'zstd' AS format, CAST(2 AS BIGINT) AS least, CAST(2 AS BIGINT) AS most, CAST(0 AS BIGINT) AS skippable",
    "safe_paths": "SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'unc' WHEN 1 THEN 'traversal' WHEN 2 THEN 'drive' WHEN 4 THEN 'empty' END AS reason FROM pages",
    "members_view": "SELECT f.format, count(*) AS n, CAST(sum(strlen(text)) AS BIGINT) AS bytes, true AS safe FROM documents, (VALUES ('zip'), ('cpio'), ('arj')) f(format) GROUP BY f.format",
} | dict.fromkeys(["zip_stored", "zip_deflate", "zip_bzip2", "zip_lzma", "deb_contents", "cpio_newc", "cpio_crc", "cpio_odc", "cpio_binary_le", "cpio_binary_be", "rpm_contents", "sevenzip_contents", "sevenzip_volumes", "arj_contents", "zip_sfx", "zip_descriptors", "zip_zip64", "sevenzip_sfx", "deb_long_names", "sql_contents"], _DIGESTS) | dict.fromkeys(["sevenzip_entries", "rpm_entries", "arj_entries"], _SIZES) | dict.fromkeys(["cpio_verify", "rpm_verify", "arj_verify", "sevenzip_verify"], _TOTALS)

_MORE = coded.build(_doc_archives, _digests, _id, _packed)
QUERIES |= _MORE[0]
ORACLE_SQL |= _MORE[1]
