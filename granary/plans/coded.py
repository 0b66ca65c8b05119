"""Round-trip queries over coders, filters, ciphers, errors and SQL functions: a row's bytes come back only through the reader.

Packers come from zlib, bz2, liblzma and pyarrow; encrypted archives are written here, since no library of the box writes them.
"""

from __future__ import annotations

import bz2
import hashlib
import hmac
import lzma
import struct
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..codecs import aes
from ..functions import register
from ..limits import Limits
from ..operators import tables
from . import authoring
from .authoring import Members, uint_7z

#: packed bytes, the folder's coders and binds, and the sizes of the coders' outputs but the first
Packed = tuple[bytes, bytes, list[int]]


def _code() -> bytes:
    """Bytes in which every branch filter finds something to turn: calls of several processors, by a rule."""
    out = b""
    for k in range(64):
        out += b"\xe8" + struct.pack("<i", k * 5) + b"\x90\x90\x90"  # x86
        out += struct.pack("<I", 0xEB000000 | k) + struct.pack(">II", 0x48000001 | k << 2, 0x40000000 | k)  # ARM, PPC, SPARC
        out += struct.pack("<HH", 0xF000 | k, 0xF800 | k) + bytes((k * 37 + i * 11) & 255 for i in range(8))  # Thumb
        branch = 5 << 37 | k << 13
        out += (0x16 | branch << 5 | branch << 46 | branch << 87).to_bytes(16, "little")  # IA-64: a bundle of three branches
    return out


CODE = _code()


def _coder(method: str, props: bytes = b"") -> bytes:
    raw = bytes.fromhex(method)
    return bytes([len(raw) | (0x20 if props else 0)]) + raw + (uint_7z(len(props)) + props if props else b"")


def _chain(*coders: bytes) -> bytes:
    """Coders whose inputs are the next one's output."""
    return uint_7z(len(coders)) + b"".join(coders) + b"".join(uint_7z(i) + uint_7z(i + 1) for i in range(len(coders) - 1))


_LZMA2 = {"id": lzma.FILTER_LZMA2, "preset": 1, "dict_size": 1 << 20}
_LZMA2_CODER = _coder("21", b"\x10")


def _single(method: str, pack: Callable[[bytes], bytes], props: bytes = b"") -> Callable[[bytes], Packed]:
    return lambda data: (pack(data), _chain(_coder(method, props)), [])


def _filtered(method: str, filter: dict, props: bytes = b"") -> Callable[[bytes], Packed]:
    """A filter of liblzma before LZMA2."""
    return lambda data: (lzma.compress(data, lzma.FORMAT_RAW, filters=[filter, _LZMA2]), _chain(_coder(method, props), _LZMA2_CODER), [len(data)])


def _raw_deflate(data: bytes, strategy: int = zlib.Z_DEFAULT_STRATEGY) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, -15, 8, strategy)
    return c.compress(data) + c.flush()


def _literals(data: bytes) -> bytes:
    """Deflate without matches, which means the same in deflate64."""
    return _raw_deflate(data, zlib.Z_HUFFMAN_ONLY)


def _lz4(data: bytes) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.CompressedOutputStream(sink, "lz4") as f:
        f.write(data)
    return sink.getvalue().to_pybytes()


def _swapped(width: int) -> Callable[[bytes], bytes]:
    def run(data: bytes) -> bytes:
        n = len(data) - len(data) % width
        return b"".join(data[i : i + width][::-1] for i in range(0, n, width)) + data[n:]

    return run


def _aes_7z(password: str) -> Callable[[bytes], Packed]:
    """LZMA2, then AES-256 in CBC mode."""

    def run(data: bytes) -> Packed:
        inner, iv = lzma.compress(data, lzma.FORMAT_RAW, filters=[_LZMA2]), bytes(range(16))
        sealed = aes.cbc_encrypt(inner + bytes(-len(inner) % 16), aes.key_7z(password, b"", 4), iv)
        return sealed, _chain(_LZMA2_CODER, _coder("06f10701", bytes([4 | 0x40, 0x0F]) + iv)), [len(inner)]

    return run


#: By coder or filter: how a folder of a 7z archive is packed.
SEVENZIP: dict[str, Callable[[bytes], Packed]] = {
    "lzma": _single("030101", lambda d: lzma.compress(d, lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA1, "preset": 1, "dict_size": 1 << 20}]), b"\x5d" + struct.pack("<I", 1 << 20)),
    "deflate": _single("040108", _raw_deflate),
    "deflate64": _single("040109", _literals),
    "bzip2": _single("040202", bz2.compress),
    "zstd": _single("04f71101", lambda d: pa.compress(d, "zstd", asbytes=True)),
    "brotli": _single("04f71102", lambda d: pa.compress(d, "brotli", asbytes=True)),
    "lz4": _single("04f71104", _lz4),
    "swap2": _single("020302", _swapped(2)),
    "swap4": _single("020304", _swapped(4)),
    "delta": _filtered("03", {"id": lzma.FILTER_DELTA, "dist": 4}, b"\x03"),
    "x86": _filtered("03030103", {"id": lzma.FILTER_X86}),
    "ppc": _filtered("03030205", {"id": lzma.FILTER_POWERPC}),
    "ia64": _filtered("03030401", {"id": lzma.FILTER_IA64}),
    "arm": _filtered("03030501", {"id": lzma.FILTER_ARM}),
    "thumb": _filtered("03030701", {"id": lzma.FILTER_ARMTHUMB}),
    "sparc": _filtered("03030805", {"id": lzma.FILTER_SPARC}),
}


def zip_raw(members: list[tuple[str, int, int, int, int, bytes, bytes]]) -> bytes:
    """A ZIP archive of (name, method, flags, crc32, size, stored bytes, extra field)."""
    out, central = b"", b""
    for name, method, flags, crc, size, data, extra in members:
        raw = name.encode()
        fields = struct.pack("<HHHHHIIIHH", 63, flags | 0x800, method, 0, 0x5021, crc, len(data), size, len(raw), len(extra))
        central += b"PK\1\2" + struct.pack("<H", 63) + fields + struct.pack("<HHHII", 0, 0, 0, 0, len(out)) + raw + extra
        out += b"PK\3\4" + fields + raw + extra + data
    return out + central + b"PK\5\6" + struct.pack("<HHHHIIH", 0, 0, len(members), len(members), len(central), len(out), 0)


def zip_packed(members: Members, method: int, pack: Callable[[bytes], bytes]) -> bytes:
    return zip_raw([(name, method, 0, zlib.crc32(data), len(data), pack(data), b"") for name, data in members])


def _crc_step(crc: int, byte: int) -> int:
    """CRC-32's register after a byte, without the complements that zlib makes."""
    return zlib.crc32(bytes((byte,)), crc ^ 0xFFFFFFFF) ^ 0xFFFFFFFF


def zip_traditional(members: Members, password: bytes) -> bytes:
    """Stored members under ZipCrypto."""

    def sealed(data: bytes) -> bytes:
        keys = [0x12345678, 0x23456789, 0x34567890]

        def follow(p: int) -> None:
            keys[0] = _crc_step(keys[0], p)
            keys[1] = ((keys[1] + (keys[0] & 255)) * 134775813 + 1) & 0xFFFFFFFF
            keys[2] = _crc_step(keys[2], keys[1] >> 24)

        for p in password:
            follow(p)
        out = bytearray()
        for p in bytes(11) + bytes([zlib.crc32(data) >> 24]) + data:
            t = keys[2] | 2
            out.append(p ^ (t * (t ^ 1) >> 8) & 255)
            follow(p)
        return bytes(out)

    return zip_raw([(name, 0, 1, zlib.crc32(data), len(data), sealed(data), b"") for name, data in members])


def zip_aes(members: Members, password: bytes) -> bytes:
    """Deflated members under WinZip AES (AE-2), the key sizes in turn."""
    rows = []
    for k, (name, data) in enumerate(members):
        bits = (128, 192, 256)[k % 3]
        salt = hashlib.sha256(name.encode()).digest()[: bits // 16]
        key, auth, check = aes.keys_winzip(password, salt, bits)
        body = aes.ctr(_raw_deflate(data), key)
        extra = struct.pack("<HHH2sBH", 0x9901, 7, 2, b"AE", k % 3 + 1, 8)
        rows.append((name, 99, 1, 0, len(data), salt + check + body + hmac.new(auth, body, hashlib.sha1).digest()[:10], extra))
    return zip_raw(rows)


def build(doc_archives, digests, doc_id, packed) -> tuple[dict[str, Callable[[SparkSession, str], DataFrame]], dict[str, str]]:
    """The queries and their SQL, made with the helpers of the module of queries."""

    def plain(format: str, write):
        return lambda spark, sf_dir: digests(tables.contents(doc_archives(spark, sf_dir, write), format))

    def turned(pack):
        """Members with machine code before their text."""

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            a = doc_archives(spark, sf_dir, lambda _, m: authoring.sevenzip_archive([(n, CODE + d) for n, d in m], pack))
            text = F.expr(f"substring(content, {len(CODE) + 1})")
            return tables.contents(a, "7z").select(doc_id().alias("doc_id"), (F.col("size") - len(CODE)).alias("n_bytes"), F.sha2(text, 256).alias("sha"), (F.sha2(F.substring("content", 1, len(CODE)), 256) == hashlib.sha256(CODE).hexdigest()).alias("code"))

        return run

    def locked(spark: SparkSession, sf_dir: str, write, password: str = "pw-") -> DataFrame:
        """Archives with a password of their own in a column."""
        a = doc_archives(spark, sf_dir, write)
        return a.withColumn("password", F.concat(F.lit(password), "path"))

    def opened(format: str, write):
        return lambda spark, sf_dir: digests(tables.contents(locked(spark, sf_dir, write), format, password="password"))

    def failed(df: DataFrame) -> DataFrame:
        told = df.groupBy("path").agg(F.count("error").alias("errors"), F.count("idx").alias("good"), F.max("error.kind").alias("kind"))
        return told.agg(F.min("errors").alias("least"), F.max("errors").alias("most"), F.sum("good").alias("good"), F.max("kind").alias("kind"))

    sealed_zip = lambda path, m: zip_aes(m, f"pw-{path}".encode())

    def zip_wrong_password(spark: SparkSession, sf_dir: str) -> DataFrame:
        return failed(tables.contents(locked(spark, sf_dir, sealed_zip, "no-"), "zip", mode="PERMISSIVE", password="password"))

    def zip_no_password(spark: SparkSession, sf_dir: str) -> DataFrame:
        return failed(tables.contents(doc_archives(spark, sf_dir, sealed_zip), "zip", mode="PERMISSIVE"))

    def zip_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
        return failed(tables.contents(doc_archives(spark, sf_dir, lambda _, m: authoring.zip_archive(m)), "zip", mode="PERMISSIVE", limits=Limits(max_files=1)))

    def sevenzip_missing_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
        """The last of three parts is missing."""

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for r in b.to_pylist():
                    step = -(-len(r["content"]) // 3)
                    rows = [{"path": f"{r['path']}.7z.{k + 1:03d}", "content": r["content"][k * step : (k + 1) * step]} for k in range(2)]
                    yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("path", pa.string()), ("content", pa.binary())]))

        a = doc_archives(spark, sf_dir, lambda _, m: authoring.sevenzip_archive(m))
        return failed(tables.contents(tables.assemble_volumes(a.mapInArrow(cut, "path string, content binary")), "7z", mode="PERMISSIVE"))

    def cpio_symlinks(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
        a = packed(d, F.concat("doc_id", F.lit(".txt")), F.concat(F.lit("to/"), "doc_id"), lambda _, m: authoring.cpio_archive(m, mode=0o120777), F.col("doc_id"))
        return tables.symlink_targets(a).select(doc_id().alias("doc_id"), F.decode("content", "UTF-8").alias("target"))

    def deb_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
        """The outer members' own bytes."""
        m = tables.deb_member_contents(doc_archives(spark, sf_dir, lambda _, m: authoring.deb_archive(m)))
        return m.where("idx = 0").select("name", "size", F.sha2("content", 256).alias("sha")).distinct()

    def sql_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Entries by the table function, each member by the scalar one."""
        register(spark)
        a = doc_archives(spark, sf_dir, lambda _, m: authoring.zip_archive(m))
        return digests(spark.sql("SELECT e.name, e.size, archive_extract(f.content, 'zip', e.idx) AS content FROM {files} f, LATERAL archive_entries(f.content, 'zip') e", files=a))

    def sql_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
        register(spark)
        a = doc_archives(spark, sf_dir, lambda _, m: authoring.cpio_archive(m, "crc"))
        return spark.sql("SELECT sum(v.members) AS members, min(v.ok) AS ok FROM {files} f, LATERAL archive_verify(f.content, 'cpio') v", files=a)

    def sql_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Texts as zstd streams, told and unpacked by scalar functions."""
        register(spark)
        a = doc_archives(spark, sf_dir, lambda _, m: pa.compress(b"\0".join(d for _, d in m), "zstd", asbytes=True))
        return spark.sql("SELECT stream_format(content) AS format, sum(octet_length(unpack_stream(content)) + 1) AS bytes FROM {files} GROUP BY 1", files=a)

    filters = ("delta", "x86", "ppc", "ia64", "arm", "thumb", "sparc", "swap2", "swap4")
    text = "SELECT doc_id, CAST(strlen(text) AS BIGINT) AS n_bytes, sha256(text) AS sha"
    every, none = f"{text} FROM documents", "SELECT CAST(1 AS BIGINT) AS least, CAST(1 AS BIGINT) AS most, CAST(0 AS BIGINT) AS good, '{}' AS kind"
    queries, sql = {}, {}
    for name, pack in SEVENZIP.items():
        queries[f"sevenzip_{name}"] = turned(pack) if name in filters else plain("7z", lambda _, m, pack=pack: authoring.sevenzip_archive(m, pack))
        sql[f"sevenzip_{name}"] = f"{text}, true AS code FROM documents" if name in filters else every
    for name, method, pack in (("deflate64", 9, _literals), ("zstd", 93, lambda d: pa.compress(d, "zstd", asbytes=True)), ("xz", 95, lambda d: lzma.compress(d, preset=1))):
        queries[f"zip_{name}"], sql[f"zip_{name}"] = plain("zip", lambda _, m, method=method, pack=pack: zip_packed(m, method, pack)), every
    ciphers = {
        "zip_traditional": ("zip", lambda path, m: zip_traditional(m, f"pw-{path}".encode())),
        "zip_aes": ("zip", sealed_zip),
        "sevenzip_aes": ("7z", lambda path, m: authoring.sevenzip_archive(m, _aes_7z(f"pw-{path}"))),
    }
    for name, (format, write) in ciphers.items():
        queries[name], sql[name] = opened(format, write), every
    for query, kind in ((zip_wrong_password, "wrong_password_or_corrupt"), (zip_no_password, "password_required"), (zip_limits, "limit_exceeded"), (sevenzip_missing_volume, "missing_volume")):
        queries[query.__name__], sql[query.__name__] = query, none.format(kind)
    queries |= {f.__name__: f for f in (cpio_symlinks, deb_outer, sql_extract, sql_verify, sql_streams)}
    sql |= {
        "cpio_symlinks": "SELECT doc_id, 'to/' || doc_id AS target FROM documents",
        "deb_outer": "SELECT 'debian-binary' AS name, CAST(4 AS BIGINT) AS size, sha256('2.0' || chr(10)) AS sha",
        "sql_extract": every,
        "sql_verify": "SELECT count(*) AS members, true AS ok FROM documents",
        "sql_streams": "SELECT 'zstd' AS format, CAST(sum(strlen(text) + 1) AS BIGINT) AS bytes FROM documents",
    }
    return queries, sql
