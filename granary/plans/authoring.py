"""Small archive writers for round-trip queries and tests: deterministic, not part of the engine's surface.

zip, tar, gzip, bzip2, xz, LZMA and pyarrow's codecs come from independent libraries; the rest follow the formats.
"""

from __future__ import annotations

import bz2
import gzip
import hashlib
import io
import lzma
import struct
import tarfile
import zipfile
import zlib
from collections.abc import Callable

import pyarrow as pa

Members = list[tuple[str, bytes]]
TIME = 1_600_000_000


def zip_archive(members: Members, method: int = zipfile.ZIP_DEFLATED) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for name, data in members:
            z.writestr(zipfile.ZipInfo(name, (2020, 9, 13, 12, 26, 40)), data, method)
    return out.getvalue()


def tar_archive(members: Members, format: int = tarfile.PAX_FORMAT) -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=format) as t:
        for name, data in members:
            info = tarfile.TarInfo(name)
            info.size, info.mtime = len(data), TIME
            t.addfile(info, io.BytesIO(data))
    return out.getvalue()


PACKERS = {"none": bytes, "gzip": lambda d: gzip.compress(d, mtime=0), "bzip2": bz2.compress, "xz": lzma.compress, "lzma": lambda d: lzma.compress(d, lzma.FORMAT_ALONE), "zstd": lambda d: pa.compress(d, "zstd", asbytes=True)}
_SUFFIX = {"none": "", "gzip": ".gz", "bzip2": ".bz2", "xz": ".xz", "lzma": ".lzma", "zstd": ".zst"}


def deb_archive(members: Members, packer: str = "xz") -> bytes:
    control = tar_archive([("control", b"Package: x\nVersion: 1\n")], tarfile.GNU_FORMAT)
    parts = [("debian-binary", b"2.0\n"), ("control.tar.gz", PACKERS["gzip"](control)), ("data.tar" + _SUFFIX[packer], PACKERS[packer](tar_archive(members)))]
    out = b"!<arch>\n"
    for name, data in parts:
        out += b"%-16s%-12d%-6d%-6d%-8o%-10d`\n" % (name.encode(), TIME, 0, 0, 0o100644, len(data)) + data + b"\n" * (len(data) % 2)
    return out


def cpio_archive(members: Members, layout: str = "newc", mode: int = 0o100644) -> bytes:
    out = b""
    for i, (name, data) in enumerate([*members, ("TRAILER!!!", b"")]):
        raw, m = name.encode() + b"\0", mode if i < len(members) else 0
        if layout in ("newc", "crc"):
            total = sum(data) & 0xFFFFFFFF if layout == "crc" else 0
            head = (b"070701" if layout == "newc" else b"070702") + b"".join(b"%08x" % v for v in (i, m, 0, 0, 1, TIME, len(data), 0, 0, 0, 0, len(raw), total))
            out += head + raw
            out += bytes(-len(out) % 4) + data
            out += bytes(-len(out) % 4)
        elif layout == "odc":
            out += b"070707" + b"".join(b"%06o" % v for v in (0, i, m, 0, 0, 1, 0)) + b"%011o%06o%011o" % (TIME, len(raw), len(data)) + raw + data
        else:
            order = "<" if layout == "binary_le" else ">"
            out += struct.pack(order + "13H", 0o070707, 0, i & 0xFFFF, m, 0, 0, 1, 0, TIME >> 16, TIME & 0xFFFF, len(raw), len(data) >> 16, len(data) & 0xFFFF)
            out += raw + bytes(len(raw) % 2) + data + bytes(len(data) % 2)
    return out


def _rpm_header(tags: list[tuple[int, int, list]]) -> bytes:
    index, store = b"", b""
    for tag, kind, values in tags:
        if kind == 4:
            store += bytes(-len(store) % 4)
        index += struct.pack(">IIII", tag, kind, len(store), len(values[0]) if kind == 7 else len(values))
        store += b"".join(struct.pack(">I", v) for v in values) if kind == 4 else values[0] if kind == 7 else b"".join(v.encode() + b"\0" for v in values)
    return b"\x8e\xad\xe8\x01\0\0\0\0" + struct.pack(">II", len(tags), len(store)) + index + store


def rpm_archive(name: str, members: Members, packer: str = "zstd") -> bytes:
    image = cpio_archive(members)
    payload = PACKERS[packer](image)
    main = _rpm_header([(1000, 6, [name]), (1001, 6, ["1.0"]), (1009, 4, [len(image)]), (1124, 6, ["cpio"]), (1125, 6, [packer]), (5092, 8, [hashlib.sha256(payload).hexdigest()]), (5093, 4, [8]), (5097, 8, [hashlib.sha256(image).hexdigest()])])
    signature = _rpm_header([(269, 6, [hashlib.sha1(main).hexdigest()]), (273, 6, [hashlib.sha256(main).hexdigest()])])
    lead = struct.pack(">4sBBHH66sHH16s", b"\xed\xab\xee\xdb", 3, 0, 0, 1, name.encode()[:65], 1, 5, b"")
    out = lead + signature
    return out + bytes(-len(out) % 8) + main + payload


def _arj_record(body: bytes) -> bytes:
    return b"\x60\xea" + struct.pack("<H", len(body)) + body + struct.pack("<I", zlib.crc32(body)) + b"\0\0"


def arj_archive(members: Members) -> bytes:
    out = _arj_record(struct.pack("<8B4I2H2B", 30, 11, 1, 2, 0, 0, 2, 0, 0, 0, 0, 0, 0, 0, 0, 0) + b"x.arj\0\0")
    for name, data in members:
        out += _arj_record(struct.pack("<8B4I3H", 30, 11, 1, 2, 0, 0, 0, 0, 0, len(data), len(data), zlib.crc32(data), 0, 0o644, 0) + name.encode() + b"\0\0") + data
    return out + b"\x60\xea\0\0"


def uint_7z(v: int) -> bytes:
    for n in range(8):
        if v < 1 << (7 * (n + 1)):
            return bytes([0xFF << (8 - n) & 0xFF | v >> (8 * n)]) + (v & ((1 << (8 * n)) - 1)).to_bytes(n, "little")
    return b"\xff" + v.to_bytes(8, "little")


def sevenzip_archive(members: Members, method: str | Callable[[bytes], tuple[bytes, bytes, list[int]]] = "lzma2", solid: bool = True, encode_header: bool = False) -> bytes:
    """Copy or LZMA2 folders, or what `method` makes of a folder's bytes: packed bytes, coders, sizes of inner outputs. Empty members are
    empty files."""
    full = [(n, d) for n, d in members if d]
    groups = [full] if solid and full else [[m] for m in full]

    def pack(data: bytes) -> tuple[bytes, bytes, list[int]]:
        if callable(method):
            return method(data)
        if method == "copy":
            return data, b"\x01\x01\x00", []
        return lzma.compress(data, lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA2, "preset": 1, "dict_size": 1 << 20}]), b"\x01\x21\x21\x01\x10", []

    packed = [pack(b"".join(d for _, d in g)) for g in groups]
    body = b"".join(p for p, _, _ in packed)

    def streams(at: int, sizes: list[int], coders: list[bytes], unpack: list[int], subs: bytes) -> bytes:
        out = b"\x06" + uint_7z(at) + uint_7z(len(sizes)) + b"\x09" + b"".join(map(uint_7z, sizes)) + b"\x00"
        return out + b"\x07\x0b" + uint_7z(len(coders)) + b"\x00" + b"".join(coders) + b"\x0c" + b"".join(map(uint_7z, unpack)) + b"\x00" + subs + b"\x00"

    header = b"\x01"
    if groups:
        subs = b"\x08\x0d" + b"".join(uint_7z(len(g)) for g in groups) + b"\x09" + b"".join(uint_7z(len(d)) for g in groups for _, d in g[:-1])
        subs += b"\x0a\x01" + b"".join(struct.pack("<I", zlib.crc32(d)) for g in groups for _, d in g) + b"\x00"
        header += b"\x04" + streams(0, [len(p) for p, _, _ in packed], [c for _, c, _ in packed], [n for g, (_, _, inner) in zip(groups, packed) for n in (sum(len(d) for _, d in g), *inner)], subs)
    ordered = full + [(n, d) for n, d in members if not d]
    names = b"\0" + b"".join(n.encode("utf-16-le") + b"\0\0" for n, _ in ordered)
    header += b"\x05" + uint_7z(len(ordered))
    empty = [not d for _, d in ordered]
    if any(empty):
        as_bits = lambda v: int("".join("1" if x else "0" for x in v).ljust(-(-len(v) // 8) * 8, "0"), 2).to_bytes(-(-len(v) // 8), "big")
        for kind, b in ((14, as_bits(empty)), (15, as_bits([True] * sum(empty)))):
            header += bytes([kind]) + uint_7z(len(b)) + b
    header += b"\x11" + uint_7z(len(names)) + names + b"\x00\x00"
    if encode_header:
        p, coder, inner = pack(header)
        outer = b"\x17" + streams(len(body), [len(p)], [coder], [len(header), *inner], b"")
        body, header = body + p, outer
    fixed = struct.pack("<QQI", len(body), len(header), zlib.crc32(header))
    return b"7z\xbc\xaf\x27\x1c\0\4" + struct.pack("<I", zlib.crc32(fixed)) + fixed + body + header


def z_stream(data: bytes, most: int = 16) -> bytes:
    """Unix compress in block mode, without CLEAR."""
    table: dict[bytes, int] = {bytes((i,)): i for i in range(256)}
    out, group, bits, next_, word = b"\x1f\x9d" + bytes([0x80 | most]), [], 9, 257, b""

    def flush() -> bytes:
        v = 0
        for k, c in enumerate(group):
            v |= c << (k * bits)
        raw = v.to_bytes(bits if len(group) == 8 or widen else -(-len(group) * bits // 8), "little")
        group.clear()
        return raw

    parts, widen = [], False
    for k in range(len(data)):
        longer = word + data[k : k + 1]
        if longer in table:
            word = longer
            continue
        group.append(table[word])
        if len(group) == 8:
            parts.append(flush())
        if next_ >= 1 << bits and bits < most:
            widen = True
            if group:
                parts.append(flush())
            widen, bits = False, bits + 1
        if next_ < 1 << most:
            table[longer] = next_
            next_ += 1
        word = data[k : k + 1]
    if word:
        group.append(table[word])
    if group:
        parts.append(flush())
    return out + b"".join(parts)
