"""Decoders over the standard library and pyarrow, with exact ends: a stream that is cut, or followed by
other bytes, is an error, and output stops at its declared size or at the limits."""

from __future__ import annotations

import bz2
import lzma
import zlib

import pyarrow as pa

from ..errors import FormatError
from ..limits import Context


def _sized(out: bytes, size: int | None, what: str) -> bytes:
    if size is not None and len(out) != size:
        raise FormatError(f"{what} gives {len(out)} bytes, not {size}")
    return out


def _room(size: int | None, ctx: Context) -> int:
    if size is not None:
        ctx.member(size)
        return size
    return max(0, ctx.room)


def _all(step, room: int, ctx: Context) -> bytes:
    """Output of step(n) -> at most n bytes, till it gives none; a byte over `room` breaks the limits."""
    parts, total = [], 0
    while part := step(min(room + 1 - total, 1 << 20)):
        parts.append(part)
        total += len(part)
        ctx.budget.charge_bytes(len(part))
        if total > room:
            break
    return b"".join(parts)


def stored(data: bytes, size: int | None, ctx: Context) -> bytes:
    _room(len(data), ctx)
    return _sized(bytes(data), size, "stored data")


def deflate(data: bytes, size: int | None, ctx: Context) -> bytes:
    d, room = zlib.decompressobj(-15), _room(size, ctx)
    rest = [bytes(data)]

    def step(n: int) -> bytes:
        if d.eof:
            return b""
        out = d.decompress(rest[0], n)
        rest[0] = d.unconsumed_tail
        return out

    try:
        out = _all(step, room, ctx)
    except zlib.error as e:
        raise FormatError(f"deflate: {e}") from e
    if len(out) > room:
        if size is None:
            ctx.member(len(out))
        raise FormatError("deflate data is longer than declared")
    if not d.eof:
        raise FormatError("deflate data is cut")
    if d.unused_data or rest[0]:
        raise FormatError("bytes after the deflate data")
    return _sized(out, size, "deflate data")


def _incremental(d, data: bytes, size: int | None, ctx: Context, what: str, ended: bool, errors: tuple) -> bytes:
    """Output of a bz2 or lzma decompressor over all of data. ended: the stream must have its end mark."""
    room, fed = _room(size, ctx), [bytes(data)]

    def step(n: int) -> bytes:
        if d.eof:
            return b""
        if not ended and size is not None:
            n = min(n, max(0, size - step.got)) or 0
            if not n:
                return b""
        out = d.decompress(fed[0], n)
        fed[0] = b""
        step.got += len(out)
        return out

    step.got = 0
    try:
        out = _all(step, room, ctx)
        if not d.eof and ended and len(out) <= room:
            d.decompress(b"", 0)
    except EOFError:
        pass
    except errors as e:
        raise FormatError(f"{what}: {e}") from e
    if len(out) > room:
        if size is None:
            ctx.member(len(out))
        raise FormatError(f"{what} data is longer than declared")
    if ended and not d.eof:
        raise FormatError(f"{what} data is cut")
    if d.eof and d.unused_data:
        raise FormatError(f"bytes after the {what} data")
    return _sized(out, size, what)


def bzip2(data: bytes, size: int | None, ctx: Context) -> bytes:
    if data[:3] != b"BZh" or not b"1" <= data[3:4] <= b"9":
        raise FormatError("no bzip2 header")
    ctx.limits.check("max_dictionary_bytes", 5 * 100_000 * (data[3] - 48))
    return _incremental(bz2.BZ2Decompressor(), data, size, ctx, "bzip2", True, (OSError, ValueError))


def lzma_filter(props: bytes, ctx: Context) -> dict:
    """The filter of 5 LZMA property bytes."""
    if len(props) != 5 or props[0] >= 225:
        raise FormatError("bad LZMA properties")
    lc, rest = props[0] % 9, props[0] // 9
    lp, pb = rest % 5, rest // 5
    if lc + lp > 4:
        raise FormatError("LZMA lc + lp is over 4")
    size = int.from_bytes(props[1:5], "little")
    ctx.limits.check("max_dictionary_bytes", size)
    return {"id": lzma.FILTER_LZMA1, "dict_size": max(size, 4096), "lc": lc, "lp": lp, "pb": pb}


def lzma1(data: bytes, props: bytes, size: int | None, ctx: Context, end_mark: bool = False) -> bytes:
    """LZMA without a header. With no size, or with end_mark, the stream must end with its mark."""
    d = lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=[lzma_filter(props, ctx)])
    return _incremental(d, data, size, ctx, "LZMA", end_mark or size is None, (lzma.LZMAError,))


def lzma2_dictionary(prop: int) -> int:
    if prop > 40:
        raise FormatError("bad LZMA2 property")
    return 0xFFFFFFFF if prop == 40 else (2 | prop & 1) << (prop // 2 + 11)


def lzma2_length(data: bytes) -> int:
    """Bytes of an LZMA2 stream up to and with its end mark; the first chunk must reset the dictionary."""
    at, first = 0, True
    while True:
        if at >= len(data):
            raise FormatError("LZMA2 data is cut")
        control = data[at]
        if control == 0:
            return at + 1
        if first and control != 1 and control < 0xE0:
            raise FormatError("LZMA2 doesn't begin with a dictionary reset")
        first = False
        if control >= 0x80:
            at += 6 + (control >= 0xC0) + int.from_bytes(data[at + 3 : at + 5], "big")
            at += 0
        elif control in (1, 2):
            at += 4 + int.from_bytes(data[at + 1 : at + 3], "big")
        else:
            raise FormatError("bad LZMA2 chunk")


def lzma2(data: bytes, prop: int, size: int | None, ctx: Context) -> bytes:
    dictionary = lzma2_dictionary(prop)
    ctx.limits.check("max_dictionary_bytes", dictionary)
    if lzma2_length(data) != len(data):
        raise FormatError("bytes after the LZMA2 data")
    d = lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA2, "dict_size": max(4096, dictionary)}])
    return _incremental(d, data, size, ctx, "LZMA2", True, (lzma.LZMAError,))


def lzma_alone(data: bytes, ctx: Context) -> bytes:
    """The .lzma format: properties, a size or -1, and the stream."""
    if len(data) < 13:
        raise FormatError("no LZMA header")
    lzma_filter(bytes(data[:5]), ctx)
    d = lzma.LZMADecompressor(lzma.FORMAT_ALONE)
    return _incremental(d, data, None, ctx, "LZMA", True, (lzma.LZMAError,))


def xz(data: bytes, size: int | None, ctx: Context) -> bytes:
    """One .xz stream, and padding of whole 4-byte groups of zeros."""
    data = bytes(data)
    if data[:6] != b"\xfd7zXZ\0":
        raise FormatError("no XZ header")
    end = len(data)
    while end >= 4 and data[end - 4 : end] == b"\0\0\0\0":
        end -= 4
    if end % 4:
        raise FormatError("XZ stream isn't a multiple of four bytes")
    d = lzma.LZMADecompressor(lzma.FORMAT_XZ, memlimit=ctx.limits.max_dictionary_bytes + (8 << 20))
    try:
        return _incremental(d, data[:end], size, ctx, "XZ", True, (lzma.LZMAError,))
    except FormatError as e:
        if "limit" in e.detail.lower():
            ctx.limits.check("max_dictionary_bytes", ctx.limits.max_dictionary_bytes + 1)
        raise


def _arrow(data: bytes, kind: str, size: int | None, ctx: Context) -> bytes:
    room = _room(size, ctx)
    try:
        stream = pa.CompressedInputStream(pa.BufferReader(data), kind)
        out = _all(stream.read, room, ctx)
    except OSError as e:
        raise FormatError(f"{kind}: {str(e)[:200]}") from e
    if len(out) > room:
        if size is None:
            ctx.member(len(out))
        raise FormatError(f"{kind} data is longer than declared")
    return _sized(out, size, kind)


def brotli(data: bytes, size: int | None, ctx: Context) -> bytes:
    """A whole Brotli stream; a 16-byte frame header that some writers put before it is skipped when it names itself."""
    if data[:4] == b"\x50\x2a\x4d\x18" and data[4:8] == b"\x08\0\0\0" and data[12:14] == b"BR":
        data = data[16:]
    return _arrow(bytes(data), "brotli", size, ctx)


def lz4_frame(data: bytes, size: int | None, ctx: Context) -> bytes:
    return _arrow(bytes(data), "lz4", size, ctx)


def zstd_frame(data: bytes, size: int | None, ctx: Context) -> bytes:
    return _arrow(bytes(data), "zstd", size, ctx)


def gzip(data: bytes, ctx: Context) -> bytes:
    """One gzip member, with its header check sum, CRC-32 and size."""
    if len(data) < 18 or data[:3] != b"\x1f\x8b\x08":
        raise FormatError("no gzip header")
    flags, at = data[3], 10
    if flags & 0xE0:
        raise FormatError("reserved gzip flags")
    if flags & 4:
        at += 2 + int.from_bytes(data[at : at + 2], "little")
    for bit in (8, 16):
        if flags & bit:
            end = data.find(b"\0", at)
            if end < 0:
                raise FormatError("gzip header is cut")
            at = end + 1
    if flags & 2:
        if int.from_bytes(data[at : at + 2], "little") != zlib.crc32(data[:at]) & 0xFFFF:
            raise FormatError("gzip header check sum mismatch")
        at += 2
    if at + 8 > len(data):
        raise FormatError("gzip data is cut")
    out = deflate(data[at:-8], None, ctx)
    if zlib.crc32(out) != int.from_bytes(data[-8:-4], "little") or len(out) & 0xFFFFFFFF != int.from_bytes(data[-4:], "little"):
        raise FormatError("gzip check sum or size mismatch")
    return out
