"""Single compressed streams without members: LZ4 and Zstandard frames, Unix .Z.

The frames are walked first, which gives counts, sizes and features without decoding; each data frame is then decoded by
itself, so its check sums and sizes are its own.
"""

from __future__ import annotations

import struct

from ..codecs import general
from ..codecs.inflate64 import copy
from ..codecs.lzw import lzw
from ..cursor import Cursor
from ..errors import FormatError, checksum, unsupported
from ..limits import Context

_SKIP_LO, _SKIP_HI = 0x184D2A50, 0x184D2A5F
_LZ4, _LZ4_OLD, _ZSTD = 0x184D2204, 0x184C2102, 0xFD2FB528
_M32 = 0xFFFFFFFF


def xxh32(data: bytes, seed: int = 0) -> int:
    import xxhash

    return xxhash.xxh32_intdigest(data, seed)


def detect(data: bytes) -> str:
    """lz4, zstd or unix_compress, from the first magic number after skippable frames."""
    if data[:2] == b"\x1f\x9d":
        return "unix_compress"
    at = 0
    while at + 4 <= len(data):
        magic = struct.unpack_from("<I", data, at)[0]
        if _SKIP_LO <= magic <= _SKIP_HI:
            if at + 8 > len(data):
                break
            at += 8 + struct.unpack_from("<I", data, at + 4)[0]
            continue
        if magic in (_LZ4, _LZ4_OLD):
            return "lz4"
        if magic == _ZSTD:
            return "zstd"
        break
    raise FormatError("no known compressed stream")


class StreamReader:
    """One stream. `info` is a row of stream_info; `read()` gives the verified bytes, after which `frames` and
    `checksums` tell how many frames were decoded and how many check sums were tested."""

    def __init__(self, data: bytes, ctx: Context | None = None, format: str | None = None) -> None:
        self.data, self.ctx = bytes(data), ctx or Context()
        self.ctx.limits.check("max_total_input_bytes", len(data))
        self.format = format or detect(self.data)
        self.spans: list[dict] = []
        self.frames = self.checksums = 0
        zero = ("frame_count", "skippable_frame_count", "content_checksum_frame_count", "block_checksum_frame_count", "dictionary_frame_count", "legacy_frame_count")
        self.info = {"format": self.format, "compressed_size": len(self.data), "uncompressed_size": None, **dict.fromkeys(zero, 0), "maximum_block_bytes": None, "maximum_window_bytes": None, "maximum_code_bits": None, "block_mode": None, "decoder_dictionary_bytes": None}
        walk = {"lz4": self._walk_lz4, "zstd": self._walk_zstd, "unix_compress": self._walk_z}.get(self.format)
        if not walk:
            raise unsupported(f"stream-format-{self.format}")
        walk()

    def _frames(self, one) -> None:
        """Calls one(magic, cursor) for each data frame and passes over skippable ones."""
        c, sizes, known = Cursor(self.data, what=f"{self.format} frame"), 0, True
        while c.left:
            self.ctx.budget.charge()
            self.ctx.limits.check("max_stream_frames", self.info["frame_count"] + self.info["skippable_frame_count"] + 1)
            start, magic = c.at, c.u32()
            if _SKIP_LO <= magic <= _SKIP_HI:
                c.skip(c.u32())
                self.info["skippable_frame_count"] += 1
                continue
            span = one(magic, c)
            span |= {"start": start, "end": c.at}
            self.info["frame_count"] += 1
            self.spans.append(span)
            known = known and span.get("size") is not None
            sizes += span.get("size") or 0
        if not self.spans:
            raise FormatError(f"{self.format}: no data frame")
        self.info["uncompressed_size"] = sizes if known else None

    def _most(self, key: str, n: int) -> None:
        self.info[key] = max(self.info[key] or 0, n)

    # LZ4

    def _walk_lz4(self) -> None:
        self._frames(self._lz4_frame)

    def _lz4_frame(self, magic: int, c: Cursor) -> dict:
        if magic == _LZ4_OLD:
            return self._lz4_old(c)
        if magic != _LZ4:
            raise FormatError("lz4: unknown frame magic")
        start = c.at
        flags, block = c.u8(), c.u8()
        if flags >> 6 != 1:
            raise FormatError("lz4: unknown frame version")
        if flags & 2 or block & 0x8F or block >> 4 < 4:
            raise FormatError("lz4: reserved frame bits")
        size = c.u64() if flags & 8 else None
        if flags & 1:
            c.u32()
            self.info["dictionary_frame_count"] += 1
        header = bytes(self.data[start : c.at])
        if c.u8() != xxh32(header) >> 8 & 255:
            raise checksum("frame_header")
        most = 1 << (8 + 2 * (block >> 4))
        self.ctx.limits.check("max_dictionary_bytes", most)
        self._most("maximum_block_bytes", most)
        checks = 0
        while n := c.u32():
            self.ctx.budget.charge()
            if (n & 0x7FFFFFFF) > most:
                raise FormatError("lz4: a block is over its frame's maximum")
            c.skip(n & 0x7FFFFFFF)
            if flags & 16:
                c.skip(4)
                checks += 1
        if flags & 4:
            c.skip(4)
            checks += 1
        self.info["content_checksum_frame_count"] += bool(flags & 4)
        self.info["block_checksum_frame_count"] += bool(flags & 16)
        return {"size": size, "checks": checks, "dictionary": bool(flags & 1)}

    def _lz4_old(self, c: Cursor) -> dict:
        """Blocks of up to 8 MiB until the end, or until what follows is the magic of another frame."""
        self.info["legacy_frame_count"] += 1
        self._most("maximum_block_bytes", 8 << 20)
        blocks = []
        while c.left >= 4:
            n = struct.unpack_from("<I", self.data, c.at)[0]
            if n in (_LZ4, _LZ4_OLD) or _SKIP_LO <= n <= _SKIP_HI:
                break
            c.skip(4)
            if not n:
                raise FormatError("lz4: an empty legacy block")
            blocks.append((c.at, n))
            c.skip(n)
        return {"size": None, "checks": 0, "blocks": blocks}

    # Zstandard

    def _walk_zstd(self) -> None:
        self._frames(self._zstd_frame)

    def _zstd_frame(self, magic: int, c: Cursor) -> dict:
        if magic != _ZSTD:
            raise FormatError("zstd: unknown frame magic")
        d = c.u8()
        if d & 8:
            raise FormatError("zstd: reserved frame bit")
        single, window = bool(d & 32), None
        if not single:
            w = c.u8()
            window = (1 << (10 + (w >> 3))) * (8 + (w & 7)) // 8
        dictionary = int.from_bytes(c.take((0, 1, 2, 4)[d & 3]), "little")
        n = (1 if single else 0, 2, 4, 8)[d >> 6]
        size = int.from_bytes(c.take(n), "little") + (256 if n == 2 else 0) if n else None
        window = size if single else window
        self.ctx.limits.check("max_dictionary_bytes", window)
        self._most("maximum_window_bytes", window)
        most, last = min(window, 128 << 10), False
        self._most("maximum_block_bytes", most)
        while not last:
            self.ctx.budget.charge()
            h = int.from_bytes(c.take(3), "little")
            last, kind, n = bool(h & 1), h >> 1 & 3, h >> 3
            if kind == 3:
                raise FormatError("zstd: reserved block type")
            if n > max(most, 1):
                raise FormatError("zstd: a block is over its maximum")
            c.skip(1 if kind == 1 else n)
        if d & 4:
            c.skip(4)
            self.info["content_checksum_frame_count"] += 1
        self.info["dictionary_frame_count"] += bool(dictionary)
        return {"size": size, "checks": int(bool(d & 4)), "dictionary": bool(dictionary)}

    # .Z

    def _walk_z(self) -> None:
        if len(self.data) < 3 or self.data[:2] != b"\x1f\x9d":
            raise FormatError(".Z: no header")
        flags = self.data[2]
        if flags & 0x60:
            raise FormatError(".Z: reserved flags")
        bits = flags & 31
        if not 9 <= bits <= 16:
            raise FormatError(".Z: code width isn't 9 to 16")
        self.ctx.limits.check("max_dictionary_bytes", 4 << bits)
        self.info |= {"frame_count": 1, "maximum_code_bits": bits, "block_mode": bool(flags & 128), "decoder_dictionary_bytes": 4 << bits}

    def read(self) -> bytes:
        """All bytes of all frames; an error if any check fails."""
        self.frames = self.checksums = 0
        if self.format == "unix_compress":
            out = lzw(self.data[3:], self.info["maximum_code_bits"], self.info["block_mode"], self.ctx)
            self.ctx.made(len(out))
            self.frames = 1
            return out
        parts = []
        for s in self.spans:
            if s.get("dictionary"):
                raise unsupported("external-dictionary")
            raw = self.data[s["start"] : s["end"]]
            if "blocks" in s:
                part = b"".join(lz4_block(self.data[a : a + n], 8 << 20) for a, n in s["blocks"])
            else:
                part = (general.lz4_frame if self.format == "lz4" else general.zstd_frame)(raw, s["size"], self.ctx)
            self.ctx.made(len(part))
            parts.append(part)
            self.frames += 1
            self.checksums += s["checks"]
        return b"".join(parts)


def check_zstd(data: bytes, ctx: Context) -> None:
    """The frames of Zstandard data within a container: whole, within the window limit, without a dictionary."""
    r = StreamReader(data, Context(ctx.limits, ctx.budget), "zstd")
    if r.info["dictionary_frame_count"]:
        raise unsupported("external-dictionary")


def lz4_block(data: bytes, most: int) -> bytes:
    """A raw LZ4 block of at most so many bytes."""
    out, at, end = bytearray(), 0, len(data)
    while True:
        if at >= end:
            raise FormatError("lz4: block is cut")
        token = data[at]
        at += 1
        n = token >> 4
        if n == 15:
            while True:
                if at >= end:
                    raise FormatError("lz4: block is cut")
                n += data[at]
                at += 1
                if data[at - 1] != 255:
                    break
        if at + n > end:
            raise FormatError("lz4: block is cut")
        out += data[at : at + n]
        at += n
        if len(out) > most:
            raise FormatError("lz4: block is over its maximum")
        if at == end:
            return bytes(out)
        if at + 2 > end:
            raise FormatError("lz4: block is cut")
        distance = data[at] | data[at + 1] << 8
        at += 2
        n = token & 15
        if n == 15:
            while True:
                if at >= end:
                    raise FormatError("lz4: block is cut")
                n += data[at]
                at += 1
                if data[at - 1] != 255:
                    break
        if not 0 < distance <= len(out):
            raise FormatError("lz4: distance before the start")
        copy(out, distance, n + 4)
        if len(out) > most:
            raise FormatError("lz4: block is over its maximum")
