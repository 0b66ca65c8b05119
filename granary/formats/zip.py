"""ZIP: the central directory is the truth, and every local header must agree with it."""

from __future__ import annotations

import struct
import zlib

from ..codecs import general, inflate64, zipcrypto
from ..cursor import Cursor
from ..errors import ArchiveError, ChecksumError, FormatError, PasswordRequiredError, UnsupportedMethodError, WrongPasswordOrCorruptError, checksum, unsupported
from .base import Reader, path_fields

#: Names of compression methods by number.
METHODS = {0: "stored", 8: "deflate", 9: "deflate64", 12: "bzip2", 14: "lzma", 20: "zstd", 93: "zstd", 94: "mp3", 95: "xz", 96: "jpeg", 97: "wavpack", 98: "ppmd"}
_FULL32, _FULL16 = 0xFFFFFFFF, 0xFFFF
_UTF8, _DESCRIPTOR, _ENCRYPTED, _PATCHED, _STRONG, _EOS = 1 << 11, 1 << 3, 1, 1 << 5, 1 << 6, 1 << 1


def dos_time(time: int, date: int) -> dict | None:
    """Calendar fields of a DOS time; None when a field is out of its range. A day is tested against 31 alone."""
    out = {"year": 1980 + (date >> 9), "month": date >> 5 & 15, "day": date & 31, "hour": time >> 11, "minute": time >> 5 & 63, "second": 2 * (time & 31)}
    ok = 1 <= out["month"] <= 12 and 1 <= out["day"] <= 31 and out["hour"] < 24 and out["minute"] < 60
    return out if ok else None


def extras(raw: bytes, what: str) -> list[tuple[int, bytes]]:
    c, out = Cursor(raw, what=what), []
    while c.left:
        kind, n = c.unpack("<HH")
        out.append((kind, c.take(n)))
    return out


def _one(fields: list[tuple[int, bytes]], kind: int) -> bytes | None:
    found = [b for k, b in fields if k == kind]
    if len(found) > 1:
        raise FormatError(f"zip: extra field {kind:#06x} stands twice")
    return found[0] if found else None


class ZipReader(Reader):
    format = "zip"

    def parse(self) -> None:
        at, base, count, size, offset = self._end()
        lim = self.ctx.limits
        lim.check("max_files", count)
        lim.check("max_header_bytes", size)
        start = base + offset
        if start + size > at:
            raise FormatError("zip: the central directory runs into its end record")
        c, names = Cursor(self.data, start, start + size, "zip: central directory"), 0
        ranges: list[tuple[int, int]] = []
        self._spans: list[dict] = []
        while c.left:
            self.ctx.budget.charge()
            if len(self.entries) >= count:
                raise FormatError("zip: more entries than the end record says")
            e, span = self._central(c, base)
            names = self.named(names, e["raw_name"])
            span["data"], end = self._local(e, span, start)
            ranges.append((span["local"], end))
            e["idx"] = len(self.entries)
            self.entries.append(e)
            self._spans.append(span)
        if len(self.entries) != count:
            raise FormatError("zip: fewer entries than the end record says")
        ranges.sort()
        if any(a[1] > b[0] for a, b in zip(ranges, ranges[1:])):
            raise FormatError("zip: entries overlap")

    def _end(self) -> tuple[int, int, int, int, int]:
        """Where the end records begin, bytes before the archive, entries, and size and offset of the directory."""
        data, n = self.data, len(self.data)
        at = n - 22
        while at >= max(0, n - 22 - _FULL16):
            at = data.rfind(b"PK\5\6", max(0, n - 22 - _FULL16), at + 4)
            if at < 0:
                break
            if at + 22 + struct.unpack_from("<H", data, at + 20)[0] == n:
                break
            at -= 1
        if at < 0 or data[at : at + 4] != b"PK\5\6" or at + 22 + struct.unpack_from("<H", data, at + 20)[0] != n:
            raise FormatError("zip: no end record at the end")
        disk, first, here, count, size, offset, comment = struct.unpack_from("<HHHHIIH", data, at + 4)
        self.archive = {"comment": bytes(data[at + 22 :])}
        end, wide = at, None
        if at >= 20 and data[at - 20 : at - 16] == b"PK\6\7":
            wide_disk, wide_at, disks = struct.unpack_from("<IQI", data, at - 16)
            if disks > 1 or wide_disk:
                raise unsupported("split-zip-archive")
            spot = wide_at if data[wide_at : wide_at + 4] == b"PK\6\6" else data.rfind(b"PK\6\6", 0, at - 20)
            if spot < 0 or spot + 56 > at - 20:
                raise FormatError("zip: no ZIP64 end record")
            length, _, _, d, f, here64, count64, size64, offset64 = struct.unpack_from("<QHHIIQQQQ", data, spot + 4)
            if spot + 12 + length != at - 20:
                raise FormatError("zip: ZIP64 end record has a wrong size")
            if d or f or here64 != count64:
                raise unsupported("split-zip-archive")
            for old, new, full in ((count, count64, _FULL16), (size, size64, _FULL32), (offset, offset64, _FULL32)):
                if old not in (full, new):
                    raise FormatError("zip: the end records disagree")
            count, size, offset, end, wide = count64, size64, offset64, spot, wide_at
        elif disk or first or here != count:
            raise unsupported("split-zip-archive")
        base = end - wide if wide is not None else end - size - offset
        if base < 0 or base + offset + size != end:
            raise FormatError("zip: the central directory isn't before its end record")
        return end, base, count, size, offset

    def _central(self, c: Cursor, base: int) -> tuple[dict, dict]:
        if c.take(4) != b"PK\1\2":
            raise FormatError("zip: no central header")
        made, need, flags, method, time, date, crc, packed, size, nn, ne, nc, disk, internal, external, offset = c.unpack("<HHHHHHIIIHHHHHII")
        name, extra, comment = c.take(nn), c.take(ne), c.take(nc)
        fields = extras(extra, "zip: central extra field")
        wide = _one(fields, 1)
        if wide is not None or _FULL32 in (packed, size, offset) or disk == _FULL16:
            w = Cursor(wide or b"", what="zip: ZIP64 extra field")
            size = w.u64() if size == _FULL32 else size
            packed = w.u64() if packed == _FULL32 else packed
            offset = w.u64() if offset == _FULL32 else offset
            disk = w.u32() if disk == _FULL16 else disk
            w.done()
        if disk:
            raise unsupported("split-zip-archive")
        aes, actual, version, bits = _one(fields, 0x9901), method, None, None
        if method == 99:
            if aes is None or len(aes) != 7 or aes[2:4] != b"AE":
                raise FormatError("zip: bad AES extra field")
            version, strength, actual = aes[0] | aes[1] << 8, aes[4], aes[5] | aes[6] << 8
            if version not in (1, 2) or strength not in (1, 2, 3) or actual == 99:
                raise FormatError("zip: bad AES extra field")
            bits = 64 + 64 * strength
            if version == 2 and crc:
                raise FormatError("zip: an AE-2 entry has a CRC")
        host, mode = made >> 8, external >> 16
        unix = mode if host in (3, 19) else None
        encryption = "none" if not flags & _ENCRYPTED else "winzip_aes" if method == 99 else "strong" if flags & _STRONG else "zipcrypto"
        text = self._name(name, flags, fields)
        entry = {
            "raw_name": name, "name": text, "raw_comment": comment, "extra_fields": extra, "compression_method": METHODS.get(actual, "unknown"), "compression_method_id": actual,
            "encryption": encryption, "aes_vendor_version": version, "aes_key_bits": bits, "compressed_size": packed, "size": size, "crc32": None if version == 2 else crc,
            "is_directory": name.endswith(b"/"), "is_symlink": unix is not None and unix & 0o170000 == 0o120000, "unix_mode": unix, "modified": dos_time(time, date),
            "modified_time_raw": time, "modified_date_raw": date, "version_made_by": made, "version_needed": need, "flags": flags, "internal_attributes": internal,
            "external_attributes": external, "local_header_offset": offset, **path_fields(text),
        }
        return entry, {"local": base + offset, "method": method, "crc": crc, "aes": aes}

    @staticmethod
    def _name(raw: bytes, flags: int, fields: list[tuple[int, bytes]]) -> str:
        """The Unicode Path field if it is about this name, else UTF-8 when flagged, else code page 437."""
        path = _one(fields, 0x7075)
        if path is not None and len(path) >= 5 and path[0] == 1 and int.from_bytes(path[1:5], "little") == zlib.crc32(raw):
            raw, flags = path[5:], _UTF8
        if flags & _UTF8:
            try:
                return raw.decode("utf-8")
            except UnicodeDecodeError as e:
                raise FormatError("zip: a name that should be UTF-8 isn't") from e
        return raw.decode("cp437")

    def _local(self, e: dict, span: dict, directory: int) -> tuple[int, int]:
        """Where the entry's data begins, and where all of the entry ends."""
        c = Cursor(self.data, min(span["local"], directory), directory, "zip: local header")
        if span["local"] > directory or c.take(4) != b"PK\3\4":
            raise FormatError("zip: no local header")
        need, flags, method, time, date, crc, packed, size, nn, ne = c.unpack("<HHHHHIIIHH")
        name, fields = c.take(nn), extras(c.take(ne), "zip: local extra field")
        mask = _ENCRYPTED | _DESCRIPTOR | _STRONG | _PATCHED | _UTF8
        if (flags ^ e["flags"]) & mask or method != span["method"] or name != e["raw_name"]:
            raise FormatError("zip: local and central headers disagree")
        if method == 99 and _one(fields, 0x9901) != span["aes"]:
            raise FormatError("zip: local and central AES fields disagree")
        wide = _one(fields, 1)
        is_wide = wide is not None
        if _FULL32 in (packed, size):
            w = Cursor(wide or b"", what="zip: local ZIP64 extra field")
            size = w.u64() if size == _FULL32 else size
            packed = w.u64() if packed == _FULL32 else packed
            w.done()
        at = c.at
        end = at + e["compressed_size"]
        if end > directory:
            raise FormatError("zip: entry data runs into the directory")
        if flags & _DESCRIPTOR:
            for mine, theirs in ((crc, span["crc"]), (packed, e["compressed_size"]), (size, e["size"])):
                if mine not in (0, theirs):
                    raise FormatError("zip: local and central sizes disagree")
            return at, self._descriptor(end, e, span["crc"], is_wide, directory)
        if (crc, packed, size) != (span["crc"], e["compressed_size"], e["size"]):
            raise FormatError("zip: local and central sizes disagree")
        return at, end

    def _descriptor(self, at: int, e: dict, crc: int, wide: bool, directory: int) -> int:
        """End of the data descriptor: with a signature or without, of 64 bits or 32."""
        for layout in (("<IQQ", "<III") if wide else ("<III", "<IQQ")):
            for signature in (b"PK\7\10", b""):
                end = at + len(signature) + struct.calcsize(layout)
                if end <= directory and self.data[at : at + len(signature)] == signature and struct.unpack_from(layout, self.data, at + len(signature)) == (crc, e["compressed_size"], e["size"]):
                    return end
        raise FormatError("zip: no data descriptor that fits")

    def read(self, i: int) -> bytes:
        """Limits, then features, method, decryption, decompression, size and CRC, in this order."""
        e, span, ctx = self.entries[i], self._spans[i], self.ctx
        ctx.member(e["size"])
        flags, method = e["flags"], e["compression_method_id"]
        if flags & _PATCHED:
            raise unsupported("zip-patched-data")
        if flags & _STRONG:
            raise unsupported("zip-strong-encryption")
        if method not in _DECODERS:
            raise UnsupportedMethodError(f"zip: method {method}", method_id=f"{method:04x}", member_index=i)
        raw = bytes(self.data[span["data"] : span["data"] + e["compressed_size"]])
        secret = e["encryption"] != "none"
        if secret:
            raw = self._decrypted(raw, e, span)
        try:
            out = _DECODERS[method](raw, e, ctx)
            if len(out) != e["size"]:
                raise FormatError("zip: size mismatch")
            if e["crc32"] is not None and zlib.crc32(out) != e["crc32"]:
                raise checksum("member", i)
        except (FormatError, ChecksumError) as x:
            if secret:
                raise WrongPasswordOrCorruptError("zip: wrong password or corrupt data") from x
            raise
        ctx.made(len(out))
        return out

    def _decrypted(self, raw: bytes, e: dict, span: dict) -> bytes:
        password = self.ctx.password
        if password is None:
            raise PasswordRequiredError("zip: a password is needed")
        password = password.encode() if isinstance(password, str) else password
        if e["encryption"] == "winzip_aes":
            return zipcrypto.winzip_aes(raw, password, e["aes_key_bits"])
        return zipcrypto.zipcrypto(raw, password, e["modified_time_raw"] >> 8 if e["flags"] & _DESCRIPTOR else span["crc"] >> 24)


def _lzma(raw: bytes, e: dict, ctx) -> bytes:
    """Two version bytes, the length of the properties, the properties, the stream; flag bit 1 says that it has an end mark."""
    if len(raw) < 9 or raw[2:4] != b"\5\0":
        raise FormatError("zip: bad LZMA header")
    return general.lzma1(raw[9:], raw[4:9], e["size"], ctx, end_mark=bool(e["flags"] & _EOS))


def _zstd(raw: bytes, e: dict, ctx) -> bytes:
    from .streams import check_zstd

    check_zstd(raw, ctx)
    return general.zstd_frame(raw, e["size"], ctx)


_DECODERS = {
    0: lambda raw, e, ctx: general.stored(raw, e["size"], ctx),
    8: lambda raw, e, ctx: general.deflate(raw, e["size"], ctx),
    9: lambda raw, e, ctx: inflate64.inflate64(raw, e["size"], ctx),
    12: lambda raw, e, ctx: general.bzip2(raw, e["size"], ctx),
    14: _lzma,
    20: _zstd,
    93: _zstd,
    95: lambda raw, e, ctx: general.xz(raw, e["size"], ctx),
}

__all__ = ["ZipReader", "dos_time", "ArchiveError"]
