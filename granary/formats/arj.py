"""ARJ: a main header, local headers with data, extended headers; a program may stand before it."""

from __future__ import annotations

import zlib

from ..codecs import general, lzh
from ..cursor import Cursor
from ..errors import ArchiveError, CancelledError, FormatError, LimitExceededError, UnsupportedMethodError, checksum, unsupported
from .base import Reader, lossy, path_fields

_MAGIC, _MOST = b"\x60\xea", 2600
_KINDS = {0: "binary", 1: "text", 2: "comment", 3: "directory", 4: "volume_label", 5: "chapter_label"}
METHODS = {0: "stored", 1: "compressed_1", 2: "compressed_2", 3: "compressed_3", 4: "fastest", 8: "no_data_no_crc", 9: "no_data"}
_GARBLED, _VOLUME, _EXTFILE, _SECURED = 1, 4, 8, 0x40


def _strings(c: Cursor) -> tuple[bytes, bytes]:
    raw = c.take(c.left)
    parts = raw.split(b"\0")
    if len(parts) != 3 or parts[2]:
        raise FormatError("arj: a header doesn't end with two strings")
    return parts[0], parts[1]


class ArjReader(Reader):
    format = "arj"

    def parse(self) -> None:
        stop = min(len(self.data), self.ctx.limits.sfx_scan_limit + 2)
        at, first = self.data.find(_MAGIC, 0, stop), None
        while at >= 0:
            try:
                self._open(at)
                return
            except (CancelledError, LimitExceededError):
                raise
            except ArchiveError as e:
                first = first or e
                if self.entries or getattr(self, "_main", False):
                    raise
            at = self.data.find(_MAGIC, at + 1, stop)
        raise first or FormatError("arj: no header")

    def _record(self, c: Cursor, what: str) -> Cursor | None:
        """A header record's content; None at the end mark. Extended headers are tested and passed over."""
        if c.take(2) != _MAGIC:
            raise FormatError(f"arj: no {what}")
        n = c.unpack("<H")[0]
        if not n:
            return None
        if n > _MOST or n < 30:
            raise FormatError("arj: bad header size")
        raw = c.take(n)
        if c.u32() != zlib.crc32(raw):
            raise checksum("member" if what == "local header" else "package_header")
        while n := c.unpack("<H")[0]:
            self.ctx.budget.charge()
            extra = c.take(n)
            if c.u32() != zlib.crc32(extra):
                raise checksum("member")
        return Cursor(raw, what=f"arj: {what}")

    def _open(self, base: int) -> None:
        self._main, self.entries, self._spans, names = False, [], [], 0
        c = Cursor(self.data, base, what="arj")
        h = self._record(c, "main header")
        if h is None:
            raise FormatError("arj: an empty main header")
        size, version, least, host, flags, security, kind, _, created, modified, length, envelope, spec, _, _, _ = h.unpack("<8B4I2H2B")
        if kind != 2 or size < 30:
            raise FormatError("arj: bad main header")
        h.skip(size - 30)
        name, comment = _strings(h)
        self._main = True
        if flags & (_VOLUME | _EXTFILE):
            raise unsupported("arj-multi-volume")
        if flags & _SECURED or envelope:
            raise unsupported("arj-security-envelope")
        self.archive = {"raw_name": name, "raw_comment": comment, "sfx_offset": base, "archiver_version": version, "minimum_version": least, "host_os": host, "flags": flags, "created_time_raw": created, "modified_time_raw": modified}
        while True:
            h = self._record(c, "local header")
            if h is None:
                return
            self.ctx.limits.check("max_files", len(self.entries) + 1)
            size, version, least, host, flags, method, kind, _, modified, packed, full, crc, spec, mode, _ = h.unpack("<8B4I3H")
            if size < 30:
                raise FormatError("arj: bad local header")
            h.skip(size - 30)
            name, comment = _strings(h)
            names = self.named(names, name)
            if flags & (_VOLUME | _EXTFILE):
                raise unsupported("arj-multi-volume")
            if spec > len(name):
                raise FormatError("arj: the file name's place lies outside of it")
            text = lossy(name)
            self._spans.append(c.at)
            c.skip(packed)
            self.entries.append({
                "idx": len(self.entries), "raw_name": name, "name": text, "raw_comment": comment, "archiver_version": version, "minimum_version": least, "host_os": host, "flags": flags,
                "compression_method": METHODS.get(method, "unknown"), "compression_method_id": method, "kind": _KINDS.get(kind, "unknown"), "modified_time_raw": modified, "compressed_size": packed,
                "size": full, "crc32": None if method == 8 else crc, "file_spec_position": spec, "access_mode": mode, "is_encrypted": bool(flags & _GARBLED), **path_fields(text),
            })

    def read(self, i: int) -> bytes:
        e, at = self.entries[i], self._spans[i]
        self.ctx.member(e["size"])
        if e["is_encrypted"]:
            raise unsupported("arj-encryption")
        raw, method = bytes(self.data[at : at + e["compressed_size"]]), e["compression_method_id"]
        if method == 0:
            out = general.stored(raw, e["size"], self.ctx)
        elif method in (1, 2, 3):
            out = lzh.huffman(raw, e["size"], self.ctx)
        elif method == 4:
            out = lzh.fastest(raw, e["size"], self.ctx)
        elif method in (8, 9):
            if e["size"] or e["compressed_size"]:
                raise FormatError("arj: a member without data has a size")
            out = b""
        else:
            raise UnsupportedMethodError(f"arj: method {method}", method_id=f"{method:02x}", member_index=i)
        if e["crc32"] is not None and zlib.crc32(out) != e["crc32"]:
            raise checksum("member", i)
        self.ctx.made(len(out))
        return out
