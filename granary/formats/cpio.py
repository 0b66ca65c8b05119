"""CPIO: new ASCII with and without check sums, old ASCII, and old binary in either byte order."""

from __future__ import annotations

from collections.abc import Iterator

from ..cursor import Cursor
from ..errors import FormatError, checksum, unsupported
from .base import Reader, lossy, path_fields, posix_kind

_TRAILER = b"TRAILER!!!"
_NEW = ("inode", "mode", "uid", "gid", "link_count", "modified_time", "size", "device_major", "device_minor", "rdev_major", "rdev_minor", "name_size", "checksum")


def _digits(raw: bytes, base: int) -> int:
    digits = b"0123456789abcdefABCDEF" if base == 16 else b"01234567"
    if not raw or any(x not in digits for x in raw):
        raise FormatError("cpio: a number has other characters than digits")
    return int(raw, base)


def _header(c: Cursor) -> tuple[str, dict, int]:
    """Layout, fields, and the alignment of names and data."""
    magic = c.take(2)
    if magic in (b"\xc7\x71", b"\x71\xc7"):
        order = "<" if magic == b"\xc7\x71" else ">"
        v = c.unpack(order + "12H")
        wide = lambda i: v[i] << 16 | v[i + 1]
        f = {"inode": v[1], "mode": v[2], "uid": v[3], "gid": v[4], "link_count": v[5], "modified_time": wide(7), "size": wide(10), "device_major": v[0] >> 8, "device_minor": v[0] & 255, "rdev_major": v[6] >> 8, "rdev_minor": v[6] & 255, "name_size": v[9], "checksum": None}
        return "binary_le" if order == "<" else "binary_be", f, 2
    magic += c.take(4)
    if magic in (b"070701", b"070702"):
        f = {k: _digits(c.take(8), 16) for k in _NEW}
        if magic == b"070701":
            f["checksum"] = None
        return ("newc" if magic == b"070701" else "crc"), f, 4
    if magic == b"070707":
        widths = {"device": 6, "inode": 6, "mode": 6, "uid": 6, "gid": 6, "link_count": 6, "rdev": 6, "modified_time": 11, "name_size": 6, "size": 11}
        f = {k: _digits(c.take(n), 8) for k, n in widths.items()}
        for k in ("device", "rdev"):
            v = f.pop(k)
            f |= {f"{k}_major": v >> 8, f"{k}_minor": v & 255}
        return "odc", f | {"checksum": None}, 1
    if magic == b"07070X":
        raise unsupported("cpio-large-file-layout")
    raise FormatError("cpio: no header")


class CpioReader(Reader):
    format = "cpio"

    def parse(self) -> None:
        c, names, formats, total = Cursor(self.data, what="cpio"), 0, set(), 0
        self._spans: list[tuple[int, int]] = []
        while True:
            self.ctx.budget.charge()
            start = c.at
            layout, f, align = _header(c)
            formats.add(layout)
            n = f.pop("name_size")
            if not n:
                raise FormatError("cpio: an entry without a name")
            self.ctx.limits.check("max_name_bytes_per_entry", n)
            name = c.take(n)
            if name[-1:] != b"\0" or b"\0" in name[:-1]:
                raise FormatError("cpio: a name isn't ended by its only zero byte")
            name = name[:-1]
            self._pad(c, start, align)
            if name == _TRAILER:
                if f["size"]:
                    raise FormatError("cpio: the trailer has data")
                break
            names = self.named(names, name)
            self.ctx.limits.check("max_files", len(self.entries) + 1)
            self.ctx.limits.check("max_entry_output_bytes", f["size"])
            total += f["size"]
            self.ctx.limits.check("max_total_output_bytes", total)
            at = c.at
            c.skip(f["size"])
            self._pad(c, at if align == 2 else start, align)
            if f["checksum"] is not None:
                self._sum(at, f["size"], f["checksum"], f["mode"], len(self.entries))
            kind = posix_kind(f["mode"])
            text = lossy(name)
            self._spans.append((at, f["size"]))
            self.entries.append({"idx": len(self.entries), "format": layout, "raw_name": name, "name": text, "kind": kind, "permissions": f["mode"] & 0o7777, **f, "is_directory": kind == "directory", "is_symlink": kind == "symlink", **path_fields(text)})
        if any(self.data[c.at :]):
            raise FormatError("cpio: bytes after the trailer")
        self.archive = {"format": formats.pop() if len(formats) == 1 else "mixed"}

    def _sum(self, at: int, size: int, declared: int, mode: int, index: int) -> None:
        if mode & 0o170000 == 0o100000 and sum(self.data[at : at + size]) & 0xFFFFFFFF != declared:
            raise checksum("member", index)

    @staticmethod
    def _pad(c: Cursor, start: int, align: int) -> None:
        n = -(c.at - start) % align
        if align == 4:
            n = -c.at % 4
        if any(c.take(min(n, c.left))):
            raise FormatError("cpio: padding isn't zero")

    def read(self, i: int) -> bytes:
        at, size = self._spans[i]
        e = self.entries[i]
        self.ctx.made(size)
        if e["checksum"] is not None:
            self._sum(at, size, e["checksum"], e["mode"], i)
        return bytes(self.data[at : at + size])

    def symlink_target(self, i: int) -> bytes:
        if not self.entries[i]["is_symlink"]:
            raise FormatError("cpio: not a symbolic link")
        return self.read(i)

    def members(self) -> Iterator[tuple[int, bytes]]:
        return super().members()
