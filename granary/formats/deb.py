"""Debian packages: a System V `ar` of a version, a control tar and a data tar."""

from __future__ import annotations

from ..codecs import general
from ..errors import FormatError, UnsupportedMethodError, unsupported
from ..limits import Context
from . import tar
from .base import Reader, lossy

_SUFFIXES = {b"": "none", b".gz": "gzip", b".xz": "xz", b".zst": "zstd", b".bz2": "bzip2", b".lzma": "lzma"}


def unwrap(data: bytes, kind: str, ctx: Context) -> bytes:
    """A package payload, decompressed by its compression's name."""
    from .streams import check_zstd

    if kind == "none":
        return general.stored(data, None, ctx)
    if kind == "gzip":
        return general.gzip(data, ctx)
    if kind == "bzip2":
        return general.bzip2(data, None, ctx)
    if kind == "xz":
        return general.xz(data, None, ctx)
    if kind == "lzma":
        return general.lzma_alone(data, ctx)
    if kind == "zstd":
        check_zstd(data, ctx)
        return general.zstd_frame(data, None, ctx)
    raise UnsupportedMethodError(f"payload compression {kind!r}", method_id=kind)


def _number(raw: bytes, base: int) -> int:
    text = raw.rstrip(b" ")
    if not text:
        return 0
    if any(x not in (b"01234567" if base == 8 else b"0123456789") for x in text):
        raise FormatError("ar: a field isn't a number")
    return int(text, base)


def ar_members(data: bytes, ctx: Context) -> list[dict]:
    if data[:8] != b"!<arch>\n":
        raise FormatError("ar: no signature")
    at, out = 8, []
    while at < len(data):
        ctx.budget.charge()
        ctx.limits.check("max_files", len(out) + 1)
        head = data[at : at + 60]
        if len(head) < 60 or head[58:] != b"`\n":
            raise FormatError("ar: bad member header")
        name = head[:16].rstrip(b" ")
        if name.startswith(b"#1/") or name.startswith(b"//") or name.startswith(b"/"):
            raise unsupported("ar-name-table")
        name = name[:-1] if name.endswith(b"/") else name
        if not name:
            raise FormatError("ar: a member without a name")
        size = _number(head[48:58], 10)
        start, end = at + 60, at + 60 + size
        if end > len(data):
            raise FormatError("ar: a member is cut")
        at = end
        if size % 2:
            if data[at : at + 1] != b"\n":
                raise FormatError("ar: padding isn't a newline")
            at += 1
        out.append({"idx": len(out), "raw_name": name, "name": lossy(name), "modified_time": _number(head[16:28], 10), "uid": _number(head[28:34], 10), "gid": _number(head[34:40], 10), "mode": _number(head[40:48], 8), "size": size, "at": start})
    return out


class DebReader(Reader):
    format = "deb"

    def parse(self) -> None:
        self.outer = ar_members(self.data, self.ctx)
        control = data = None
        for i, m in enumerate(self.outer):
            name, kind, packed = m["raw_name"], "other", None
            for part in (b"control", b"data"):
                if name.startswith(part + b".tar") and name[len(part) + 4 :] in _SUFFIXES:
                    kind, packed = part.decode(), _SUFFIXES[name[len(part) + 4 :]]
            if i == 0:
                if name != b"debian-binary" or self._raw(m) != b"2.0\n":
                    raise FormatError("deb: the first member isn't debian-binary of version 2.0")
                kind = "version"
            elif control is None:
                if kind == "control":
                    control = m
                elif not name.startswith(b"_"):
                    raise FormatError("deb: no control member after the version")
            elif data is None:
                if kind != "data":
                    raise FormatError("deb: no data member after control")
                data = m
            else:
                raise FormatError("deb: a member after data")
            m |= {"kind": kind, "compression": packed}
        if data is None:
            raise FormatError("deb: no data member")
        self._tars, self._spots = {}, []
        for section, m in (("control", control), ("data", data)):
            image = unwrap(self._raw(m), m["compression"], self.ctx)
            self._tars[section] = image
            for row, start in tar.entries(image, self.ctx, section, len(self.entries)):
                self.entries.append(row)
                self._spots.append(start)
        self.archive = {f"retained_{k}_bytes": len(v) for k, v in self._tars.items()}

    def _raw(self, m: dict) -> bytes:
        return bytes(self.data[m["at"] : m["at"] + m["size"]])

    def read(self, i: int) -> bytes:
        e, at = self.entries[i], self._spots[i]
        size = e["size"] if e["kind"] == "file" else 0
        self.ctx.made(size)
        return bytes(self._tars[e["section"]][at : at + size])

    def read_outer(self, i: int) -> bytes:
        """A member of the package itself, as it is stored."""
        self.ctx.made(self.outer[i]["size"])
        return self._raw(self.outer[i])
