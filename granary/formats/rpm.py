"""RPM packages: lead, signature and main headers with their digests, and a CPIO payload."""

from __future__ import annotations

import hashlib
import struct

from ..cursor import Cursor
from ..errors import FormatError, checksum, unsupported
from .base import Reader, lossy
from .cpio import CpioReader
from .deb import unwrap

_TYPES = {0: "null", 1: "char", 2: "int8", 3: "int16", 4: "int32", 5: "int64", 6: "string", 7: "binary", 8: "string_array", 9: "i18n_string"}
_WIDTH = {2: 1, 3: 2, 4: 4, 5: 8}
_COMPRESSORS = {"gzip": "gzip", "gz": "gzip", "bzip2": "bzip2", "bz2": "bzip2", "xz": "xz", "lzma": "lzma", "zstd": "zstd", "zst": "zstd", "none": "none", "uncompressed": "none", "identity": "none"}


def header(c: Cursor, limits, budget) -> list[dict]:
    """tag, value_type, ints, bytes of each index entry, in order; duplicates stay."""
    start = c.at
    magic, _, count, size = c.unpack(">4s4sII")
    if magic != b"\x8e\xad\xe8\x01":
        raise FormatError("rpm: no header magic")
    limits.check("max_header_properties", count)
    limits.check("max_header_bytes", 16 * count + size)
    index = c.sub(16 * count, "rpm: header index")
    store = c.take(size)
    out = []
    for _ in range(count):
        budget.charge()
        tag, kind, offset, n = index.unpack(">IIII")
        if kind not in _TYPES:
            raise FormatError("rpm: unknown value type")
        if offset > 0x7FFFFFFF:
            raise FormatError("rpm: negative value offset")
        out.append({"tag": tag, "value_type": _TYPES[kind], **_value(store, kind, offset, n)})
    out.append({"tag": None, "raw": bytes(c.data[start : c.at])})
    return out


def _value(store: bytes, kind: int, at: int, n: int) -> dict:
    if at > len(store) or (kind and n == 0):
        raise FormatError("rpm: a value lies outside of the store")
    if kind == 0:
        return {"ints": [], "bytes": []}
    if kind in _WIDTH:
        w = _WIDTH[kind]
        if at % w:
            raise FormatError("rpm: a value isn't aligned")
        if at + n * w > len(store):
            raise FormatError("rpm: a value lies outside of the store")
        return {"ints": list(struct.unpack_from(f">{n}{' BH I   Q'[w]}", store, at)), "bytes": []}
    if kind in (1, 7):
        if at + n > len(store):
            raise FormatError("rpm: a value lies outside of the store")
        return {"ints": list(store[at : at + n]) if kind == 1 else [], "bytes": [store[at : at + n]] if kind == 7 else []}
    if kind == 6 and n != 1:
        raise FormatError("rpm: a string has a count other than 1")
    out = []
    for _ in range(n):
        end = store.find(b"\0", at)
        if end < 0:
            raise FormatError("rpm: a string isn't ended")
        out.append(store[at:end])
        at = end + 1
    return {"ints": [], "bytes": out}


def last(tags: list[dict], tag: int) -> dict | None:
    return next((t for t in reversed(tags) if t["tag"] == tag), None)


class RpmReader(Reader):
    format = "rpm"

    def parse(self) -> None:
        c = Cursor(self.data, what="rpm")
        magic, major, minor, kind, arch, name, os, signature, _ = c.unpack(">4sBBHH66sHH16s")
        if magic != b"\xed\xab\xee\xdb":
            raise FormatError("rpm: no lead")
        if major not in (3, 4) or signature != 5:
            raise unsupported("rpm-lead-version")
        lead = name.partition(b"\0")[0]
        lim, budget = self.ctx.limits, self.ctx.budget
        self.signature = header(c, lim, budget)
        self.signature.pop()
        if any(c.take(min(-c.at % 8, c.left))):
            raise FormatError("rpm: padding isn't zero")
        self.main = header(c, lim, budget)
        raw = self.main.pop()["raw"]
        for tag, digest in ((269, hashlib.sha1), (273, hashlib.sha256)):
            if (d := last(self.signature, tag)) and d["bytes"] and d["bytes"][0].decode("latin-1").lower() != digest(raw).hexdigest():
                raise checksum("package_header")
        algorithm = last(self.main, 5093)
        if algorithm and algorithm["ints"] != [8]:
            raise unsupported("rpm-payload-digest-algorithm")
        form = last(self.main, 1124)
        if form and form["bytes"] != [b"cpio"]:
            raise unsupported("rpm-payload-format")
        named = last(self.main, 1125)
        name = lossy(named["bytes"][0]).lower() if named and named["bytes"] else "gzip"
        if name not in _COMPRESSORS:
            raise unsupported("rpm-payload-compressor")
        payload = bytes(self.data[c.at :])
        self._digest(5092, payload)
        image = unwrap(payload, _COMPRESSORS[name], self.ctx)
        self._digest(5097, image)
        self._cpio = CpioReader(image, self.ctx)
        self.entries = [{k: v for k, v in e.items() if k != "format"} for e in self._cpio.entries]
        self.archive = {"lead_major": major, "lead_minor": minor, "lead_type": kind, "lead_architecture": arch, "lead_name": lossy(lead), "lead_os": os, "lead_signature_type": signature, "payload_compression": _COMPRESSORS[name], "retained_payload_bytes": len(image)}

    def _digest(self, tag: int, data: bytes) -> None:
        d = last(self.main, tag)
        if d and d["bytes"] and d["bytes"][0].decode("latin-1").lower() != hashlib.sha256(data).hexdigest():
            raise checksum("package_payload")

    def tags(self) -> list[dict]:
        """section, position, tag, value_type, ints, bytes of both headers."""
        return [{"section": s, "position": i, **t} for s, tags in (("signature", self.signature), ("main", self.main)) for i, t in enumerate(tags)]

    def read(self, i: int) -> bytes:
        return self._cpio.read(i)
