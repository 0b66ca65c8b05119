"""A bounded cursor over bytes: every read is checked, and running out is a FormatError."""

from __future__ import annotations

import struct

from .errors import FormatError


class Cursor:
    __slots__ = ("data", "at", "end", "what")

    def __init__(self, data: bytes | memoryview, at: int = 0, end: int | None = None, what: str = "header") -> None:
        self.data, self.at, self.end, self.what = data, at, len(data) if end is None else end, what

    @property
    def left(self) -> int:
        return self.end - self.at

    def take(self, n: int) -> bytes:
        if n < 0 or n > self.left:
            raise FormatError(f"{self.what} ends within a field")
        at, self.at = self.at, self.at + n
        return bytes(self.data[at : at + n])

    def skip(self, n: int) -> None:
        if n < 0 or n > self.left:
            raise FormatError(f"{self.what} ends within a field")
        self.at += n

    def unpack(self, layout: str) -> tuple:
        n = struct.calcsize(layout)
        if n > self.left:
            raise FormatError(f"{self.what} ends within a field")
        out = struct.unpack_from(layout, self.data, self.at)
        self.at += n
        return out

    def u8(self) -> int:
        return self.unpack("B")[0]

    def u32(self) -> int:
        return self.unpack("<I")[0]

    def u64(self) -> int:
        return self.unpack("<Q")[0]

    def sub(self, n: int, what: str) -> Cursor:
        """A cursor over the next n bytes, which this one skips."""
        at = self.at
        self.skip(n)
        return Cursor(self.data, at, at + n, what)

    def done(self) -> None:
        if self.left:
            raise FormatError(f"{self.what} has {self.left} bytes too many")
