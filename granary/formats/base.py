"""What every container reader offers, and the registry of formats.

A reader is built from whole bytes and a Context; building it parses and validates. `entries` are rows of the format's
schema without path; `read(i)` gives a member's verified bytes; `members()` gives (index, bytes) of all in natural
order, decoding shared data once; `verify()` tests everything that is declared.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from ..errors import checksum
from ..limits import Context
from ..paths import unsafe_reason


class Reader:
    format = ""
    #: Whether directories and other members without data are rows of `members`.
    empty_events = True

    def __init__(self, data: bytes, ctx: Context | None = None) -> None:
        self.data, self.ctx = data, ctx or Context()
        self.ctx.limits.check("max_total_input_bytes", len(data))
        self.entries: list[dict] = []
        self.archive: dict = {}
        self.parse()

    def parse(self) -> None:
        raise NotImplementedError

    def read(self, i: int) -> bytes:
        raise NotImplementedError

    def members(self) -> Iterator[tuple[int, bytes]]:
        for i in range(len(self.entries)):
            yield i, self.read(i)

    def verify(self) -> int:
        """Number of members whose bytes were produced and checked; an error is raised for the first that fails."""
        n = 0
        for _ in self.members():
            n += 1
        return n

    def named(self, total: int, name: bytes) -> int:
        """Checks a name against the limits; gives the sum of name bytes."""
        self.ctx.limits.check("max_name_bytes_per_entry", len(name))
        self.ctx.limits.check("max_total_name_bytes", total + len(name))
        return total + len(name)


def lossy(name: bytes) -> str:
    return name.decode("utf-8", "replace")


def path_fields(name: str | None) -> dict:
    reason = unsafe_reason(name)
    return {"is_safe_path": reason is None, "unsafe_path_reason": reason}


def check_crc(data: bytes, crc: int | None, scope: str = "member", index: int | None = None) -> bytes:
    if crc is not None and zlib.crc32(data) != crc:
        raise checksum(scope, index)
    return data


def posix_kind(mode: int) -> str:
    return {0o040000: "directory", 0o100000: "file", 0o120000: "symlink", 0o010000: "fifo", 0o020000: "character_device", 0o060000: "block_device", 0o140000: "socket"}.get(mode & 0o170000, "unknown")
