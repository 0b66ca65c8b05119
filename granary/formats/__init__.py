"""Readers by format name."""

from __future__ import annotations

from ..errors import unsupported
from ..limits import Context
from .base import Reader


def reader(format: str) -> type[Reader]:
    from .arj import ArjReader
    from .cpio import CpioReader
    from .deb import DebReader
    from .rpm import RpmReader
    from .sevenzip import SevenZipReader
    from .zip import ZipReader

    found = {r.format: r for r in (ArjReader, CpioReader, DebReader, RpmReader, SevenZipReader, ZipReader)}.get(format)
    if not found:
        raise unsupported(f"container-{format}")
    return found


def open_archive(data: bytes, format: str, ctx: Context | None = None) -> Reader:
    """A parsed and validated archive of the named format: zip, 7z, rpm, deb, cpio or arj. The format is never guessed."""
    return reader(format)(data, ctx)
