"""Tar as Debian packages have it: V7, ustar, GNU long names and pax records; strict about sums, padding and the end."""

from __future__ import annotations

from ..errors import FormatError, checksum, unsupported
from ..limits import Context
from .base import lossy, path_fields

_KINDS = {0: "file", 48: "file", 55: "file", 49: "hard_link", 50: "symlink", 51: "character_device", 52: "block_device", 53: "directory", 54: "fifo"}


def number(raw: bytes) -> int:
    """Octal with blanks or zero bytes around it, or big-endian base 256 with a sign when the top bit is set."""
    if raw[0] & 0x80:
        value = int.from_bytes(raw, "big") & ((1 << (8 * len(raw) - 1)) - 1)
        return value - (1 << (8 * len(raw) - 1)) if raw[0] & 0x40 else value
    text = raw.strip(b" \0")
    if not text:
        return 0
    if any(x not in b"01234567" for x in text):
        raise FormatError("tar: a number isn't octal")
    return int(text, 8)


def string(raw: bytes) -> bytes:
    text, _, rest = raw.partition(b"\0")
    if rest.strip(b" \0"):
        raise FormatError("tar: bytes after the end of a string")
    return text


def pax_records(data: bytes) -> dict[str, bytes]:
    out, at = {}, 0
    while at < len(data):
        space = data.find(b" ", at, at + 20)
        if space < 0 or not data[at:space].isdigit():
            raise FormatError("tar: bad pax record length")
        n = int(data[at:space])
        record = data[space + 1 : at + n]
        if at + n > len(data) or not record.endswith(b"\n") or b"=" not in record:
            raise FormatError("tar: bad pax record")
        key, value = record[:-1].split(b"=", 1)
        try:
            out[key.decode("utf-8")] = value
        except UnicodeDecodeError as e:
            raise FormatError("tar: a pax key isn't UTF-8") from e
        at += n
    return out


def _decimal(raw: bytes) -> int:
    if not raw.isdigit():
        raise FormatError("tar: a pax number isn't decimal")
    return int(raw)


def _time(raw: bytes) -> int:
    """Seconds, the fraction cut off towards zero."""
    whole = raw.partition(b".")[0]
    if not whole.lstrip(b"-").isdigit() or whole.count(b"-") > 1:
        raise FormatError("tar: bad pax time")
    return int(whole)


def entries(data: bytes, ctx: Context, section: str, first: int) -> list[tuple[dict, int]]:
    """(row, where its data begins) of each member, numbered from `first`."""
    out: list[tuple[dict, int]] = []
    at, local, everywhere, long_name, long_link, total, names = 0, {}, {}, None, None, 0, 0
    while True:
        ctx.budget.charge()
        block = data[at : at + 512]
        if len(block) < 512:
            raise FormatError("tar: cut, or without two zero blocks at the end")
        if not any(block):
            if len(data) < at + 1024 or any(data[at:]):
                raise FormatError("tar: bytes after the end, or one zero block alone")
            if local or long_name is not None or long_link is not None:
                raise FormatError("tar: an extension without a member")
            return out
        declared = number(block[148:156])
        if declared != sum(block) - sum(block[148:156]) + 256:
            raise checksum("tar_header", first + len(out))
        magic = block[257:265]
        gnu, ustar = magic == b"ustar  \0", magic[:6] == b"ustar\0"
        if not gnu and not ustar and any(magic):
            raise FormatError("tar: unknown magic")
        flag, size = block[156], number(block[124:136])
        if "size" in local or "size" in everywhere:
            size = _decimal(local.get("size", everywhere.get("size"))) if flag not in b"xgLK" else size
        if size < 0:
            raise FormatError("tar: negative size")
        start, end = at + 512, at + 512 + size
        stop = end + -size % 512
        if stop > len(data):
            raise FormatError("tar: a member is cut")
        if any(data[end:stop]):
            raise FormatError("tar: padding isn't zero")
        at = stop
        if flag in b"xg":
            ctx.limits.check("max_header_bytes", size)
            records = pax_records(data[start:end])
            everywhere, local = ({**everywhere, **records}, local) if flag == 103 else (everywhere, {**local, **records})
            continue
        if flag in b"LK":
            ctx.limits.check("max_name_bytes_per_entry", size)
            value = data[start:end].rstrip(b"\0\n")
            long_name, long_link = (value, long_link) if flag == 76 else (long_name, value)
            continue
        if flag not in _KINDS:
            raise unsupported("tar-member-type")
        pax = {**everywhere, **local}
        name = string(block[:100])
        if ustar and block[345]:
            name = string(block[345:500]) + b"/" + name
        name = pax.get("path", name if long_name is None else long_name)
        link = pax.get("linkpath", string(block[157:257]) if long_link is None else long_link)
        kind = _KINDS[flag]
        if flag in (0, 48) and name.endswith(b"/"):
            kind = "directory"
        if kind != "file" and size:
            raise FormatError("tar: a member without data has a size")
        ctx.limits.check("max_files", first + len(out) + 1)
        ctx.limits.check("max_name_bytes_per_entry", len(name))
        names += len(name)
        ctx.limits.check("max_total_name_bytes", names)
        ctx.limits.check("max_entry_output_bytes", size)
        total += size
        ctx.limits.check("max_total_output_bytes", total)
        mode, text, device = number(block[100:108]), lossy(name), kind in ("character_device", "block_device")
        row = {
            "idx": first + len(out), "section": section, "raw_name": name, "name": text, "raw_link_name": link or None, "kind": kind, "mode": mode, "permissions": mode & 0o7777,
            "uid": _decimal(pax["uid"]) if "uid" in pax else number(block[108:116]), "gid": _decimal(pax["gid"]) if "gid" in pax else number(block[116:124]),
            "modified_time": _time(pax["mtime"]) if "mtime" in pax else number(block[136:148]), "size": size,
            "user_name": pax.get("uname", string(block[265:297])), "group_name": pax.get("gname", string(block[297:329])),
            "device_major": number(block[329:337]) if device else None, "device_minor": number(block[337:345]) if device else None, "header_checksum": declared, **path_fields(text),
        }
        out.append((row, start))
        local, long_name, long_link = {}, None, None
