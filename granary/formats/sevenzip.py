"""7z: header database, coder graphs, solid folders, encoded and encrypted headers, external properties."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

from ..codecs import aes, filters, general, inflate64
from ..cursor import Cursor
from ..errors import ArchiveError, CancelledError, ChecksumError, FormatError, LimitExceededError, PasswordRequiredError, UnsupportedMethodError, WrongPasswordOrCorruptError, checksum, unsupported
from ..limits import Context
from ..paths import unsafe_reason_units
from .base import Reader

SIGNATURE = b"7z\xbc\xaf\x27\x1c"
AES = bytes.fromhex("06f10701")
#: Method ids of branch filters, and of coders with one input.
_BRANCH = {"03030103": "x86", "03030205": "ppc", "03030401": "ia64", "03030501": "arm", "03030701": "thumb", "03030805": "sparc", "0a": "arm64", "04": "x86", "05": "ppc", "06": "ia64", "07": "arm", "08": "thumb", "09": "sparc"}
METHODS = {"00": "copy", "21": "lzma2", "030101": "lzma", "03": "delta", "0303011b": "bcj2", "040108": "deflate", "040109": "deflate64", "040202": "bzip2", "04f71101": "zstd", "04f71102": "brotli", "04f71104": "lz4", "06f10701": "aes", "020302": "swap2", "020304": "swap4", "030401": "ppmd", "0b": "riscv", **_BRANCH}


def uint(c: Cursor) -> int:
    """A number of 1 to 9 bytes; leading ones of the first byte count the bytes that follow."""
    first = c.u8()
    for n in range(8):
        if not first & (0x80 >> n):
            low = int.from_bytes(c.take(n), "little")
            return low | (first & (0x7F >> n)) << (8 * n)
    return c.u64()


def bits(c: Cursor, n: int) -> list[bool]:
    raw = c.take(-(-n // 8))
    return [bool(raw[i >> 3] & 0x80 >> (i & 7)) for i in range(n)]


def optional_bits(c: Cursor, n: int) -> list[bool]:
    return [True] * n if c.u8() else bits(c, n)


def digests(c: Cursor, n: int) -> list[int | None]:
    return [c.u32() if d else None for d in optional_bits(c, n)]


@dataclass
class Coder:
    method: bytes
    inputs: int
    outputs: int
    props: bytes


@dataclass
class Folder:
    coders: list[Coder]
    binds: list[tuple[int, int]]
    packed: list[int]
    sizes: list[int] = field(default_factory=list)
    crc: int | None = None
    first_pack: int = 0
    parts: list[tuple[int, int | None]] = field(default_factory=list)

    @property
    def encrypted(self) -> bool:
        return any(x.method == AES for x in self.coders)

    @property
    def main(self) -> int:
        bound = {o for _, o in self.binds}
        return next(o for o in range(sum(x.outputs for x in self.coders)) if o not in bound)

    @property
    def size(self) -> int:
        return self.sizes[self.main]


@dataclass
class Streams:
    packs: list[tuple[int, int, int | None]] = field(default_factory=list)
    folders: list[Folder] = field(default_factory=list)


class Header:
    """Parses next headers; the totals that limits bound run over all of them."""

    def __init__(self, data: bytes, base: int, end: int, ctx: Context) -> None:
        self.data, self.base, self.end, self.ctx = data, base, end, ctx
        self.coders = self.streams = 0

    def folder(self, c: Cursor) -> Folder:
        lim, coders, ins, outs = self.ctx.limits, [], 0, 0
        n = uint(c)
        if not n:
            raise FormatError("7z: a folder without coders")
        lim.check("max_coders_per_folder", n)
        self.coders += n
        lim.check("max_total_coders", self.coders)
        for _ in range(n):
            flags = c.u8()
            if flags & 0x80:
                raise unsupported("alternative-coder-methods")
            if flags & 0x40:
                raise FormatError("7z: reserved coder flag")
            method = c.take(flags & 15)
            i, o = (uint(c), uint(c)) if flags & 0x10 else (1, 1)
            ins, outs = ins + i, outs + o
            lim.check("max_streams_per_folder", ins + outs)
            props = b""
            if flags & 0x20:
                size = uint(c)
                lim.check("max_coder_property_bytes", size)
                props = c.take(size)
            coders.append(Coder(method, i, o, props))
        self.streams += ins + outs
        lim.check("max_total_streams", self.streams)
        if not outs:
            raise FormatError("7z: a folder without an output")
        binds = [(uint(c), uint(c)) for _ in range(outs - 1)]
        free = ins - len(binds)
        if free < 0:
            raise FormatError("7z: more bind pairs than inputs")
        bound = {i for i, _ in binds}
        packed = [uint(c) for _ in range(free)] if free > 1 else [i for i in range(ins) if i not in bound][:1] if free else []
        f = Folder(coders, binds, packed)
        self._graph(f, ins, outs)
        return f

    @staticmethod
    def _graph(f: Folder, ins: int, outs: int) -> None:
        """Every input has one source, one output is free, and no coder waits for itself."""
        sources = [i for i, _ in f.binds] + f.packed
        if sorted(sources) != list(range(ins)) or len({o for _, o in f.binds}) != len(f.binds) or any(o >= outs for _, o in f.binds):
            raise FormatError("7z: bad bind pairs")
        owner_in = [k for k, x in enumerate(f.coders) for _ in range(x.inputs)]
        owner_out = [k for k, x in enumerate(f.coders) for _ in range(x.outputs)]
        waits: dict[int, set[int]] = {k: set() for k in range(len(f.coders))}
        for i, o in f.binds:
            waits[owner_in[i]].add(owner_out[o])
        while ready := [k for k, w in waits.items() if not w]:
            for k in ready:
                del waits[k]
            for w in waits.values():
                w.difference_update(ready)
        if waits:
            raise FormatError("7z: the coders form a cycle")

    def streams_info(self, c: Cursor, extra: list[bytes] | None = None) -> Streams:
        out, kind, lim = Streams(), c.u8(), self.ctx.limits
        pack_sizes: list[int] = []
        if kind == 6:
            at, n = self.base + 32 + uint(c), uint(c)
            lim.check("max_total_streams", n)
            crcs: list[int | None] = [None] * n
            kind = c.u8()
            if kind == 9:
                pack_sizes = [uint(c) for _ in range(n)]
                kind = c.u8()
            elif n:
                raise unsupported("unknown-packed-stream-size")
            if kind == 10:
                crcs = digests(c, n)
                kind = c.u8()
            if kind:
                raise FormatError("7z: bad pack info")
            for size, crc in zip(pack_sizes, crcs):
                if at + size > self.end:
                    raise FormatError("7z: a packed stream lies outside of the archive", needs=at + size)
                out.packs.append((at, size, crc))
                at += size
            kind = c.u8()
        if kind == 7:
            self._folders(c, out, extra)
            kind = c.u8()
        if kind == 8:
            self._substreams(c, out)
            kind = c.u8()
        else:
            for f in out.folders:
                f.parts = [(f.size, f.crc)]
        if kind:
            raise FormatError("7z: bad streams info")
        return out

    def _folders(self, c: Cursor, out: Streams, extra: list[bytes] | None) -> None:
        if c.u8() != 11:
            raise FormatError("7z: no folders")
        n = uint(c)
        self.ctx.limits.check("max_folders", n)
        source = c
        if c.u8():
            source = Cursor(self._external(c, extra), what="7z: external folders")
        first = 0
        for _ in range(n):
            self.ctx.budget.charge()
            f = self.folder(source)
            f.first_pack, first = first, first + len(f.packed)
            out.folders.append(f)
        if source is not c:
            source.done()
        if first > len(out.packs):
            raise FormatError("7z: more packed streams are used than there are")
        if c.u8() != 12:
            raise FormatError("7z: no unpack sizes")
        for f in out.folders:
            f.sizes = [uint(c) for _ in range(sum(x.outputs for x in f.coders))]
        kind = c.u8()
        if kind == 10:
            for f, crc in zip(out.folders, digests(c, n)):
                f.crc = crc
            kind = c.u8()
        if kind:
            raise FormatError("7z: bad unpack info")

    def _external(self, c: Cursor, extra: list[bytes] | None) -> bytes:
        k = uint(c)
        if extra is None or k >= len(extra):
            raise FormatError("7z: no such external stream")
        return extra[k]

    def _substreams(self, c: Cursor, out: Streams) -> None:
        kind, counts = c.u8(), [1] * len(out.folders)
        if kind == 13:
            counts = [uint(c) for _ in out.folders]
            kind = c.u8()
        self.ctx.limits.check("max_substreams", sum(counts))
        sizes = []
        for f, n in zip(out.folders, counts):
            own = [uint(c) for _ in range(n - 1)] if kind == 9 else []
            if n > 1 and kind != 9:
                raise FormatError("7z: no substream sizes")
            if n:
                if sum(own) > f.size:
                    raise FormatError("7z: substreams are longer than their folder")
                own.append(f.size - sum(own))
            sizes.append(own)
        if kind == 9:
            kind = c.u8()
        unknown = sum(n for f, n in zip(out.folders, counts) if n != 1 or f.crc is None)
        crcs = iter([None] * unknown)
        if kind == 10:
            crcs = iter(digests(c, unknown))
            kind = c.u8()
        if kind:
            raise FormatError("7z: bad substreams info")
        for f, own in zip(out.folders, sizes):
            f.parts = [(s, f.crc if len(own) == 1 and f.crc is not None else next(crcs)) for s in own]


def decode(f: Folder, packs: list[tuple[int, int, int | None]], data: bytes, ctx: Context) -> bytes:
    """The folder's output, its CRC tested."""
    total = f.size
    ctx.limits.check("max_total_output_bytes", ctx.produced + total)
    try:
        out = _run(f, packs, data, ctx)
        if len(out) != total:
            raise FormatError("7z: folder size mismatch")
        if f.crc is not None and zlib.crc32(out) != f.crc:
            raise checksum("folder")
    except (FormatError, ChecksumError) as e:
        if f.encrypted and e.fields.get("scope") != "packed_stream":
            raise WrongPasswordOrCorruptError("7z: wrong password or corrupt data") from e
        raise
    ctx.budget.charge_bytes(total)
    return out


def _run(f: Folder, packs: list, data: bytes, ctx: Context) -> bytes:
    inputs: dict[int, bytes] = {}
    for k, i in enumerate(f.packed):
        at, size, crc = packs[f.first_pack + k]
        inputs[i] = bytes(data[at : at + size])
        if crc is not None and zlib.crc32(inputs[i]) != crc:
            raise checksum("packed_stream")
    source = {i: o for i, o in f.binds}
    first_in, first_out, n = [], [], 0
    for x in f.coders:
        first_in.append(n)
        n += x.inputs
    n = 0
    for x in f.coders:
        if x.outputs != 1:
            raise unsupported("multi-output-coder")
        first_out.append(n)
        n += x.outputs

    def output(o: int) -> bytes:
        k = first_out.index(o)
        x = f.coders[k]
        ins = [inputs[i] if i in inputs else output(source[i]) for i in range(first_in[k], first_in[k] + x.inputs)]
        return _coder(x, ins, f.sizes[o], ctx)

    return output(f.main)


def _coder(x: Coder, ins: list[bytes], size: int, ctx: Context) -> bytes:
    name, props = METHODS.get(x.method.hex()), x.props
    if x.inputs != (4 if name == "bcj2" else 1):
        raise FormatError("7z: a coder has a wrong number of inputs")
    data = ins[0]
    inner = Context(ctx.limits, ctx.budget)
    lim = max(size, 1)
    if name != "aes":
        ctx.limits.check("max_total_output_bytes", lim)
    inner.limits = ctx.limits if lim <= ctx.limits.max_entry_output_bytes else _wider(ctx, lim)
    if name == "copy":
        return general.stored(data, size, inner)
    if name == "lzma":
        return general.lzma1(data, props, size, inner)
    if name == "lzma2":
        if len(props) != 1:
            raise FormatError("7z: LZMA2 has one property byte")
        return general.lzma2(data, props[0], size, inner)
    if name == "deflate":
        return general.deflate(data, size, inner)
    if name == "deflate64":
        return inflate64.inflate64(data, size, inner)
    if name == "bzip2":
        return general.bzip2(data, size, inner)
    if name == "zstd":
        from .streams import check_zstd

        check_zstd(data, inner)
        return general.zstd_frame(data, size, inner)
    if name == "brotli":
        return general.brotli(data, size, inner)
    if name == "lz4":
        return general.lz4_frame(data, size, inner)
    if name == "aes":
        return _aes(data, props, size, ctx)
    if name == "delta":
        out = filters.delta(data, props)
    elif name in ("swap2", "swap4"):
        out = filters.swap(data, int(name[-1]))
    elif name == "bcj2":
        return filters.bcj2(ins[0], ins[1], ins[2], ins[3], size)
    elif x.method.hex() in _BRANCH:
        out = filters.branch(name, data, props)
    else:
        raise UnsupportedMethodError(f"7z: method {x.method.hex()}", method_id=x.method.hex())
    if len(out) != size:
        raise FormatError("7z: a filter's size mismatch")
    return out


def _wider(ctx: Context, size: int):
    """A solid folder may be longer than a member may be; its members are checked one by one."""
    import dataclasses

    return dataclasses.replace(ctx.limits, max_entry_output_bytes=size)


def _aes(data: bytes, props: bytes, size: int, ctx: Context) -> bytes:
    c = Cursor(props, what="7z: AES properties")
    first = c.u8()
    salt_n, iv_n = first >> 7 & 1, first >> 6 & 1
    if first & 0xC0:
        second = c.u8()
        salt_n, iv_n = salt_n + (second >> 4), iv_n + (second & 15)
    salt, iv = c.take(salt_n), c.take(iv_n)
    c.done()
    power = first & 63
    if power != 63:
        ctx.limits.check("max_kdf_power", power)
    if ctx.password is None:
        raise PasswordRequiredError("7z: a password is needed")
    if len(data) % 16 or size > len(data):
        raise FormatError("7z: encrypted data isn't whole blocks")
    password = ctx.password.decode() if isinstance(ctx.password, bytes) else ctx.password
    return aes.cbc_decrypt(data, aes.key_7z(password, salt, power), iv.ljust(16, b"\0"))[:size]


class SevenZipReader(Reader):
    format = "7z"
    empty_events = False

    def parse(self) -> None:
        data, first = self.data, None
        stop = min(len(data), self.ctx.limits.sfx_scan_limit + len(SIGNATURE))
        at = 0 if data[:6] == SIGNATURE else data.find(SIGNATURE, 0, stop)
        while at >= 0:
            try:
                self._open(at)
                return
            except (CancelledError, LimitExceededError, PasswordRequiredError, WrongPasswordOrCorruptError):
                raise
            except ArchiveError as e:
                first = first or e
                self.entries = []
            at = data.find(SIGNATURE, at + 1, stop) if at or stop > 6 else -1
        raise first or FormatError("7z: no signature")

    def _open(self, base: int) -> None:
        c = Cursor(self.data, base + 6, what="7z: start header")
        major, minor, start_crc = c.unpack("<BBI")
        if major:
            raise unsupported("7z-major-version")
        fixed = c.take(20)
        if zlib.crc32(fixed) != start_crc:
            raise checksum("start_header")
        offset, size, crc = struct.unpack("<QQI", fixed)
        self.archive = {"sfx_offset": base, "major": major, "minor": minor}
        self.main, self.extra, self._spots = Streams(), [], []
        if not size:
            return
        self.ctx.limits.check("max_header_bytes", size)
        at = base + 32 + offset
        if at + size > len(self.data):
            raise FormatError("7z: the next header lies outside of the input", needs=at + size)
        raw = bytes(self.data[at : at + size])
        if zlib.crc32(raw) != crc:
            raise checksum("next_header")
        h = Header(self.data, base, len(self.data), self.ctx)
        for depth in range(self.ctx.limits.max_recursion_depth + 2):
            self.ctx.limits.check("max_recursion_depth", depth)
            c = Cursor(raw, what="7z: header")
            kind = c.u8()
            if kind == 1:
                self._header(c, h)
                c.done()
                return
            if kind != 0x17:
                raise FormatError("7z: unknown header")
            s = h.streams_info(c)
            c.done()
            if not s.folders:
                raise FormatError("7z: an encoded header without a folder")
            self.ctx.limits.check("max_header_bytes", sum(f.size for f in s.folders))
            try:
                raw = b"".join(decode(f, s.packs, self.data, self.ctx) for f in s.folders)
            except ChecksumError as e:
                raise checksum("encoded_header") if e.fields.get("scope") == "folder" else e

    def _header(self, c: Cursor, h: Header) -> None:
        kind = c.u8()
        if kind == 2:
            while (p := uint(c)) != 0:
                c.skip(uint(c))
            kind = c.u8()
        if kind == 3:
            s = h.streams_info(c)
            self.extra = [decode(f, s.packs, self.data, self.ctx) for f in s.folders]
            kind = c.u8()
        if kind == 4:
            self.main = h.streams_info(c, self.extra)
            kind = c.u8()
        if kind == 5:
            self._files(c, h)
            kind = c.u8()
        if kind:
            raise FormatError("7z: bad header")

    def _files(self, c: Cursor, h: Header) -> None:
        n, lim = uint(c), self.ctx.limits
        lim.check("max_files", n)
        empty, props, count = [False] * n, {}, 0
        while (kind := uint(c)) != 0:
            count += 1
            lim.check("max_header_properties", count)
            p = c.sub(uint(c), "7z: file property")
            if kind in props and kind != 0x19:
                raise FormatError("7z: a file property stands twice")
            props[kind] = p
            if kind == 0x0E:
                empty = bits(p, n)
                p.done()
            elif kind == 0x19 and any(p.take(p.left)):
                raise FormatError("7z: padding isn't zero")
        none = sum(empty)

        def flags(kind: int) -> list[bool]:
            out = [False] * n
            if kind in props:
                held = iter(bits(props[kind], none))
                props[kind].done()
                out = [e and next(held) for e in empty]
            return out

        def values(kind: int, layout: str) -> list[int | None]:
            p = props.get(kind)
            if p is None:
                return [None] * n
            known = optional_bits(p, n)
            q = Cursor(h._external(p, self.extra), what="7z: external property") if p.u8() else p
            out = [q.unpack(layout)[0] if d else None for d in known]
            q.done()
            p.done()
            return out

        empty_file, anti = flags(0x0F), flags(0x10)
        names = self._names(props.get(0x11), n, h)
        created, accessed, modified = (values(k, "<Q") for k in (0x12, 0x13, 0x14))
        attributes, starts = values(0x15, "<I"), values(0x18, "<Q")
        spots = [(k, j, size, crc) for k, f in enumerate(self.main.folders) for j, (size, crc) in enumerate(f.parts)]
        if len(spots) != n - none:
            raise FormatError("7z: files and substreams don't match")
        self._spots: list[tuple | None] = []
        held = iter(spots)
        for i in range(n):
            self.ctx.budget.charge()
            spot = None if empty[i] else next(held)
            self._spots.append(spot)
            a = attributes[i]
            mode = a >> 16 if a is not None and a & 0x8000 else None
            link = mode is not None and mode & 0o170000 == 0o120000
            kind = "anti_item" if anti[i] else "symlink" if link else "file" if spot or empty_file[i] else "directory"
            units = names[i]
            reason = unsafe_reason_units(units)
            self.entries.append({
                "idx": i, "raw_name": units, "name": None if units is None else struct.pack(f"<{len(units)}H", *units).decode("utf-16-le", "replace"), "kind": kind, "has_stream": spot is not None,
                "is_empty_file": empty_file[i], "is_anti_item": anti[i], "size": spot[2] if spot else 0 if empty_file[i] and not anti[i] else None, "crc32": spot[3] if spot else None,
                "creation_time": created[i], "access_time": accessed[i], "modification_time": modified[i], "windows_attributes": a, "start_position": starts[i], "unix_mode": mode,
                "is_symlink": link, "is_safe_path": reason is None, "unsafe_path_reason": reason, "folder_index": spot[0] if spot else None, "substream_index": spot[1] if spot else None,
            })

    def _names(self, p: Cursor | None, n: int, h: Header) -> list[list[int] | None]:
        if p is None:
            return [None] * n
        q = Cursor(h._external(p, self.extra), what="7z: external names") if p.u8() else p
        raw = q.take(q.left)
        p.done()
        if len(raw) % 2:
            raise FormatError("7z: names have an odd number of bytes")
        self.ctx.limits.check("max_total_name_bytes", len(raw))
        units, out, at = struct.unpack(f"<{len(raw) // 2}H", raw), [], 0
        for _ in range(n):
            try:
                end = units.index(0, at)
            except ValueError:
                raise FormatError("7z: a name isn't ended") from None
            self.ctx.limits.check("max_name_bytes_per_entry", 2 * (end - at))
            out.append(list(units[at:end]))
            at = end + 1
        if at != len(units):
            raise FormatError("7z: more names than files")
        return out

    def _part(self, i: int, folder: bytes) -> bytes:
        k, j, size, crc = self._spots[i]
        at = sum(s for s, _ in self.main.folders[k].parts[:j])
        out = folder[at : at + size]
        if len(out) != size:
            raise FormatError("7z: a member runs out of its folder")
        if crc is not None and zlib.crc32(out) != crc:
            if self.main.folders[k].encrypted:
                raise WrongPasswordOrCorruptError("7z: wrong password or corrupt data")
            raise checksum("member", i)
        self.ctx.made(size)
        return out

    def read(self, i: int) -> bytes:
        e = self.entries[i]
        if e["is_anti_item"]:
            raise unsupported("anti-item-extraction")
        if not e["has_stream"]:
            if e["is_empty_file"]:
                return b""
            raise unsupported("streamless-directory-extraction")
        self.ctx.limits.check("max_entry_output_bytes", e["size"])
        f = self.main.folders[self._spots[i][0]]
        return self._part(i, decode(f, self.main.packs, self.data, self.ctx))

    def members(self) -> Iterator[tuple[int, bytes]]:
        """Files in order; each folder is decoded once. Directories and anti-items have no row, empty files an empty one."""
        held, folder = None, b""
        offsets: dict[int, int] = {}
        for i, e in enumerate(self.entries):
            if e["is_anti_item"] or not (e["has_stream"] or e["is_empty_file"]):
                continue
            if not e["has_stream"]:
                yield i, b""
                continue
            k, j, size, crc = self._spots[i]
            if k != held:
                held, folder, offsets = k, decode(self.main.folders[k], self.main.packs, self.data, self.ctx), {k: 0}
            at = offsets[k]
            out = folder[at : at + size]
            offsets[k] = at + size
            if crc is not None and zlib.crc32(out) != crc:
                if self.main.folders[k].encrypted:
                    raise WrongPasswordOrCorruptError("7z: wrong password or corrupt data")
                raise checksum("member", i)
            self.ctx.made(size)
            yield i, out

    def verify(self) -> int:
        """All folders, those without members as well."""
        used = {s[0] for s in self._spots if s}
        n = super().verify()
        for k, f in enumerate(self.main.folders):
            if k not in used:
                decode(f, self.main.packs, self.data, self.ctx)
        return n

    def folders(self) -> list[dict]:
        """A row for each folder: its coders, bind pairs, packed inputs, sizes."""
        return [{"folder_index": k, "coders": [{"method_id": x.method, "method": METHODS.get(x.method.hex()), "inputs": x.inputs, "outputs": x.outputs, "properties": x.props} for x in f.coders], "bind_pairs": [{"input": i, "output": o} for i, o in f.binds], "packed_inputs": f.packed, "unpack_sizes": f.sizes, "crc32": f.crc, "substreams": len(f.parts), "is_encrypted": f.encrypted} for k, f in enumerate(self.main.folders)]

    def pack_streams(self) -> list[dict]:
        return [{"pack_index": k, "offset": at, "size": size, "crc32": crc} for k, (at, size, crc) in enumerate(self.main.packs)]
