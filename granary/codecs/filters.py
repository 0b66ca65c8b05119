"""Branch, delta and byte-swap filters of 7z and XZ, undone.

Where liblzma knows a filter, the data goes through it as stored LZMA2 chunks; the rest are numpy or plain Python.
"""

from __future__ import annotations

import lzma

import numpy as np

from ..errors import FormatError

_NATIVE = {"x86": lzma.FILTER_X86, "ppc": lzma.FILTER_POWERPC, "ia64": lzma.FILTER_IA64, "arm": lzma.FILTER_ARM, "thumb": lzma.FILTER_ARMTHUMB, "sparc": lzma.FILTER_SPARC}


def _through(data: bytes, first: dict) -> bytes:
    """data decoded by a filter of liblzma: it is fed as stored chunks, which LZMA2 gives back unchanged."""
    parts = []
    for at in range(0, len(data), 1 << 16):
        part = data[at : at + (1 << 16)]
        parts += [b"\x02" if at else b"\x01", (len(part) - 1).to_bytes(2, "big"), part]
    d = lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=[first, {"id": lzma.FILTER_LZMA2, "dict_size": 4096}])
    return d.decompress(b"".join(parts) + b"\0")


def _start(props: bytes) -> int:
    if len(props) not in (0, 4):
        raise FormatError("a branch filter has 0 or 4 property bytes")
    return int.from_bytes(props, "little")


def branch(name: str, data: bytes, props: bytes = b"") -> bytes:
    start = _start(props)
    if not data:
        return b""
    if name == "arm64":
        return arm64(data, start)
    return _through(bytes(data), {"id": _NATIVE[name], "start_offset": start} if start else {"id": _NATIVE[name]})


def delta(data: bytes, props: bytes) -> bytes:
    """Each byte is a difference to the one `distance` before."""
    if len(props) != 1:
        raise FormatError("delta has one property byte")
    step = props[0] + 1
    x = np.frombuffer(data, np.uint8)
    pad = -len(x) % step
    rows = np.concatenate([x, np.zeros(pad, np.uint8)]).reshape(-1, step)
    return np.cumsum(rows, axis=0, dtype=np.uint8).ravel()[: len(x)].tobytes()


def arm64(data: bytes, start: int = 0) -> bytes:
    """BL takes a 26-bit word offset; ADRP a page offset, whose range is limited to +-512 MiB."""
    n = len(data) & ~3
    w = np.frombuffer(data[:n], "<u4").astype(np.uint32)
    pc = np.arange(start, start + n, 4, dtype=np.uint64).astype(np.uint32)
    out = w.copy()
    with np.errstate(over="ignore"):
        bl = w >> 26 == 0x25
        out[bl] = 0x94000000 | ((w[bl] - (pc[bl] >> 2)) & 0x03FFFFFF)
        src = ((w >> 29) & 3) | ((w >> 3) & 0x001FFFFC)
        adrp = ((w & 0x9F000000) == 0x90000000) & (((src + 0x00020000) & 0x001C0000) == 0)
        dest = src[adrp] - (pc[adrp] >> 12)
        sign = (np.uint32(0) - (dest & 0x00020000)) & np.uint32(0x00E00000)
        out[adrp] = (w[adrp] & 0x9000001F) | ((dest & 3) << 29) | ((dest & 0x0003FFFC) << 3) | sign
    return out.astype("<u4").tobytes() + bytes(data[n:])


def swap(data: bytes, width: int) -> bytes:
    """Bytes of each group of 2 or 4 reversed; a tail that is shorter stays."""
    n = len(data) - len(data) % width
    return np.frombuffer(data[:n], f"<u{width}").byteswap().tobytes() + bytes(data[n:])


def bcj2(main: bytes, calls: bytes, jumps: bytes, coded: bytes, size: int) -> bytes:
    """x86 branches split into four streams: the rest, CALL targets, jump targets, and range-coded flags that tell
    which branches were taken out."""
    if len(coded) < 5 or coded[0]:
        raise FormatError("bad BCJ2 range coder")
    probs, code, bound_at, span = [1 << 10] * 258, int.from_bytes(coded[1:5], "big"), 5, 0xFFFFFFFF
    out, prev, at, c, j = bytearray(), 0, 0, 0, 0
    while len(out) < size:
        if at >= len(main):
            raise FormatError("BCJ2 main stream is cut")
        b = main[at]
        at += 1
        out.append(b)
        if len(out) == size and not (b & 0xFE == 0xE8 or prev == 0x0F and b & 0xF0 == 0x80):
            break
        if b & 0xFE == 0xE8 or prev == 0x0F and b & 0xF0 == 0x80:
            k = prev if b == 0xE8 else 256 if b == 0xE9 else 257
            bound = (span >> 11) * probs[k]
            if code < bound:
                span, bit = bound, 0
                probs[k] += (2048 - probs[k]) >> 5
            else:
                span, code, bit = span - bound, code - bound, 1
                probs[k] -= probs[k] >> 5
            if span < 1 << 24:
                if bound_at >= len(coded):
                    raise FormatError("BCJ2 range coder is cut")
                span, code = span << 8, (code << 8 | coded[bound_at]) & 0xFFFFFFFF
                bound_at += 1
            if bit:
                if b == 0xE8:
                    part, c = calls[c : c + 4], c + 4
                else:
                    part, j = jumps[j : j + 4], j + 4
                if len(part) < 4:
                    raise FormatError("BCJ2 target stream is cut")
                target = (int.from_bytes(part, "big") - (len(out) + 4)) & 0xFFFFFFFF
                word = target.to_bytes(4, "little")
                out += word[: size - len(out)]
                prev = word[3]
                continue
        prev = b
    if at != len(main) or c != len(calls) or j != len(jumps):
        raise FormatError("BCJ2 streams have bytes left")
    return bytes(out)
