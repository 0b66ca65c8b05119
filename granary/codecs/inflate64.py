"""Deflate64: deflate with a 64 KiB window, longer distances and one length code of 16 extra bits."""

from __future__ import annotations

from ..errors import FormatError
from ..limits import Context

#: Fixed values of the format: order of code length codes, bases and extra bits of lengths and distances.
_ORDER = (16, 17, 18, 0, 8, 7, 9, 6, 10, 5, 11, 4, 12, 3, 13, 2, 14, 1, 15)
_LENGTHS = [(n, 0) for n in range(3, 11)] + [(11 + 2 * k, 1) for k in range(4)] + [(19 + 4 * k, 2) for k in range(4)] + [(35 + 8 * k, 3) for k in range(4)] + [(67 + 16 * k, 4) for k in range(4)] + [(131 + 32 * k, 5) for k in range(4)] + [(3, 16)]
_DISTANCES = [(1 + k, 0) for k in range(4)] + [((2 + k % 2 << e) + 1, e) for e in range(1, 15) for k in range(2)]


def _table(lengths: list[int]) -> tuple[dict[tuple[int, int], int], int]:
    """(bits, code read first bit first) -> symbol; and the longest code."""
    most = max(lengths, default=0)
    count = [0] * (most + 2)
    for n in lengths:
        count[n] += n > 0
    code, first = 0, [0] * (most + 2)
    left = 1
    for bits in range(1, most + 1):
        left = 2 * left - count[bits]
        if left < 0:
            raise FormatError("deflate64: too many codes")
        first[bits] = code = (code + (count[bits - 1] if bits > 1 else 0)) << 1
    out = {}
    for symbol, bits in enumerate(lengths):
        if bits:
            out[bits, first[bits]] = symbol
            first[bits] += 1
    return out, most


class _Bits:
    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.held, self.n = data, 0, 0, 0

    def get(self, bits: int) -> int:
        while self.n < bits:
            if self.at >= len(self.data):
                raise FormatError("deflate64 data is cut")
            self.held |= self.data[self.at] << self.n
            self.at += 1
            self.n += 8
        out = self.held & ((1 << bits) - 1)
        self.held >>= bits
        self.n -= bits
        return out

    def symbol(self, table: tuple[dict, int]) -> int:
        codes, most = table
        code = 0
        for bits in range(1, most + 1):
            code = code << 1 | self.get(1)
            if (found := codes.get((bits, code))) is not None:
                return found
        raise FormatError("deflate64: unknown code")


def inflate64(data: bytes, size: int | None, ctx: Context) -> bytes:
    room = ctx.room if size is None else size
    if size is not None:
        ctx.member(size)
    b, out, last = _Bits(bytes(data)), bytearray(), False
    fixed = (_table([8] * 144 + [9] * 112 + [7] * 24 + [8] * 8), _table([5] * 32))
    while not last:
        last, kind = bool(b.get(1)), b.get(2)
        ctx.budget.charge()
        if kind == 0:
            b.get(b.n % 8)
            n, inverse = b.get(16), b.get(16)
            if n ^ inverse != 0xFFFF:
                raise FormatError("deflate64: stored length mismatch")
            for _ in range(n):
                out.append(b.get(8))
        elif kind == 3:
            raise FormatError("deflate64: unknown block")
        else:
            if kind == 1:
                lit, dist = fixed
            else:
                nl, nd, nc = b.get(5) + 257, b.get(5) + 1, b.get(4) + 4
                first = [0] * 19
                for k in _ORDER[:nc]:
                    first[k] = b.get(3)
                code, lengths = _table(first), []
                while len(lengths) < nl + nd:
                    s = b.symbol(code)
                    if s < 16:
                        lengths.append(s)
                    elif s == 16:
                        if not lengths:
                            raise FormatError("deflate64: repeat without a length")
                        lengths += lengths[-1:] * (3 + b.get(2))
                    else:
                        lengths += [0] * (3 + b.get(3) if s == 17 else 11 + b.get(7))
                if len(lengths) != nl + nd:
                    raise FormatError("deflate64: too many lengths")
                lit, dist = _table(lengths[:nl]), _table(lengths[nl:])
            while (s := b.symbol(lit)) != 256:
                if s < 256:
                    out.append(s)
                else:
                    if s > 285:
                        raise FormatError("deflate64: unknown length")
                    base, extra = _LENGTHS[s - 257]
                    n = base + b.get(extra)
                    k = b.symbol(dist)
                    if k >= len(_DISTANCES):
                        raise FormatError("deflate64: unknown distance")
                    base, extra = _DISTANCES[k]
                    d = base + b.get(extra)
                    if d > len(out):
                        raise FormatError("deflate64: distance before the start")
                    copy(out, d, n)
                if len(out) > room:
                    break
        if len(out) > room:
            if size is None:
                ctx.member(len(out))
            raise FormatError("deflate64 data is longer than declared")
    if b.at != len(b.data):
        raise FormatError("bytes after the deflate64 data")
    if size is not None and len(out) != size:
        raise FormatError(f"deflate64 gives {len(out)} bytes, not {size}")
    ctx.budget.charge_bytes(len(out))
    return bytes(out)


def copy(out: bytearray, distance: int, n: int) -> None:
    """Appends n bytes from `distance` back; the stretch may overlap itself."""
    start = len(out) - distance
    if distance >= n:
        out += out[start : start + n]
    else:
        part = bytes(out[start:])
        out += (part * (n // distance + 1))[:n]
