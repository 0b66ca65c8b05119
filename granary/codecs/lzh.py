"""ARJ methods 1 to 4: LZ77 with Huffman blocks, and the "fastest" method with unary-prefixed numbers."""

from __future__ import annotations

from ..errors import FormatError
from ..limits import Context
from .inflate64 import copy

#: Fixed values of the format: code length codes, literals and lengths, positions; the shortest match; bits of counts.
_NT, _NC, _NP, _LEAST = 19, 510, 17, 3
_TBIT, _CBIT, _PBIT = 5, 9, 5


class _Bits:
    """Bits, highest first. Reading past the end gives zeros for two bytes, as look-ahead does, and is then an error."""

    def __init__(self, data: bytes) -> None:
        self.value, self.n = int.from_bytes(data, "big"), 8 * len(data)
        self.data, self.at = data, 0

    def get(self, k: int) -> int:
        end = self.at + k
        if end > self.n + 16:
            raise FormatError("arj: data is cut")
        first, last = self.at >> 3, -(-end >> 3)
        part = self.data[first : (end + 7) >> 3]
        want = ((end + 7) >> 3) - first
        part = part + bytes(want - len(part))
        self.at = end
        return int.from_bytes(part, "big") >> (8 * want - (end - 8 * first)) & ((1 << k) - 1)


def _codes(lengths: list[int]) -> tuple[dict[tuple[int, int], int], int]:
    most = max(lengths, default=0)
    out, code, total = {}, 0, 0
    for bits in range(1, most + 1):
        for symbol, n in enumerate(lengths):
            if n == bits:
                out[bits, code] = symbol
                code += 1
                total += 1 << (16 - bits)
        code <<= 1
    if total != 1 << 16:
        raise FormatError("arj: incomplete or too many codes")
    return out, most


def _symbol(b: _Bits, table) -> int:
    if isinstance(table, int):
        return table
    codes, most = table
    code = 0
    for bits in range(1, most + 1):
        code = code << 1 | b.get(1)
        if (s := codes.get((bits, code))) is not None:
            return s
    raise FormatError("arj: unknown code")


def _short_lengths(b: _Bits, most: int, count_bits: int, gap: int | None):
    """The table of code lengths (gap: after the third a run of zeros is told) or of positions; one symbol alone is a number."""
    n = b.get(count_bits)
    if not n:
        return b.get(count_bits)
    if n > most:
        raise FormatError("arj: too many code lengths")
    out: list[int] = []
    while len(out) < n:
        k = b.get(3)
        if k == 7:
            while b.get(1):
                k += 1
                if k > 16:
                    raise FormatError("arj: a code is too long")
        out.append(k)
        if gap is not None and len(out) == gap:
            out += [0] * b.get(2)
    return _codes(out + [0] * (most - len(out)))


def _literal_lengths(b: _Bits, table):
    n = b.get(_CBIT)
    if not n:
        return b.get(_CBIT)
    if n > _NC:
        raise FormatError("arj: too many code lengths")
    out: list[int] = []
    while len(out) < n:
        s = _symbol(b, table)
        out += [0] if s == 0 else [0] * (b.get(4) + 3) if s == 1 else [0] * (b.get(_CBIT) + 20) if s == 2 else [s - 2]
    if len(out) > _NC:
        raise FormatError("arj: too many code lengths")
    return _codes(out + [0] * (_NC - len(out)))


def huffman(data: bytes, size: int, ctx: Context) -> bytes:
    """Methods 1 to 3."""
    ctx.member(size)
    b, out, left = _Bits(bytes(data)), bytearray(), 0
    literal = position = 0
    while len(out) < size:
        if not left:
            left = b.get(16)
            if not left:
                raise FormatError("arj: an empty block")
            ctx.budget.charge()
            literal = _literal_lengths(b, _short_lengths(b, _NT, _TBIT, 3))
            position = _short_lengths(b, _NP, _PBIT, None)
        left -= 1
        c = _symbol(b, literal)
        if c < 256:
            out.append(c)
            continue
        p = _symbol(b, position)
        distance = (p if p < 2 else (1 << (p - 1)) + b.get(p - 1)) + 1
        n = c - 256 + _LEAST
        if distance > len(out) or len(out) + n > size:
            raise FormatError("arj: a match lies outside of the data")
        copy(out, distance, n)
    return bytes(out)


def _number(b: _Bits, low: int, high: int) -> int:
    """Ones up to a zero or to the limit widen the number and raise its base."""
    width, base = low, 0
    while width < high and b.get(1):
        base += 1 << width
        width += 1
    return base + (b.get(width) if width else 0)


def fastest(data: bytes, size: int, ctx: Context) -> bytes:
    """Method 4."""
    ctx.member(size)
    b, out = _Bits(bytes(data)), bytearray()
    while len(out) < size:
        n = _number(b, 0, 7)
        if not n:
            out.append(b.get(8))
            continue
        n += _LEAST - 1
        distance = _number(b, 9, 13) + 1
        if distance > len(out) or len(out) + n > size:
            raise FormatError("arj: a match lies outside of the data")
        copy(out, distance, n)
    return bytes(out)
