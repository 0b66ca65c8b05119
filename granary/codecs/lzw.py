"""Unix compress (.Z): LZW with 9 to 16 bits, whose codes come in groups of eight."""

from __future__ import annotations

from ..errors import FormatError
from ..limits import Context


def lzw(data: bytes, most_bits: int, block_mode: bool, ctx: Context) -> bytes:
    """data: what follows the three header bytes. A change of width, and CLEAR (256 in block mode), skip the rest of the
    group of eight codes."""
    room = ctx.room
    table: list[bytes] = [bytes((i,)) for i in range(256)] + [b""] * block_mode
    out: list[bytes] = []
    total, bits, at, prev = 0, 9, 0, b""
    end, top = len(data), 1 << most_bits
    while at < end:
        group = data[at : at + bits]
        at += bits
        held, count = int.from_bytes(group, "little"), len(group) * 8 // bits
        mask, limit = (1 << bits) - 1, 1 << bits
        ctx.budget.charge()
        for _ in range(count):
            code = held & mask
            held >>= bits
            if block_mode and code == 256:
                del table[257:]
                bits, prev = 9, b""
                break
            n = len(table)
            if not prev:
                if code >= 256:
                    raise FormatError(".Z data begins with a code that isn't defined")
                word = table[code]
            else:
                if code < n:
                    word = table[code]
                elif code == n and n < top:
                    word = prev + prev[:1]
                else:
                    raise FormatError(".Z code isn't defined")
                if n < top:
                    table.append(prev + word[:1])
            out.append(word)
            total += len(word)
            if total > room:
                ctx.member(total)
            prev = word
            if len(table) == limit and bits < most_bits:
                bits += 1
                break
    return b"".join(out)
