"""ZipCrypto and WinZip AES, undone."""

from __future__ import annotations

import hashlib
import hmac
import zlib

from ..errors import FormatError, WrongPasswordOrCorruptError
from . import aes

_TABLE: list[int] = []


def _crc_table() -> list[int]:
    if not _TABLE:
        for i in range(256):
            c = i
            for _ in range(8):
                c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
            _TABLE.append(c)
    return _TABLE


def zipcrypto(data: bytes, password: bytes, check: int) -> bytes:
    """data begins with 12 header bytes, the last of which must equal `check`."""
    if len(data) < 12:
        raise FormatError("zip: encrypted data is cut")
    table = _crc_table()
    a, b, c = 0x12345678, 0x23456789, 0x34567890
    for p in password:
        a = a >> 8 ^ table[(a ^ p) & 255]
        b = ((b + (a & 255)) * 134775813 + 1) & 0xFFFFFFFF
        c = c >> 8 ^ table[(c ^ b >> 24) & 255]
    out = bytearray(len(data))
    for i, x in enumerate(data):
        t = c | 2
        p = x ^ (t * (t ^ 1) >> 8) & 255
        out[i] = p
        a = a >> 8 ^ table[(a ^ p) & 255]
        b = ((b + (a & 255)) * 134775813 + 1) & 0xFFFFFFFF
        c = c >> 8 ^ table[(c ^ b >> 24) & 255]
    if out[11] != check:
        raise WrongPasswordOrCorruptError("zip: wrong password or corrupt data")
    return bytes(out[12:])


def winzip_aes(data: bytes, password: bytes, bits: int) -> bytes:
    """Salt, two verifier bytes, data and a 10-byte authentication code, which is tested before anything is decrypted."""
    salt_len = bits // 16
    if len(data) < salt_len + 12:
        raise FormatError("zip: encrypted data is cut")
    key, auth, verifier = aes.keys_winzip(password, data[:salt_len], bits)
    if not hmac.compare_digest(verifier, data[salt_len : salt_len + 2]):
        raise WrongPasswordOrCorruptError("zip: wrong password or corrupt data")
    body = data[salt_len + 2 : -10]
    if not hmac.compare_digest(hmac.new(auth, body, hashlib.sha1).digest()[:10], data[-10:]):
        raise WrongPasswordOrCorruptError("zip: wrong password or corrupt data")
    return aes.ctr(body, key)
