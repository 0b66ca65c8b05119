"""AES on numpy arrays of blocks, CBC decryption and CTR; CBC encryption; and the key derivations of 7z and WinZip."""

from __future__ import annotations

import ctypes
import hashlib
import struct
from functools import cache

import numpy as np


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """S-box, its inverse, and products in the field for 1 to 15 by every byte."""
    times = np.zeros((16, 256), np.uint8)
    for a in range(16):
        for b in range(256):
            x, y, r = a, b, 0
            while x:
                r ^= y if x & 1 else 0
                y = (y << 1) ^ (0x11B if y & 0x80 else 0)
                x >>= 1
            times[a, b] = r
    box = np.zeros(256, np.uint8)
    p = q = 1
    while True:
        p ^= (p << 1) & 0xFF ^ (0x1B if p & 0x80 else 0)
        for s in (1, 2, 4):
            q ^= q << s & 0xFF
        q ^= 0x09 if q & 0x80 else 0
        x = q
        for s in (1, 2, 3, 4):
            x ^= (q << s | q >> (8 - s)) & 0xFF
        box[p] = x ^ 0x63
        if p == 1:
            break
    box[0] = 0x63
    back = np.zeros(256, np.uint8)
    back[box] = np.arange(256)
    return box, back, times


_BOX, _BACK, _TIMES = _tables()
_SHIFT = np.array([0, 5, 10, 15, 4, 9, 14, 3, 8, 13, 2, 7, 12, 1, 6, 11])
_UNSHIFT = np.argsort(_SHIFT)


def round_keys(key: bytes) -> np.ndarray:
    n = len(key) // 4
    words = [list(key[4 * i : 4 * i + 4]) for i in range(n)]
    r = 1
    for i in range(n, 4 * (n + 7)):
        w = list(words[-1])
        if i % n == 0:
            w = [int(_BOX[x]) for x in w[1:] + w[:1]]
            w[0] ^= r
            r = r << 1 ^ (0x11B if r & 0x80 else 0)
        elif n > 6 and i % n == 4:
            w = [int(_BOX[x]) for x in w]
        words.append([x ^ y for x, y in zip(words[i - n], w)])
    return np.array(words, np.uint8).reshape(-1, 16)


def _mix(x: np.ndarray, a: int, b: int, c: int, d: int) -> np.ndarray:
    s = x.reshape(-1, 4, 4)
    t = {k: _TIMES[k][s] for k in {a, b, c, d}}
    return np.stack([t[a][:, :, i] ^ t[b][:, :, (i + 1) % 4] ^ t[c][:, :, (i + 2) % 4] ^ t[d][:, :, (i + 3) % 4] for i in range(4)], 2).reshape(-1, 16)


def encrypt(blocks: np.ndarray, keys: np.ndarray) -> np.ndarray:
    x = blocks ^ keys[0]
    for k in keys[1:-1]:
        x = _mix(_BOX[x][:, _SHIFT], 2, 3, 1, 1) ^ k
    return _BOX[x][:, _SHIFT] ^ keys[-1]


def decrypt(blocks: np.ndarray, keys: np.ndarray) -> np.ndarray:
    x = blocks ^ keys[-1]
    for k in keys[-2:0:-1]:
        x = _mix(_BACK[x[:, _UNSHIFT]] ^ k, 14, 11, 13, 9)
    return _BACK[x[:, _UNSHIFT]] ^ keys[0]


def cbc_decrypt(data: bytes, key: bytes, iv: bytes) -> bytes:
    """data is whole blocks; there is no padding."""
    x = np.frombuffer(data, np.uint8).reshape(-1, 16)
    if not len(x):
        return b""
    before = np.concatenate([np.frombuffer(iv, np.uint8).reshape(1, 16), x[:-1]])
    return (decrypt(x, round_keys(key)) ^ before).tobytes()


@cache
def _openssl() -> ctypes.CDLL | None:
    """The OpenSSL that hashlib is linked with, where it is a shared library."""
    try:
        import _hashlib

        lib = ctypes.CDLL(_hashlib.__file__)
        lib.EVP_CIPHER_CTX_new.restype = ctypes.c_void_p
        lib.EVP_CIPHER_CTX_free.argtypes = [ctypes.c_void_p]
        lib.EVP_CIPHER_CTX_set_padding.argtypes = [ctypes.c_void_p, ctypes.c_int]
        lib.EVP_EncryptInit_ex.argtypes = [ctypes.c_void_p, ctypes.c_void_p, ctypes.c_void_p, ctypes.c_char_p, ctypes.c_char_p]
        lib.EVP_EncryptUpdate.argtypes = [ctypes.c_void_p, ctypes.c_char_p, ctypes.POINTER(ctypes.c_int), ctypes.c_char_p, ctypes.c_int]
        for bits in (128, 192, 256):
            getattr(lib, f"EVP_aes_{bits}_cbc").restype = ctypes.c_void_p
    except (ImportError, OSError, AttributeError):
        return None
    return lib


def _cbc_openssl(lib: ctypes.CDLL, data: bytes, key: bytes, iv: bytes) -> bytes | None:
    """None where the library refuses."""
    state = lib.EVP_CIPHER_CTX_new()
    if not state:
        return None
    try:
        if not lib.EVP_EncryptInit_ex(state, getattr(lib, f"EVP_aes_{8 * len(key)}_cbc")(), None, key, iv) or not lib.EVP_CIPHER_CTX_set_padding(state, 0):
            return None
        parts, step = [], 1 << 24
        for at in range(0, len(data), step):
            part, n = data[at : at + step], ctypes.c_int()
            out = ctypes.create_string_buffer(len(part) + 16)
            if not lib.EVP_EncryptUpdate(state, out, ctypes.byref(n), part, len(part)) or n.value != len(part):
                return None
            parts.append(out.raw[: n.value])
        return b"".join(parts)
    finally:
        lib.EVP_CIPHER_CTX_free(state)


@cache
def _columns() -> list[list[int]]:
    """For each row of the state: what a byte there makes of its column, as a word, by SubBytes and MixColumns."""
    s = _BOX.astype(np.int64)
    two, three = _TIMES[2][_BOX].astype(np.int64), _TIMES[3][_BOX].astype(np.int64)
    rows = [(two, s, s, three), (three, two, s, s), (s, three, two, s), (s, s, three, two)]
    return [(a << 24 | b << 16 | c << 8 | d).tolist() for a, b, c, d in rows]


def _cbc_words(data: bytes, key: bytes, iv: bytes) -> bytes:
    """A block at a time in words: a chain can't be turned as an array, and arrays of one block cost some 25 times as much."""
    words = lambda b: struct.unpack(f">{len(b) // 4}I", b)
    keys, box, (t0, t1, t2, t3) = words(round_keys(key).tobytes()), _BOX.tolist(), _columns()
    first, middle, last = keys[:4], [keys[i : i + 4] for i in range(4, len(keys) - 4, 4)], keys[-4:]
    x, out = words(data), []
    a, b, c, d = words(iv)
    for at in range(0, len(x), 4):
        a, b, c, d = a ^ x[at] ^ first[0], b ^ x[at + 1] ^ first[1], c ^ x[at + 2] ^ first[2], d ^ x[at + 3] ^ first[3]
        for k0, k1, k2, k3 in middle:
            a, b, c, d = (
                t0[a >> 24] ^ t1[b >> 16 & 255] ^ t2[c >> 8 & 255] ^ t3[d & 255] ^ k0,
                t0[b >> 24] ^ t1[c >> 16 & 255] ^ t2[d >> 8 & 255] ^ t3[a & 255] ^ k1,
                t0[c >> 24] ^ t1[d >> 16 & 255] ^ t2[a >> 8 & 255] ^ t3[b & 255] ^ k2,
                t0[d >> 24] ^ t1[a >> 16 & 255] ^ t2[b >> 8 & 255] ^ t3[c & 255] ^ k3,
            )
        a, b, c, d = (
            (box[a >> 24] << 24 | box[b >> 16 & 255] << 16 | box[c >> 8 & 255] << 8 | box[d & 255]) ^ last[0],
            (box[b >> 24] << 24 | box[c >> 16 & 255] << 16 | box[d >> 8 & 255] << 8 | box[a & 255]) ^ last[1],
            (box[c >> 24] << 24 | box[d >> 16 & 255] << 16 | box[a >> 8 & 255] << 8 | box[b & 255]) ^ last[2],
            (box[d >> 24] << 24 | box[a >> 16 & 255] << 16 | box[b >> 8 & 255] << 8 | box[c & 255]) ^ last[3],
        )
        out += (a, b, c, d)
    return struct.pack(f">{len(out)}I", *out)


def cbc_encrypt(data: bytes, key: bytes, iv: bytes) -> bytes:
    """data is whole blocks; there is no padding."""
    if len(data) % 16 or len(iv) != 16 or len(key) not in (16, 24, 32):
        raise ValueError("whole blocks, 16 bytes of iv and 16, 24 or 32 of key")
    lib = _openssl()
    out = _cbc_openssl(lib, data, key, iv) if lib else None
    return _cbc_words(data, key, iv) if out is None else out


def ctr(data: bytes, key: bytes) -> bytes:
    """Counter mode as WinZip has it: little-endian counters from 1."""
    n = -(-len(data) // 16)
    counters = np.zeros((n, 16), np.uint8)
    counters[:, :8] = np.arange(1, n + 1, dtype="<u8").view(np.uint8).reshape(n, 8)
    stream = encrypt(counters, round_keys(key)).ravel()[: len(data)]
    return (np.frombuffer(data, np.uint8) ^ stream).tobytes()


def key_7z(password: str, salt: bytes, power: int) -> bytes:
    """SHA-256 over 2^power repeats of salt, UTF-16 password and a counter; power 63 joins salt and password."""
    secret = salt + password.encode("utf-16-le")
    if power == 63:
        return (secret + bytes(32))[:32]
    digest, rounds = hashlib.sha256(), 1 << power
    step = min(rounds, 4096)
    block = np.zeros((step, len(secret) + 8), np.uint8)
    block[:, : len(secret)] = np.frombuffer(secret, np.uint8)
    for at in range(0, rounds, step):
        block[:, len(secret) :] = np.arange(at, at + step, dtype="<u8").view(np.uint8).reshape(step, 8)
        digest.update(block.tobytes())
    return digest.digest()


def keys_winzip(password: bytes, salt: bytes, bits: int) -> tuple[bytes, bytes, bytes]:
    """AES key, authentication key and two verifier bytes."""
    n = bits // 8
    made = hashlib.pbkdf2_hmac("sha1", password, salt, 1000, 2 * n + 2)
    return made[:n], made[n : 2 * n], made[2 * n :]
