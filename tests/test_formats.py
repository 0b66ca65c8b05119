"""Readers without Spark: round trips, published vectors, and the negative matrix (every cut, damaged and trailing bytes, limits)."""

import hashlib
import lzma
import struct
import tarfile
import time
import zipfile
import zlib

import numpy as np
import pyarrow as pa
import pytest

from granary import errors
from granary.codecs import aes, filters, general, inflate64, lzh, zipcrypto
from granary.formats import open_archive
from granary.formats.streams import StreamReader, lz4_block
from granary.limits import Budget, Context, Limits
from granary.plans import authoring as write
from granary.plans import coded

MEMBERS = [("a/one.txt", b"hello " * 300), ("b.bin", bytes(range(256)) * 5), ("empty", b""), ("é.txt", "naïve".encode())]
ARCHIVES = {
    **{f"zip-{m}": ("zip", write.zip_archive(MEMBERS, m)) for m in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED, zipfile.ZIP_BZIP2, zipfile.ZIP_LZMA)},
    **{f"cpio-{x}": ("cpio", write.cpio_archive(MEMBERS, x)) for x in ("newc", "crc", "odc", "binary_le", "binary_be")},
    **{f"rpm-{p}": ("rpm", write.rpm_archive("pkg", MEMBERS, p)) for p in write.PACKERS},
    **{f"deb-{p}": ("deb", write.deb_archive(MEMBERS, p)) for p in write.PACKERS},
    "arj": ("arj", write.arj_archive(MEMBERS)),
    **{f"7z-{m}-{s}-{e}": ("7z", write.sevenzip_archive(MEMBERS, m, s, e)) for m in ("copy", "lzma2") for s in (0, 1) for e in (0, 1)},
}


ARCHIVES |= {f"7z-{name}": ("7z", write.sevenzip_archive([(n, coded.CODE + d if d else d) for n, d in MEMBERS], pack)) for name, pack in coded.SEVENZIP.items()}


@pytest.mark.parametrize("name", [n for n in ARCHIVES if n[3:] not in coded.SEVENZIP])
def test_round_trip(name):
    format, data = ARCHIVES[name]
    a = open_archive(data, format)
    got = {a.entries[i]["name"]: b for i, b in a.members() if a.entries[i].get("section") != "control"}
    assert got == dict(MEMBERS)
    assert all(a.read(e["idx"]) == b for e in a.entries for n, b in MEMBERS if e["name"] == n and e.get("section") != "control")
    assert [e["idx"] for e in a.entries] == list(range(len(a.entries)))


@pytest.mark.parametrize("name", coded.SEVENZIP)
def test_7z_coders(name):
    a = open_archive(ARCHIVES[f"7z-{name}"][1], "7z")
    assert {a.entries[i]["name"]: b for i, b in a.members()} == {n: coded.CODE + d if d else d for n, d in MEMBERS}


@pytest.mark.parametrize("name", list(filters._NATIVE))
def test_branch_filters_have_work(name):
    middle = lzma.decompress(coded.SEVENZIP[name](coded.CODE)[0], lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA2, "preset": 0}])
    assert middle != coded.CODE and filters.branch(name, middle) == coded.CODE


@pytest.mark.parametrize("write_zip", [coded.zip_traditional, coded.zip_aes])
def test_encrypted_zip(write_zip):
    data = write_zip(MEMBERS, b"pw")
    a = open_archive(data, "zip", Context(password="pw"))
    assert {a.entries[i]["name"]: b for i, b in a.members()} == dict(MEMBERS)
    with pytest.raises(errors.PasswordRequiredError):
        open_archive(data, "zip").verify()
    with pytest.raises(errors.WrongPasswordOrCorruptError):
        open_archive(data, "zip", Context(password="pv")).verify()


@pytest.mark.parametrize("name", ARCHIVES)
def test_every_cut_is_a_typed_error(name):
    format, data = ARCHIVES[name]
    for n in range(0, len(data), max(1, len(data) // 150)):
        with pytest.raises(errors.ArchiveError):
            open_archive(data[:n], format).verify()


@pytest.mark.parametrize("name", ARCHIVES)
def test_damage_gives_typed_errors_or_the_same_bytes(name):
    format, data = ARCHIVES[name]
    for n in range(0, len(data), max(1, len(data) // 150)):
        try:
            list(open_archive(data[:n] + bytes([data[n] ^ 0x55]) + data[n + 1 :], format).members())
        except errors.ArchiveError as e:
            assert e.kind in ("format", "checksum", "unsupported_method", "unsupported_feature", "limit_exceeded", "password_required", "wrong_password_or_corrupt")


@pytest.mark.parametrize("name", ["zip-8", "cpio-newc", "rpm-xz", "deb-gzip", "arj", "7z-lzma2-1-1"])
def test_limits_and_budget(name):
    format, data = ARCHIVES[name]
    for limits in (Limits(max_files=2), Limits(max_entry_output_bytes=100), Limits(max_total_output_bytes=1000), Limits(max_total_input_bytes=len(data) - 1)):
        with pytest.raises(errors.LimitExceededError) as e:
            open_archive(data, format, Context(limits)).verify()
        assert e.value.requested > e.value.maximum
    with pytest.raises(errors.LimitExceededError):
        open_archive(data, format, Context(budget=Budget(3))).verify()
    stopped = Budget()
    stopped.cancel()
    with pytest.raises(errors.CancelledError):
        open_archive(data, format, Context(budget=stopped)).verify()


def test_zip_rules():
    data = ARCHIVES["zip-8"][1]
    with pytest.raises(errors.FormatError):
        open_archive(data + b"x", "zip")
    shifted = open_archive(b"#!program" + data, "zip")  # a program before the archive
    assert [b for _, b in shifted.members()] == [b for _, b in MEMBERS]
    e = shifted.entries[0]
    assert (e["modified"]["year"], e["unix_mode"], e["is_safe_path"]) == (2020, 0o600, True)
    spot = data.index(b"PK\3\4") + 8
    with pytest.raises(errors.FormatError):
        open_archive(data[:spot] + b"\x0c" + data[spot + 1 :], "zip")  # local method differs


def test_zip64_and_descriptors():
    import io

    class Pipe(io.RawIOBase):
        def __init__(self):
            self.b = b""

        def writable(self):
            return True

        def write(self, x):
            self.b += bytes(x)
            return len(x)

    pipe = Pipe()
    with zipfile.ZipFile(pipe, "w", zipfile.ZIP_DEFLATED) as z:
        for n, b in MEMBERS:
            with z.open(zipfile.ZipInfo(n, (2020, 1, 1, 0, 0, 0)), "w", force_zip64=True) as f:
                f.write(b)
    assert dict((n, b) for (n, _), (_, b) in zip(MEMBERS, open_archive(pipe.b, "zip").members())) == dict(MEMBERS)


def _encrypt_zipcrypto(data, password, crc):
    t = zipcrypto._crc_table()
    k = [0x12345678, 0x23456789, 0x34567890]

    def up(p):
        k[0] = k[0] >> 8 ^ t[(k[0] ^ p) & 255]
        k[1] = ((k[1] + (k[0] & 255)) * 134775813 + 1) & 0xFFFFFFFF
        k[2] = k[2] >> 8 ^ t[(k[2] ^ k[1] >> 24) & 255]

    for p in password:
        up(p)
    out = b""
    for p in bytes(11) + bytes([crc >> 24]) + data:
        x = k[2] | 2
        out += bytes([p ^ (x * (x ^ 1) >> 8) & 255])
        up(p)
    return out


def test_zipcrypto_round_trip():
    data = b"secret text " * 20
    raw = _encrypt_zipcrypto(data, b"pw", zlib.crc32(data))
    assert zipcrypto.zipcrypto(raw, b"pw", zlib.crc32(data) >> 24) == data
    with pytest.raises(errors.WrongPasswordOrCorruptError):
        zipcrypto.zipcrypto(raw, b"pv", zlib.crc32(data) >> 24)


def test_winzip_aes_round_trip():
    import hmac

    for bits in (128, 192, 256):
        salt = bytes(range(bits // 16))
        key, auth, check = aes.keys_winzip(b"pw", salt, bits)
        body = aes.ctr(b"secret text " * 9, key)
        raw = salt + check + body + hmac.new(auth, body, hashlib.sha1).digest()[:10]
        assert zipcrypto.winzip_aes(raw, b"pw", bits) == b"secret text " * 9
        with pytest.raises(errors.WrongPasswordOrCorruptError):
            zipcrypto.winzip_aes(raw[:-1] + b"x", b"pw", bits)


def test_aes_published_vectors():
    plain = np.frombuffer(bytes.fromhex("00112233445566778899aabbccddeeff"), np.uint8).reshape(1, 16)
    for n, want in ((16, "69c4e0d86a7b0430d8cdb78070b4c55a"), (24, "dda97ca4864cdfe06eaf70a0ec0d7191"), (32, "8ea2b7ca516745bfeafc49904b496089")):
        keys = aes.round_keys(bytes(range(n)))
        out = aes.encrypt(plain, keys)
        assert out.tobytes().hex() == want and (aes.decrypt(out, keys) == plain).all()


@pytest.mark.parametrize("native", [True, False])
def test_cbc_published_vectors(native, monkeypatch):
    """NIST SP 800-38A, F.2.1, F.2.3 and F.2.5; long data is the same in both ways and comes back."""
    if not native:
        monkeypatch.setattr(aes, "_openssl", lambda: None)
    plain = bytes.fromhex("6bc1bee22e409f96e93d7e117393172aae2d8a571e03ac9c9eb76fac45af8e51")
    for key, want in (
        ("2b7e151628aed2a6abf7158809cf4f3c", "7649abac8119b246cee98e9b12e9197d5086cb9b507219ee95db113a917678b2"),
        ("8e73b0f7da0e6452c810f32b809079e562f8ead2522c6b7b", "4f021db243bc633d7178183a9fa071e8b4d9ada9ad7dedf4e5e738763f69145a"),
        ("603deb1015ca71be2b73aef0857d77811f352c073b6108d72d9810a30914dff4", "f58c4c04d6e5f1ba779eabfb5f7bfbd69cfc4e967edb808d679f777bc6702c7d"),
    ):
        assert aes.cbc_encrypt(plain, bytes.fromhex(key), bytes(range(16))).hex() == want
    long, key = np.random.default_rng(1).bytes(1 << 16), bytes(range(32))
    sealed = aes.cbc_encrypt(long, key, bytes(16))
    assert sealed == aes._cbc_words(long, key, bytes(16)) and aes.cbc_decrypt(sealed, key, bytes(16)) == long
    assert aes.cbc_encrypt(b"", key, bytes(16)) == b""
    with pytest.raises(ValueError):
        aes.cbc_encrypt(b"short", key, bytes(16))


@pytest.mark.parametrize("native", [True, False])
def test_7z_aes_is_sealed_in_time(native, monkeypatch):
    """A folder of 400 KB that no packer makes smaller: 25,000 blocks, of which each took 0.7 ms as an array of its own."""
    if not native:
        monkeypatch.setattr(aes, "_openssl", lambda: None)
    members = [("a", np.random.default_rng(2).bytes(400_000)), ("empty", b""), ("b", b"text " * 99)]
    began = time.process_time()
    data = write.sevenzip_archive(members, coded._aes_7z("pw"))
    assert time.process_time() - began < 8
    a = open_archive(data, "7z", Context(password="pw"))
    assert {a.entries[i]["name"]: b for i, b in a.members()} == dict(members)
    with pytest.raises(errors.WrongPasswordOrCorruptError):
        open_archive(data, "7z", Context(password="pv")).verify()


def test_7z_key_is_the_definition():
    h = hashlib.sha256()
    for i in range(1 << 6):
        h.update(b"salt" + "pä".encode("utf-16-le") + struct.pack("<Q", i))
    assert aes.key_7z("pä", b"salt", 6) == h.digest()
    assert aes.key_7z("p", b"s", 63) == b"sp\0".ljust(32, b"\0")


@pytest.mark.parametrize("name", list(filters._NATIVE))
def test_branch_filters(name):
    code = bytes((i * 7 + (0xE8 if i % 5 == 0 else i)) & 255 for i in range(5000))
    coded = lzma.compress(code, lzma.FORMAT_RAW, filters=[{"id": filters._NATIVE[name]}, {"id": lzma.FILTER_LZMA2, "preset": 0}])
    middle = lzma.decompress(coded, lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA2, "preset": 0}])
    assert filters.branch(name, middle) == code


def test_arm64_undoes_the_encoder():
    words = np.array([0x94000010, 0x97FFFFF0, 0x90000021, 0xD503201F, 0xB0000000], "<u4")
    pc = np.arange(0, 20, 4, dtype=np.int64)
    enc = words.astype(np.int64).copy()
    for i in (0, 1):
        enc[i] = 0x94000000 | (words[i] + (pc[i] >> 2)) & 0x03FFFFFF
    assert filters.arm64(enc.astype("<u4").tobytes() + b"abc") == words.tobytes() + b"abc"


def test_arm64_is_liblzmas():
    """liblzma's own filter, reached through an .xz stream of one stored chunk (Python's filter chains don't know it)."""
    rng = np.random.default_rng(3)
    data = rng.integers(0, 256, 4000, dtype=np.uint8)
    data[3::4] = rng.choice(np.array([0x94, 0x97, 0x90, 0xB0, 0xD0, 0xF0, 0x11], np.uint8), 1000)
    sealed = lambda x: x + struct.pack("<I", zlib.crc32(x))
    chunk = b"\x01" + struct.pack(">H", len(data) - 1) + data.tobytes() + b"\0"
    head = b"\xfd7zXZ\0" + sealed(b"\0\x01") + sealed(b"\x02\x01\x0a\0\x21\x01\x10\0")
    try:
        want = lzma.LZMADecompressor(lzma.FORMAT_XZ).decompress(head + chunk)
    except lzma.LZMAError:
        pytest.skip("liblzma before 5.4")
    got = filters.arm64(data.tobytes())
    assert len(want) > 3900 and got[: len(want)] == want and got != data.tobytes()


def test_delta_and_swap():
    data = bytes(range(200)) * 3
    x = np.frombuffer(data, np.uint8)
    for d in (1, 3, 7):
        y = x.copy()
        y[d:] -= x[:-d]
        assert filters.delta(y.tobytes(), bytes([d - 1])) == data
    assert filters.swap(b"abcdefg", 2) == b"badcfeg" and filters.swap(b"abcdefg", 4) == b"dcbaefg"


def test_inflate64_of_plain_deflate():
    """Deflate whose matches are short and near means the same in both formats."""
    for data in (b"", b"abc", bytes(range(256)) + bytes(range(200)), b"abcabcabc" * 9):
        for level in (0, 6):
            c = zlib.compressobj(level, zlib.DEFLATED, -15)
            raw = c.compress(data) + c.flush()
            assert inflate64.inflate64(raw, len(data), Context()) == data
            with pytest.raises(errors.FormatError):
                inflate64.inflate64(raw + b"x", len(data), Context())


class _Writer:
    def __init__(self):
        self.bits = ""

    def put(self, v, n):
        self.bits += f"{v:0{n}b}" if n else ""

    def done(self):
        return int(self.bits.ljust(-(-len(self.bits) // 8) * 8, "0") or "0", 2).to_bytes(-(-len(self.bits) // 8), "big")


def test_arj_fastest_and_huffman():
    w = _Writer()
    for c in b"abc":
        w.put(0, 1)
        w.put(c, 8)
    w.put(0b1, 1), w.put(0b10, 2), w.put(0b11, 2)  # a number of width 2: 3 + 3 = 6
    w.put(0, 1), w.put(2, 9)  # distance 3
    assert lzh.fastest(w.done(), 3 + 8, Context()) == b"abcabcabcab"
    for size in (1, 6):
        with pytest.raises(errors.ArchiveError):
            lzh.fastest(b"\xff" * 3, size, Context())
    # a block of Huffman codes. Code lengths: 2 (a long run) has the code 0, 0 (none) 10, 3 (a length of 1) 11
    def block(data, matches=False):
        w = _Writer()
        w.put(len(data), 16)
        w.put(4, 5)
        w.put(2, 3), w.put(0, 3), w.put(1, 3), w.put(0, 2), w.put(2, 3)
        w.put(99, 9)
        w.bits += "0" + f"{97 - 20:09b}" + "11" + "11"  # 97 without a code, then a and b with one bit each
        w.put(0, 5), w.put(0, 5)
        w.bits += "".join(str(x - 97) for x in data)
        return w

    w = block(b"abba")
    w.bits += block(b"bab").bits
    assert lzh.huffman(w.done(), 7, Context()) == b"abbabab"
    with pytest.raises(errors.ArchiveError):
        lzh.huffman(w.done()[:-3], 7, Context())


def test_streams():
    text = b"".join(b for _, b in MEMBERS) * 4
    for bits in (9, 12, 16):
        z = write.z_stream(text, bits)
        s = StreamReader(z)
        assert s.read() == text and s.info["maximum_code_bits"] == bits
    frame = pa.compress(text, "zstd", asbytes=True)
    s = StreamReader(b"\x50\x2a\x4d\x18\3\0\0\0abc" + frame * 2)
    assert s.read() == text * 2 and (s.info["frame_count"], s.info["skippable_frame_count"], s.frames) == (2, 1, 2)
    for bad in (frame[:-1], frame + b"x", frame[:10] + b"\xff" + frame[11:]):
        with pytest.raises(errors.ArchiveError):
            StreamReader(bad).read()
    block = b"\x54hello\x01\x00" + b"\x50world"
    assert lz4_block(block, 100) == b"hello" + b"oooooooo" + b"world"
    legacy = b"\x02\x21\x4c\x18" + struct.pack("<I", len(block)) + block
    s = StreamReader(legacy)
    assert s.read() == b"helloooooooooworld" and s.info["legacy_frame_count"] == 1
    with pytest.raises(errors.FormatError):
        StreamReader(b"not a stream")


def test_tar_layouts():
    from granary.formats import tar

    long = "d/" * 90 + "x" * 120
    for format in (tarfile.USTAR_FORMAT, tarfile.GNU_FORMAT, tarfile.PAX_FORMAT):
        name = long if format != tarfile.USTAR_FORMAT else "d/" * 60 + "x" * 60
        rows = tar.entries(write.tar_archive([(name, b"abc"), ("b", b"")], format), Context(), "data", 3)
        assert [(r["name"], r["size"], r["idx"], r["modified_time"]) for r, _ in rows] == [(name, 3, 3, write.TIME), ("b", 0, 4, write.TIME)]
    image = bytearray(write.tar_archive([("a", b"abc")], tarfile.GNU_FORMAT))
    image[0] ^= 1
    with pytest.raises(errors.ChecksumError):
        tar.entries(bytes(image), Context(), "data", 0)


def test_7z_model():
    a = open_archive(write.sevenzip_archive(MEMBERS, "lzma2", True, True), "7z")
    assert [e["kind"] for e in a.entries] == ["file"] * 4 and a.entries[3]["is_empty_file"] and a.entries[3]["crc32"] is None
    assert a.folders()[0]["coders"][0]["method"] == "lzma2" and a.folders()[0]["substreams"] == 3
    assert open_archive(b"MZ stub" + write.sevenzip_archive(MEMBERS), "7z").archive["sfx_offset"] == 7
    with pytest.raises(errors.UnsupportedFeatureError):
        open_archive(b"7z\xbc\xaf\x27\x1c\1\0" + bytes(24), "7z")


def test_xz_checks_and_general_ends():
    data = b"data " * 500
    for check in (lzma.CHECK_NONE, lzma.CHECK_CRC32, lzma.CHECK_CRC64, lzma.CHECK_SHA256):
        raw = lzma.compress(data, check=check)
        assert general.xz(raw + bytes(4), len(data), Context()) == data
        for bad in (raw + b"\0", raw[:-4], raw + raw):
            with pytest.raises(errors.FormatError):
                general.xz(bad, len(data), Context())
    with pytest.raises(errors.LimitExceededError):
        general.bzip2(write.PACKERS["bzip2"](data), None, Context(Limits(max_dictionary_bytes=1000)))


def test_errors_pickle():
    import pickle

    e = pickle.loads(pickle.dumps(errors.checksum("member", 3)))
    assert (e.kind, e.scope, e.member_index) == ("checksum", "member", 3)
