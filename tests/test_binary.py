import struct

import numpy as np
import pytest

from pointweave.functions import binary as B
from pointweave.model import Compression, Encoding, FieldType, Header, PointField, packed_fields, size_of

F32, F64 = FieldType.FLOAT32, FieldType.FLOAT64


def made(columns, encoding=Encoding.LOSSY, compression=Compression.NONE, version=5, **values):
    fields, step = packed_fields(columns)
    n = len(next(iter(values.values())))
    header = Header(fields, n, 1, step, encoding, compression, "", version)
    points = np.zeros(n, header.dtype())
    for k, v in values.items():
        points[k] = v
    return header, points


def plain_varint(d):
    n, out = ((d << 1) ^ (d >> 63)) + 1 & (1 << 64) - 1, bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def test_varints():
    rng = np.random.default_rng(1)
    d = np.concatenate([np.arange(-20000, 20000), rng.integers(-(2**62), 2**62, 5000), [2**63 - 1, -(2**63) + 1, 0]])
    raw = B.used(*B.varints(d))
    assert raw == b"".join(plain_varint(int(x)) for x in d)
    z, n = B.read_uvarints(np.frombuffer(raw, np.uint8), len(d))
    assert n == len(raw) and np.array_equal(B.signed(z), d)
    for cut in range(9):
        with pytest.raises(B.Broken):
            B.read_uvarints(np.frombuffer(plain_varint(2**62)[:cut], np.uint8), 1)
    for bad in (b"\xff" * 10, b"\x80" * 11 + b"\0", b"\xff" * 9 + b"\x02"):
        with pytest.raises(B.Broken):
            B.read_uvarints(np.frombuffer(bad, np.uint8), 1)


@pytest.mark.parametrize(("values", "dtype", "mode"), [
    (lambda i: 100000 + 3 * i, "<u4", "delta_rle"),
    (lambda i: i % 4, "<u4", "palette"),
    (lambda i: i // 256 % 8, "<u2", "rle"),
    (lambda i: np.cumsum(np.where(i // 64 % 2 == 0, 3, 7)), "<u4", "delta_rle"),
    (lambda i: 200000 - 5 * i, "<i4", "delta_rle"),
])
def test_modes(values, dtype, mode):
    i = np.arange(32768 + 19)
    v = values(i).astype(dtype)
    assert B.choose_mode(v[:4096]) == mode
    kind = {"<u4": FieldType.UINT32, "<u2": FieldType.UINT16, "<i4": FieldType.INT32}[dtype]
    header, points = made([("value", kind, None)], value=v)
    raw = B.encode_blob(header, points)
    _, at = B.decode_header(raw)
    assert raw[at + 4] == ["delta_varint", "palette", "rle", "delta_rle"].index(mode)
    assert np.array_equal(B.decode_blob(raw)[1], points)


def test_random_is_not_runs():
    v = np.random.default_rng(12345).integers(0, 65536, 4096).astype("<u4")
    assert B.choose_mode(v) != "delta_rle"


@pytest.mark.parametrize("n", [1, 4095, 4096, 4097, 32768, 32775])
@pytest.mark.parametrize("dtype", ["<i2", "<u2", "<i4", "<u4", "<i8", "<u8"])
def test_sections(n, dtype):
    rng, info = np.random.default_rng(n), np.iinfo(dtype)
    for v in (rng.integers(0, 50, n), np.sort(rng.integers(0, 10000, n)), rng.integers(info.min, info.max, n, dtype=np.dtype(dtype).type, endpoint=True)):
        v = v.astype(dtype)
        v[0], v[-1] = info.min, info.max
        for mode in B.MODES:
            if mode == "palette" and len(np.unique(v)) > 0xFFFF:
                continue
            raw = B.section(v, mode)
            assert B.section_size(v, mode) == len(raw)
            got, size = B.read_section(raw + b"more", np.dtype(dtype), n)
            assert size == len(raw) and np.array_equal(got, v)


def test_ticks():
    v = np.array([0.5, 1.5, -0.5, -2.5, 0.49999997, np.nan, 8388609.0], np.float32)
    assert B.ticks(v, 1.0).tolist() == [1, 2, -1, -3, 0, 0, 8388609]
    assert B.lane_ticks(v[:5], 1.0).tolist() == [0, 2, 0, -2, 0]
    assert B.lane_ticks(np.array([3e9, -3e9, np.inf], np.float32), 1.0).tolist() == [-(2**31)] * 3
    assert B.ticks(np.array([0.49999999999999994]), 1.0).tolist() == [0]


def test_nan_bytes():
    header, points = made([("v", F32, 0.01)], v=[np.nan, 0.02, np.nan, 0.02])
    raw = B.encode_chunk(header, points, {})
    assert raw == b"\0" + plain_varint(2) + b"\0" + plain_varint(2)


@pytest.mark.parametrize("compression", list(Compression))
@pytest.mark.parametrize("floats", [1, 2, 3, 4, 5])
def test_lossy(floats, compression):
    rng, n = np.random.default_rng(floats), 32768 + (32768 + 77 if floats == 3 else 9)
    v = {f"f{k}": rng.uniform(-500, 500, n).astype(np.float32) for k in range(floats)}
    v["f0"][[0, 1, 15, 16, 32767, 32768, 32769]] = np.nan
    v["ring"] = (np.arange(n) % 64).astype("<u2")
    v["stamp"] = 1.7e9 + 1e-6 * np.arange(n)
    header, points = made([*[(f"f{k}", F32, 0.001) for k in range(floats)], ("ring", FieldType.UINT16, None), ("stamp", F64, None), ("flag", FieldType.UINT8, None)], compression=compression, flag=np.arange(n) % 7, **v)
    got_header, got = B.decode_blob(B.encode_blob(header, points))
    assert got_header == header
    for k in range(floats):
        assert np.array_equal(np.isnan(got[f"f{k}"]), np.isnan(points[f"f{k}"]))
        error = np.abs(got[f"f{k}"].astype(float) - points[f"f{k}"].astype(float))
        assert np.nanmax(error) <= 0.0005 * 1.2
    assert np.array_equal(got["ring"], points["ring"]) and np.array_equal(got["stamp"], points["stamp"]) and np.array_equal(got["flag"], points["flag"])


@pytest.mark.parametrize("version", [2, 3, 4, 5])
@pytest.mark.parametrize("encoding", list(Encoding))
def test_lossless(encoding, version):
    rng, n = np.random.default_rng(7), 32768 + 17 if version > 2 else 900
    odd = np.resize([0, 0, 0, 1, 1.0000001, 1, 1e-20, 1e20, np.inf, -np.inf, np.nan], n)
    columns = [("a", F32, None), ("b", F64, None), ("c", FieldType.INT16, None), ("d", FieldType.UINT64, None), ("e", FieldType.INT8, None), ("g", FieldType.INT64, None)]
    header, points = made(columns, encoding, Compression.ZSTD, version, a=odd, b=np.where(np.arange(n) % 3, rng.uniform(-1e6, 1e6, n), odd), c=rng.integers(-(2**15), 2**15, n), d=rng.integers(0, 2**64, n, dtype=np.uint64), e=rng.integers(-128, 128, n), g=rng.integers(-(2**63), 2**63, n))
    got = B.decode_blob(B.encode_blob(header, points))[1]
    assert got.tobytes() == points.tobytes()


@pytest.mark.parametrize("kind", [F32, F64])
def test_gorilla(kind):
    dtype = np.float32 if kind == F32 else np.float64
    v = np.array([0, 0, 0, 1, 1.0000001, 1, 1e-20, 1e20, np.inf, -np.inf, 3.14159, 3.14159, 3.25, 3.5], dtype)
    matrix, size = B.gorilla(v)
    raw, at, reader, out = B.used(matrix, size), 0, B.Gorilla(8 * v.dtype.itemsize), []
    while at < len(raw):
        value, at = reader.read(raw, at)
        out.append(value)
    assert out == B.as_bits(v).tolist()
    assert size[0] == v.dtype.itemsize and size[1] == 1 and raw[size[0]] == 0
    still = 1.7e9 + 1e-6 * np.arange(1024)
    if kind == F64:
        assert B.gorilla(still)[1].sum() < 8 * 1024


def test_versions_differ_only_with_integers():
    n = 4096 + 37
    v = {k: (np.arange(n) * 0.01 * (j + 1)).astype(np.float32) for j, k in enumerate("xyz")}
    header, points = made([(k, F32, 0.001) for k in "xyz"], **v)
    old = Header(header.fields, n, 1, header.point_step, Encoding.LOSSY, Compression.NONE, "", 4)
    a, b = B.encode_blob(header, points), B.encode_blob(old, points)
    assert a[B.decode_header(a)[1] :] == b[B.decode_header(b)[1] :] and a[:12] != b[:12]


@pytest.mark.parametrize("text", [True, False])
def test_headers(text):
    header = Header((PointField("x", 0, F32, 0.01), PointField("ring", 16, FieldType.UINT16)), 10, 20, 18, Encoding.LOSSY, Compression.LZ4)
    raw = B.encode_header(header, text=text)
    assert B.decode_header(raw + b"rest") == (header, len(raw))
    for cut in (0, 5, 12, len(raw) - 1):
        with pytest.raises((B.Broken, KeyError, ValueError)):
            B.decode_header(raw[:cut])
    with pytest.raises(B.Broken):
        B.decode_header(raw[:10] + b"06" + raw[12:])
    with pytest.raises(B.Broken):
        B.decode_header(raw, magic=b"0123456789")


def test_broken_blobs():
    header, points = made([("v", FieldType.UINT8, None)], v=[1])
    raw = B.encode_blob(header, points)
    for bad in (raw[:-1], raw + b"\x01\0\0\0x", raw[: B.decode_header(raw)[1]]):
        with pytest.raises(B.Broken):
            B.decode_blob(bad)
    with pytest.raises(ValueError, match="points"):
        B.encode_blob(header, np.zeros(2, header.dtype()))
    with pytest.raises(ValueError, match="whole"):
        B.points_of(Header(header.fields, 1, 1, 3), b"ab")
    for bad in (b"", b"\x09", b"\x01\x02\0ab", b"\x02\x01\0\0\0" + struct.pack("<H", 5) + b"\x09", b"\x03\x01\0\0\0\x02\x09"):
        with pytest.raises(B.Broken):
            B.read_section(bad, np.dtype("<u2"), 4)


def test_empty_cloud():
    header, points = made([("v", F32, 0.1)], v=[])
    assert len(B.decode_blob(B.encode_blob(header, points))[1]) == 0


def test_lz4_blocks():
    rng = np.random.default_rng(3)
    for raw in (b"", b"a", b"abc" * 5000, bytes(rng.integers(0, 4, 20000, dtype=np.uint8)), bytes(rng.integers(0, 256, 3000, dtype=np.uint8)), b"\0" * 100_000):
        packed = B.compress(raw, Compression.LZ4)
        assert B.lz4_block(packed, len(raw)) == raw


def test_fingerprint():
    assert B.fingerprint(b"") == 0xCBF29CE484222325 and B.fingerprint(b"a") == 0xAF63DC4C8601EC8C
    assert size_of(FieldType.UNKNOWN) == 0


class Halves(B.Fixed):
    """32-bit floats as 16-bit ones."""

    def encode(self, values, field):
        return B.fixed(values.astype("<f2"))

    def reader(self, field):
        def read(raw, at):
            if at + 2 > len(raw):
                raise B.Broken("points are cut off")
            return int.from_bytes(raw[at : at + 2], "little"), at + 2

        return read

    def decode(self, codes, field):
        return codes.astype("<u2").view("<f2").astype("<f4")


def test_registered_coder():
    fields, step = packed_fields([(n, FieldType.FLOAT32, 0.01) for n in "xyz"] + [("w", FieldType.FLOAT32, None), ("k", FieldType.INT32, None)])
    header = Header(fields, 100, 1, step, compression=Compression.NONE)
    points = np.zeros(100, header.dtype())
    for n in "xyzw":
        points[n] = np.arange(100) / 4
    points["k"] = np.arange(100)
    plain = B.encode_blob(header, points)
    B.register_coder("halves", Halves(), lambda h, f: f.name in ("y", "w"))
    try:
        blob = B.encode_blob(header, points)
        assert blob != plain and len(blob) < len(plain) + 200
        back = B.decode_blob(blob)[1]
        assert back["y"].tolist() == back["w"].tolist() == (np.arange(100) / 4).tolist() and back["k"].tolist() == list(range(100))
        with pytest.raises(B.Broken):
            B.decode_blob(blob[:-40])
    finally:
        B.unregister_coder("halves")
    assert B.encode_blob(header, points) == plain


@pytest.mark.parametrize("encoding", list(Encoding))
@pytest.mark.parametrize("version", [4, 5])
def test_fields_that_are_passed_over(encoding, version):
    kinds = [("x", FieldType.FLOAT32, 0.01), ("t", FieldType.FLOAT64, None), ("k", FieldType.INT32, None), ("b", FieldType.UINT8, None)]
    for some in (kinds, kinds[:1], kinds[2:3], kinds[1:2], kinds[3:]):
        fields, step = packed_fields(some)
        header = Header(fields, 50, 1, step, encoding, Compression.NONE, version=version)
        points = np.zeros(50, header.dtype())
        for f in fields:
            points[f.name] = np.arange(50)
        raw = B.encode_chunk(header, points, {})
        whole = B.decode_chunk(header, raw, 50)
        for f in fields:
            part = B.decode_chunk(header, raw, 50, {f.name})
            assert part[f.name].tolist() == whole[f.name].tolist()
            assert all(not part[o.name].any() for o in fields if o != f)
