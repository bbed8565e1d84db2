"""Bytes of encoded points, a chunk at a time, in NumPy. A chunk has at most 32768 points, so memory is bounded.

Coders of a point give a matrix of padded bytes and a length for each point; the points' bytes are the matrices' used parts,
side by side. Streams of numbers only, or of fixed widths only, are decoded as a whole; mixed ones value by value.
"""

from __future__ import annotations

import struct
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard

from pointweave.functions.text import from_yaml, to_yaml
from pointweave.model import DTYPE, Compression, Encoding, FieldType, Header, PointField, size_of
from pointweave.operators.adaptive import MODES, PROBE
from pointweave.operators.order import CHUNK
from pointweave.operators.sequence import inverse
from pointweave.plans.planner import drop_choice, max_size, register_choice, steps, transform

#: A blob begins with ten bytes of its format's name, and its version in two digits. Other names can be given.
MAGIC = b"POINTWEAVE"
U64 = np.uint64


class Broken(ValueError):
    """Bytes that no encoder writes."""


# numbers


def zigzag(d: np.ndarray) -> np.ndarray:
    d = d.astype(np.int64)
    return ((d << 1) ^ (d >> 63)).view(U64)


def unzigzag(z: np.ndarray) -> np.ndarray:
    return ((z >> U64(1)) ^ (U64(0) - (z & U64(1)))).view(np.int64)


def uvarints(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """LEB128: a matrix of ten bytes each, and how many are used."""
    out, left, size = np.zeros((len(n), 10), np.uint8), n.astype(U64, copy=True), np.ones(len(n), np.int64)
    for k in range(10):
        out[:, k] = (left & U64(0x7F)).astype(np.uint8)
        left >>= U64(7)
        more = left > 0
        out[more, k] |= 0x80
        size += more
    return out, size


def varints(d: np.ndarray, missing: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Signed numbers: zig-zag and one more; zero stands for a missing one."""
    z = zigzag(d) + U64(1)
    if missing is not None:
        z[missing] = 0
    return uvarints(z)


def used(matrix: np.ndarray, size: np.ndarray) -> bytes:
    return matrix[np.arange(matrix.shape[1]) < size[:, None]].tobytes()


def read_uvarints(raw: np.ndarray, count: int) -> tuple[np.ndarray, int]:
    """The first ``count`` numbers of the bytes, and how many bytes they take."""
    if not count:
        return np.zeros(0, U64), 0
    ends = np.flatnonzero(raw[: count * 10] < 0x80)[:count]
    if len(ends) < count:
        raise Broken("a number is cut off")
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = ends - starts + 1
    if size.max() > 10 or (size == 10).any() and raw[ends[size == 10]].max() > 1:
        raise Broken("a number is longer than 64 bits")
    out = np.zeros(count, U64)
    for k in range(int(size.max())):
        on = size > k
        out[on] |= (raw[starts[on] + k] & 0x7F).astype(U64) << U64(7 * k)
    return out, int(ends[-1]) + 1


def read_uvarint(raw: bytes, at: int) -> tuple[int, int]:
    """One number and where the next begins."""
    value = shift = 0
    while at < len(raw):
        value |= (raw[at] & 0x7F) << shift
        at += 1
        if raw[at - 1] < 0x80:
            if value >> 64:
                break
            return value, at
        shift += 7
        if shift > 63:
            break
    raise Broken("a number is cut off or longer than 64 bits")


def signed(z: np.ndarray) -> np.ndarray:
    """Numbers behind the one that is added; zero, where it isn't a missing value, is the least of all."""
    return unzigzag(z - U64(1))


def bits_of(distinct: int) -> int:
    return 0 if distinct <= 1 else (distinct - 1).bit_length()


def pack(indexes: np.ndarray, bits: int) -> bytes:
    """The low bits of each, one behind the other, the lowest first."""
    if not bits:
        return b""
    spread = (indexes[:, None].astype(U64) >> np.arange(bits, dtype=U64) & U64(1)).astype(np.uint8)
    return np.packbits(spread.ravel(), bitorder="little").tobytes()


def unpack(raw: bytes, bits: int, n: int) -> np.ndarray:
    if not bits:
        return np.zeros(n, np.int64)
    spread = np.unpackbits(np.frombuffer(raw, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return spread.astype(np.int64) @ (1 << np.arange(bits))


def deltas(q: np.ndarray, missing: np.ndarray) -> np.ndarray:
    """Differences that wrap around; a missing value counts as 0 for the next."""
    held = np.where(missing, 0, q).astype(np.int64).view(U64)
    return (held - np.concatenate([[U64(0)], held[:-1]])).view(np.int64)


def sums(d: np.ndarray, missing: np.ndarray) -> np.ndarray:
    """Running sums that begin anew behind a missing value."""
    total = np.cumsum(np.where(missing, 0, d).astype(np.int64).view(U64), dtype=U64)
    last = np.maximum.accumulate(np.where(missing, np.arange(len(d)), -1)) if len(d) else np.zeros(0, np.int64)
    return (total - np.where(last >= 0, total[last], U64(0))).view(np.int64)


# floats


def ticks(values: np.ndarray, resolution: float) -> np.ndarray:
    """Halves away from zero, as 64-bit integers; beyond 2^62 they stay there."""
    kind = "float" if values.dtype == np.float32 else "double"
    scaled = (values * values.dtype.type(inverse(resolution, kind))).astype(np.float64)
    with np.errstate(invalid="ignore"):
        whole = np.trunc(scaled)
        rounded = whole + np.copysign(np.abs(scaled - whole) >= 0.5, scaled)
    return np.clip(np.nan_to_num(rounded, nan=0, posinf=2.0**62, neginf=-(2.0**62)), -(2.0**62), 2.0**62).astype(np.int64)


def lane_ticks(values: np.ndarray, resolution: float) -> np.ndarray:
    """Halves to even, as 32-bit integers; out of range they are the least one."""
    rounded = np.rint(values.astype(np.float32) * np.float32(inverse(resolution, "float"))).astype(np.float64)
    fits = (rounded >= -(2.0**31)) & (rounded < 2.0**31)
    return np.where(fits, np.nan_to_num(rounded), -(2.0**31)).astype(np.int64)


def wrap32(d: np.ndarray) -> np.ndarray:
    return d.astype(np.int64).astype(np.uint32).view(np.int32).astype(np.int64)


def as_bits(values: np.ndarray) -> np.ndarray:
    return values.view(f"<u{values.dtype.itemsize}")


def xor_residuals(values: np.ndarray) -> np.ndarray:
    bits = as_bits(values)
    return bits ^ np.concatenate([np.zeros(1, bits.dtype), bits[:-1]])


def gorilla(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A matrix of bytes and their number for each value. Each value ends on a byte.

    The first is raw. Then a 0 bit for an equal value; else 1 and, if the changed bits lie within those that were written
    last, 0 and those places; or 1, the leading zeros (5 bits, 31 at most), the changed bits' number less one (6 bits), and
    the changed bits. Bits are filled from the lowest.
    """
    bits, width = as_bits(values).tolist(), 8 * values.dtype.itemsize
    out, size = np.zeros((len(bits), 11), np.uint8), np.zeros(len(bits), np.int64)
    lead = trail = prev = None
    for k, now in enumerate(bits):
        if prev is None:
            acc, n = now, width
        elif now == prev:
            acc, n = 0, 1
        else:
            changed = now ^ prev
            a, b = width - changed.bit_length(), (changed & -changed).bit_length() - 1
            if lead is not None and a >= lead and b >= trail:
                acc, n = 1 | changed >> trail << 2, 2 + width - lead - trail
            else:
                lead, trail = min(a, 31), b
                m = width - lead - trail
                acc, n = 3 | lead << 2 | (m - 1) << 7 | changed >> trail << 13, 13 + m
        prev = now
        length = -(-n // 8)
        out[k, :length] = np.frombuffer(acc.to_bytes(length, "little"), np.uint8)
        size[k] = length
    return out, size


class Gorilla:
    """Reads values one by one."""

    def __init__(self, width: int):
        self.width, self.prev, self.lead, self.trail = width, None, None, 0

    def read(self, raw: bytes, at: int) -> tuple[int, int]:
        """The value's bits and where the next one begins."""
        if self.prev is None:
            n, end = self.width, at + self.width // 8
            self.prev = int.from_bytes(raw[at:end], "little")
            if end > len(raw):
                raise Broken("a value is cut off")
            return self.prev, end
        window = int.from_bytes(raw[at : at + 11], "little")
        if not window & 1:
            n = 1
        elif not window & 2:
            if self.lead is None:
                raise Broken("a value refers to a window that isn't there")
            m = self.width - self.lead - self.trail
            self.prev ^= (window >> 2 & (1 << m) - 1) << self.trail
            n = 2 + m
        else:
            self.lead, m = window >> 2 & 31, (window >> 7 & 63) + 1
            self.trail = self.width - self.lead - m
            if self.trail < 0:
                raise Broken("a value is wider than its type")
            self.prev ^= (window >> 13 & (1 << m) - 1) << self.trail
            n = 13 + m
        end = at + -(-n // 8)
        if end > len(raw):
            raise Broken("a value is cut off")
        return self.prev, end


# adaptive sections of integers


def raw64(values: np.ndarray) -> np.ndarray:
    return values.astype(np.int64) if values.dtype != np.uint64 else values.view(np.int64)


def run_starts(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]])) if len(v) else np.zeros(0, np.int64)
    return starts, np.diff(np.append(starts, len(v)))


def first_seen(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in the order in which they first occur, and each value's place among them."""
    found, first, code = np.unique(v, return_index=True, return_inverse=True)
    order = np.argsort(first)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return found[order], place[code.ravel()]


def section(values: np.ndarray, mode: str) -> bytes:
    """The mode's number and its data."""
    v, none = raw64(values), np.zeros(len(values), bool)
    out = [bytes([MODES.index(mode)])]
    if mode == "delta_varint":
        out.append(used(*varints(deltas(v, none))))
    elif mode == "palette":
        found, code = first_seen(v)
        if len(found) > 0xFFFF:
            raise ValueError("a palette holds 65535 values at most")
        out += [struct.pack("<H", len(found)), found.astype(values.dtype).tobytes(), pack(code, bits_of(len(found)))]
    else:
        d = v if mode == "rle" else deltas(v, none)
        starts, lengths = run_starts(d)
        head = (np.frombuffer(d[starts].astype(values.dtype).tobytes(), np.uint8).reshape(len(starts), -1), np.full(len(starts), values.dtype.itemsize)) if mode == "rle" else varints(d[starts])
        out += [struct.pack("<I", len(starts)), interleave([head, uvarints(lengths)])]
    return b"".join(out)


def section_size(values: np.ndarray, mode: str) -> int:
    distinct = len(np.unique(values))
    if mode == "palette":
        return 3 + distinct * values.dtype.itemsize + -(-bits_of(distinct) * len(values) // 8) if distinct <= 0xFFFF else 1 << 62
    return len(section(values, mode))


def choose_mode(values: np.ndarray) -> str:
    sizes = [section_size(values, m) for m in MODES]
    return MODES[int(np.argmin(sizes))]


def read_section(raw: bytes, dtype: np.dtype, n: int) -> tuple[np.ndarray, int]:
    """The values, and how many bytes they take."""
    if not raw or raw[0] >= len(MODES):
        raise Broken("no such mode")
    mode, width, none = MODES[raw[0]], dtype.itemsize, np.zeros(n, bool)
    body = np.frombuffer(raw, np.uint8)
    if mode == "delta_varint":
        z, size = read_uvarints(body[1:], n)
        return narrowed(sums(signed(z), none), dtype), 1 + size
    if mode == "palette":
        if len(raw) < 3:
            raise Broken("a palette is cut off")
        count = struct.unpack_from("<H", raw, 1)[0]
        at, bits = 3 + count * width, bits_of(count)
        end = at + -(-bits * n // 8)
        if end > len(raw) or n and not count:
            raise Broken("a palette is cut off")
        code = unpack(raw[at:end], bits, n)
        if n and code.max() >= count:
            raise Broken("an index is beyond its palette")
        return np.frombuffer(raw[3:at], dtype)[code], end
    if len(raw) < 5:
        raise Broken("runs are cut off")
    count, at = struct.unpack_from("<I", raw, 1)[0], 5
    if mode == "delta_rle":
        z, size = read_uvarints(body[at:], 2 * count)
        heads, lengths = signed(z[::2]), z[1::2]
        at += size
    else:
        heads, lengths = np.zeros(count, dtype), np.zeros(count, U64)
        for k in range(count):
            if at + width >= len(raw):
                raise Broken("runs are cut off")
            heads[k] = np.frombuffer(raw, dtype, 1, at)[0]
            lengths[k], at = read_uvarint(raw, at + width)
    if count and lengths.max() > n or int(lengths.sum()) != n:
        raise Broken("runs don't make up the points")
    found = np.repeat(heads, lengths.astype(np.int64))
    return (found if mode == "rle" else narrowed(sums(found, none), dtype)), at


def narrowed(v: np.ndarray, dtype: np.dtype) -> np.ndarray:
    return v.view(np.uint64) if dtype == np.uint64 else v.astype(dtype)


# chunks


def interleave(parts: list[tuple[np.ndarray, np.ndarray]]) -> bytes:
    """Rows' used bytes of all parts, side by side."""
    matrix = np.concatenate([m for m, _ in parts], axis=1)
    mask = np.concatenate([np.arange(m.shape[1]) < s[:, None] for m, s in parts], axis=1)
    return matrix[mask].tobytes()


def fixed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    matrix = np.frombuffer(np.ascontiguousarray(values).tobytes(), np.uint8).reshape(len(values), -1)
    return matrix, np.full(len(values), matrix.shape[1])


class Coder:
    """One field's values of a chunk to bytes and back. Subclass it and ``register_coder`` it to add a way of coding."""

    def encode(self, values: np.ndarray, field: PointField) -> tuple[np.ndarray, np.ndarray]:
        """A matrix of padded bytes, a row for each value, and how many of them each value uses."""
        raise NotImplementedError

    def reader(self, field: PointField):
        """read(raw, at): the next value's code as an integer, and where the one behind it begins."""
        raise NotImplementedError

    def decode(self, codes: np.ndarray, field: PointField) -> np.ndarray:
        """All codes (uint64) to values."""
        raise NotImplementedError


class Numbers(Coder):
    def reader(self, field: PointField):
        return read_uvarint


class Ticks(Numbers):
    def __init__(self, lanes: bool = False):
        self.lanes = lanes

    def encode(self, values, field):
        missing = np.isnan(values)
        d = deltas((lane_ticks if self.lanes else ticks)(values, field.resolution), missing)
        return varints(wrap32(d) if self.lanes else d, missing)

    def decode(self, codes, field):
        missing = codes == 0
        q = sums(np.where(missing, 0, signed(codes)), missing)
        own = np.dtype(DTYPE[field.type]).type
        return np.where(missing, own(np.nan), (wrap32(q) if self.lanes else q).astype(own) * own(np.float32(field.resolution)))


class Deltas(Numbers):
    def encode(self, values, field):
        return varints(deltas(raw64(values), np.zeros(len(values), bool)))

    def decode(self, codes, field):
        return narrowed(sums(signed(codes), np.zeros(len(codes), bool)), np.dtype(DTYPE[field.type]))


class Fixed(Coder):
    def encode(self, values, field):
        return fixed(values)

    def reader(self, field: PointField):
        size = size_of(field.type)

        def read(raw: bytes, at: int) -> tuple[int, int]:
            if at + size > len(raw):
                raise Broken("points are cut off")
            return int.from_bytes(raw[at : at + size], "little"), at + size

        return read

    def decode(self, codes, field):
        return codes.astype(f"<u{size_of(field.type)}").view(DTYPE[field.type])


class Xor(Fixed):
    def encode(self, values, field):
        return fixed(xor_residuals(values))

    def decode(self, codes, field):
        held = codes.astype(f"<u{size_of(field.type)}")
        return (np.bitwise_xor.accumulate(held) if len(held) else held).view(DTYPE[field.type])


class GorillaCoder(Fixed):
    def encode(self, values, field):
        return gorilla(values)

    def reader(self, field: PointField):
        return Gorilla(8 * size_of(field.type)).read


#: By the kinds that ``planner.transform`` gives.
CODERS: dict[str, Coder] = {"lanes": Ticks(lanes=True), "ticks": Ticks(), "delta": Deltas(), "xor": Xor(), "gorilla": GorillaCoder(), "copy": Fixed()}


def register_coder(kind: str, coder: Coder, applies: Callable[[Header, PointField], bool]) -> None:
    """Have ``coder`` code the fields that ``applies`` to, in place of the built-in choice. Encoding and decoding must have the
    same coders registered; on a cluster register them in a module that the workers import."""
    CODERS[kind] = coder
    register_choice(kind, applies)


def unregister_coder(kind: str) -> None:
    CODERS.pop(kind)
    drop_choice(kind)


def coded(points: np.ndarray, kind: str, fields: tuple[PointField, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
    return [CODERS[kind].encode(np.ascontiguousarray(points[f.name]), f) for f in fields]


def encode_chunk(header: Header, points: np.ndarray, modes: dict[str, str]) -> bytes:
    """points: a structured array with the header's names. modes: of the fields with sections; filled by the first chunk."""
    plan = steps(header)
    regular = [part for kind, fields in plan if kind != "section" for part in coded(points, kind, fields)]
    out = [interleave(regular)] if regular else []
    for kind, (f, *_) in plan:
        if kind == "section":
            values = np.ascontiguousarray(points[f.name])
            if f.name not in modes:
                modes[f.name] = choose_mode(values[:PROBE])
            if modes[f.name] == "palette" and len(np.unique(values)) > 0xFFFF:
                raise ValueError(f"{f.name}: a palette holds 65535 values at most")
            out.append(section(values, modes[f.name]))
    return b"".join(out)


def decode_chunk(header: Header, raw: bytes, n: int, wanted: set[str] | None = None) -> np.ndarray:
    """n points as a structured array; bytes behind them, or none, are errors. Fields that aren't wanted are passed over: their
    bytes are read, but they aren't decoded further and stay zero."""
    out, at = np.zeros(n, header.dtype()), 0
    plan = [(k, f) for k, fs in decoding_steps(header) for f in fs]
    regular = [(k, f) for k, f in plan if k != "section"]
    keep = lambda f: wanted is None or f.name in wanted
    if regular and all(isinstance(CODERS[k], Numbers) for k, _ in regular):
        codes, at = read_uvarints(np.frombuffer(raw, np.uint8), n * len(regular))
        for c, (k, f) in enumerate(regular):
            if keep(f):
                out[f.name] = CODERS[k].decode(codes[c :: len(regular)], f)
    elif regular and all(type(CODERS[k]) in (Fixed, Xor) for k, _ in regular):
        layout = np.dtype([(f"f{c}", f"<u{size_of(f.type)}") for c, (_, f) in enumerate(regular)])
        at = n * layout.itemsize
        if at > len(raw):
            raise Broken("points are cut off")
        held = np.frombuffer(raw, layout, n)
        for c, (k, f) in enumerate(regular):
            if keep(f):
                out[f.name] = CODERS[k].decode(np.ascontiguousarray(held[f"f{c}"]), f)
    elif regular:
        at = decode_mixed(out, regular, raw, keep)
    for k, f in plan:
        if k == "section":
            values, size = read_section(raw[at:], np.dtype(DTYPE[f.type]), n)
            at += size
            if keep(f):
                out[f.name] = values
    if at != len(raw):
        raise Broken("bytes behind the last point")
    return out


def decoding_steps(header: Header) -> list[tuple[str, tuple[PointField, ...]]]:
    """As steps, but ticks of floats whose header has a resolution without being lossy."""
    return [(k if k in ("lanes", "section") else transform(header, fs[0], decoding=True), fs) for k, fs in steps(header)]


def decode_mixed(out: np.ndarray, regular: list[tuple[str, PointField]], raw: bytes, keep) -> int:
    """Codes one by one; what the wanted ones stand for, all at once."""
    at, readers = 0, [CODERS[k].reader(f) for k, f in regular]
    held: list[list[int]] = [[] for _ in regular]
    for _ in range(len(out)):
        for c, read in enumerate(readers):
            code, at = read(raw, at)
            held[c].append(code)
    for codes, (k, f) in zip(held, regular, strict=True):
        if keep(f):
            out[f.name] = CODERS[k].decode(np.array(codes, U64), f)
    return at


# compression, headers, blobs


def compress(raw: bytes, kind: Compression) -> bytes:
    if kind == Compression.LZ4:
        return pa.Codec("lz4_raw").compress(raw, asbytes=True)
    return zstandard.ZstdCompressor(level=1).compress(raw) if kind == Compression.ZSTD else raw


def decompress(raw: bytes, kind: Compression, bound: int) -> bytes:
    """bound: no encoder gives more."""
    try:
        if kind == Compression.LZ4:
            return lz4_block(raw, bound)
        if kind == Compression.ZSTD:
            out = zstandard.ZstdDecompressor().decompress(raw, max_output_size=bound)
            return out
    except zstandard.ZstdError as e:
        raise Broken(str(e)) from None
    return raw


def lz4_block(raw: bytes, bound: int) -> bytes:
    """An LZ4 block whose inflated size isn't known; by the public block format."""
    out, at, n = bytearray(), 0, len(raw)
    while at < n:
        token = raw[at]
        at += 1
        size = token >> 4
        if size == 15:
            while True:
                size += (more := raw[at])
                at += 1
                if more != 255:
                    break
        if at + size > n:
            raise Broken("literals are cut off")
        out += raw[at : at + size]
        at += size
        if at >= n:
            break
        back = int.from_bytes(raw[at : at + 2], "little")
        at += 2
        size = (token & 15) + 4
        if size == 19:
            while True:
                size += (more := raw[at])
                at += 1
                if more != 255:
                    break
        if not 0 < back <= len(out) or len(out) + size > bound:
            raise Broken("a match is out of place")
        start = len(out) - back
        if back >= size:
            out += out[start : start + size]
        else:
            out += (bytes(out[start:]) * (size // back + 1))[:size]
    return bytes(out)


def encode_header(header: Header, *, magic: bytes = MAGIC, text: bool = True, exact: bool = True) -> bytes:
    if len(magic) != 10:
        raise ValueError("a magic has ten bytes")
    start = magic + b"%02d" % header.version
    if text:
        return start + b"\n" + to_yaml(header, exact).encode() + b"\0"
    out = [start, struct.pack("<IIIBBH", header.width, header.height, header.point_step, header.encoding, header.compression, len(header.fields))]
    for f in header.fields:
        name = f.name.encode()
        out.append(struct.pack(f"<H{len(name)}sIBf", len(name), name, f.offset, f.type, -1.0 if f.resolution is None else f.resolution))
    return b"".join(out)


def decode_header(raw: bytes, *, magic: bytes | None = None) -> tuple[Header, int]:
    """The header and where the points begin. Any ten bytes are a magic unless one is given."""
    if len(raw) < 14 or not raw[10:12].isdigit() or magic is not None and raw[:10] != magic:
        raise Broken("no header")
    version = int(raw[10:12])
    if not 2 <= version <= 5:
        raise Broken(f"version {version} isn't known")
    if raw[12:21] == b"\nversion:":
        end = raw.find(b"\0", 13)
        if end < 0:
            raise Broken("a header without its end")
        return from_yaml(raw[13:end].decode(), version), end + 1
    try:
        width, height, step, encoding, compression, n = struct.unpack_from("<IIIBBH", raw, 12)
        at, fields = 28, []
        for _ in range(n):
            size = struct.unpack_from("<H", raw, at)[0]
            name, offset, kind, resolution = struct.unpack_from(f"<{size}sIBf", raw, at + 2)
            fields.append(PointField(name.decode(), offset, FieldType(kind), resolution if resolution > 0 else None))
            at += 2 + size + 9
    except struct.error:
        raise Broken("a header is cut off") from None
    return Header(tuple(fields), width, height, step, Encoding(encoding), Compression(compression), "", version), at


def points_of(header: Header, data: bytes) -> np.ndarray:
    if header.point_step == 0 or len(data) % header.point_step:
        raise ValueError("the data isn't whole points")
    return np.frombuffer(data, header.dtype())


def encode_blob(header: Header, data: bytes | np.ndarray, *, magic: bytes = MAGIC, text: bool = True, exact: bool = True) -> bytes:
    """A header and chunks, each behind its length (version 2: one chunk without)."""
    points = points_of(header, data) if isinstance(data, bytes) else data
    if len(points) != header.points:
        raise ValueError(f"{len(points)} points, the header has {header.points}")
    out, modes = [encode_header(header, magic=magic, text=text, exact=exact)], {}
    if header.version < 3:
        return out[0] + compress(encode_chunk(header, points, modes), header.compression)
    for at in range(0, len(points), CHUNK):
        chunk = compress(encode_chunk(header, points[at : at + CHUNK], modes), header.compression)
        out += [struct.pack("<I", len(chunk)), chunk]
    return b"".join(out)


def chunks_of(header: Header, raw: bytes, at: int) -> list[tuple[bytes, int]]:
    """Each chunk's bytes and points; they can be decoded apart."""
    if header.version < 3:
        return [(raw[at:], header.points)]
    out, left = [], header.points
    while at < len(raw):
        if left <= 0 or at + 4 > len(raw):
            raise Broken("more chunks than points")
        size = struct.unpack_from("<I", raw, at)[0]
        if at + 4 + size > len(raw):
            raise Broken("a chunk is cut off")
        out.append((raw[at + 4 : at + 4 + size], min(CHUNK, left)))
        at, left = at + 4 + size, left - CHUNK
    if left > 0:
        raise Broken("points are missing")
    return out


def open_chunk(header: Header, chunk: bytes, n: int, wanted: set[str] | None = None) -> np.ndarray:
    whole = Header(header.fields, n, 1, max(1, header.point_step), header.encoding, Compression.NONE, "", header.version)
    bound = max(max_size(whole, n), n * header.point_step) + 12 * n * len(header.fields) + 4096
    return decode_chunk(header, decompress(chunk, header.compression, bound), n, wanted)


def decode_blob(raw: bytes, *, magic: bytes | None = None) -> tuple[Header, np.ndarray]:
    header, at = decode_header(raw, magic=magic)
    parts = chunks_of(header, raw, at)
    out, at = np.zeros(sum(n for _, n in parts), header.dtype()), 0  # joining arrays would drop what no field covers
    for chunk, n in parts:
        out[at : at + n] = open_chunk(header, chunk, n)
        at += n
    return header, out


def fingerprint(raw: bytes, seed: int = 0xCBF29CE484222325) -> int:
    """FNV-1a of 64 bits, over the bytes in order."""
    for b in raw:
        seed = (seed ^ b) * 0x100000001B3 & (1 << 64) - 1
    return seed


