"""What becomes of each field, decided from the schema alone."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import replace

from pointweave.model import WIDE_INTS, Compression, Encoding, FieldType, Header, PointField
from pointweave.operators.order import CHUNK


#: Further ways to code a field, and the fields to which they apply; asked before the built-in choice.
CHOICES: dict[str, Callable[[Header, PointField], bool]] = {}


def register_choice(kind: str, applies: Callable[[Header, PointField], bool]) -> None:
    CHOICES[kind] = applies


def drop_choice(kind: str) -> None:
    CHOICES.pop(kind)


def chosen(header: Header, field: PointField) -> str | None:
    return next((kind for kind, applies in CHOICES.items() if applies(header, field)), None)


def leading_floats(header: Header) -> int:
    """How many lossy 32-bit floats stand first, if that is 3 or 4: those are coded together; else 0."""
    n = 0
    if header.encoding == Encoding.LOSSY:
        for f in header.fields:
            if f.type != FieldType.FLOAT32 or f.resolution is None or chosen(header, f):
                break
            n += 1
    return n if n in (3, 4) else 0


def is_adaptive(header: Header) -> bool:
    """Whether integer fields get sections of their own, in the mode that is smallest."""
    rest = header.fields[leading_floats(header) :]
    return header.version >= 5 and header.encoding == Encoding.LOSSY and any(f.type in WIDE_INTS and not chosen(header, f) for f in rest)


def transform(header: Header, field: PointField, decoding: bool = False) -> str:
    """copy, ticks, xor, gorilla or delta. Decoding a 32-bit float takes its ticks from its resolution unless lossless."""
    if own := chosen(header, field):
        return own
    if header.encoding == Encoding.NONE:
        return "copy"
    if field.type == FieldType.FLOAT32:
        if field.resolution is not None and (header.encoding == Encoding.LOSSY or decoding and header.encoding != Encoding.LOSSLESS):
            return "ticks"
        return "xor" if header.encoding == Encoding.LOSSLESS else "copy"
    if field.type == FieldType.FLOAT64:
        if field.resolution is not None and header.encoding == Encoding.LOSSY:
            return "ticks"
        return "gorilla" if field.resolution is None and header.version >= 4 else "xor"
    if field.type in WIDE_INTS:
        return "delta"
    if field.type in (FieldType.INT8, FieldType.UINT8):
        return "copy"
    raise ValueError(f"field {field.name} has no type")


def steps(header: Header) -> list[tuple[str, tuple[PointField, ...]]]:
    """The coders of a point, in order; ``section`` ones come behind all points of a chunk."""
    n, adaptive = leading_floats(header), is_adaptive(header)
    out = [("lanes", header.fields[:n])] if n else []
    for f in header.fields[n:]:
        section = adaptive and f.type in WIDE_INTS and not chosen(header, f)
        out.append(("section" if section else transform(header, f), (f,)))
    return out


def field_bound(field: PointField, encoding: Encoding) -> int:
    """The most bytes that a value takes before compression."""
    if field.type in WIDE_INTS:
        return 10
    if field.type in (FieldType.FLOAT32, FieldType.FLOAT64):
        if encoding == Encoding.LOSSY and field.resolution is not None:
            return 10
        return 7 if field.type == FieldType.FLOAT32 else 11
    if field.type in (FieldType.INT8, FieldType.UINT8):
        return 1
    raise ValueError(f"field {field.name} has no type")


def compressor_bound(n: int, compression: Compression) -> int:
    """The bounds that the compressors document."""
    if compression == Compression.ZSTD:
        return n + (n >> 8) + (((128 << 10) - n) >> 11 if n < 128 << 10 else 0)
    return n + n // 255 + 16 if compression == Compression.LZ4 else n


def max_size(header: Header, points: int, header_bytes: int = 0) -> int:
    """The most bytes that so many points take: per chunk a 4-byte length and the compressor's bound of its points and, if
    integers are adaptive, of 32 bytes a field and 1024 more."""
    if header.point_step == 0:
        raise ValueError("point_step is 0")
    per_point = sum(field_bound(f, header.encoding) for f in header.fields)
    slack = 32 * len(header.fields) + 1024 if is_adaptive(header) else 0
    whole, rest = divmod(points, CHUNK)
    chunk = lambda n: 4 + compressor_bound(n * per_point + slack, header.compression)
    return header_bytes + whole * chunk(CHUNK) + (chunk(rest) if rest else 0)


def apply_profile(header: Header, profile: dict[str, float], default: float | None = None) -> Header:
    """Fields at 0 go from the schema (not from the points' layout); named ones get their resolution, other 32-bit floats the
    default."""
    out = []
    for f in header.fields:
        resolution = profile.get(f.name, default if f.type == FieldType.FLOAT32 else f.resolution)
        if resolution != 0:
            out.append(replace(f, resolution=resolution))
    return replace(header, fields=tuple(out))


def geometry(header: Header) -> tuple[PointField, ...] | None:
    """x, y, z by structure: the first three fields, 32-bit floats side by side with one positive finite resolution."""
    first = header.fields[:3]
    if len(first) < 3 or any(f.type != FieldType.FLOAT32 or f.resolution is None for f in first):
        return None
    base, res = first[0].offset, first[0].resolution
    if any(f.offset != base + 4 * k or f.resolution != res for k, f in enumerate(first)):
        return None
    return first if res > 0 and math.isfinite(res) else None


def with_time_resolution(header: Header, resolution: float = 1e-6) -> Header:
    """64-bit floats without a resolution get one, if the header has a geometry and points."""
    if geometry(header) is None or header.points == 0:
        return header
    return replace(header, fields=tuple(replace(f, resolution=resolution) if f.type == FieldType.FLOAT64 and f.resolution is None else f for f in header.fields))
