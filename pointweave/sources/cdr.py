"""Cloud messages in CDR: little-endian writing, reading in either byte order, alignment from behind the 4-byte header."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field, replace

import numpy as np

from pointweave.functions import binary, clouds
from pointweave.model import Compression, Encoding, FieldType, Header, PointField

#: The text in a compressed message's format field. Other names can be given.
FORMAT = "pointweave"


@dataclass(frozen=True)
class Cloud:
    stamp_sec: int = 0
    stamp_nsec: int = 0
    frame_id: str = ""
    height: int = 1
    width: int = 0
    fields: tuple[PointField, ...] = ()
    is_bigendian: bool = False
    point_step: int = 0
    row_step: int = 0
    data: bytes = b""
    is_dense: bool = True
    format: str | None = None
    cdr_header: bytes = field(default=b"\0\1\0\0", compare=False)


class Reader:
    """XCDR1, and XCDR2 where 8-byte values are aligned to 4 bytes."""

    def __init__(self, raw: bytes):
        if len(raw) < 4:
            raise binary.Broken("a message without its header")
        self.raw, self.at, self.header = raw, 4, raw[:4]
        self.order = "<" if raw[1] & 1 else ">"
        self.most = 4 if raw[1] >= 6 else 8

    def number(self, code: str):
        size = struct.calcsize(code)
        step = min(size, self.most)
        self.at += -(self.at - 4) % step
        if self.at + size > len(self.raw):
            raise binary.Broken("a message is cut off")
        value = struct.unpack_from(self.order + code, self.raw, self.at)[0]
        self.at += size
        return value

    def bytes_of(self, n: int) -> bytes:
        if self.at + n > len(self.raw):
            raise binary.Broken("a message is cut off")
        self.at += n
        return self.raw[self.at - n : self.at]

    def text(self) -> str:
        return self.bytes_of(self.number("I")).rstrip(b"\0").decode()


class Writer:
    def __init__(self, header: bytes = b"\0\1\0\0"):
        self.out = bytearray(header)

    def number(self, code: str, value) -> None:
        size = struct.calcsize(code)
        self.out += b"\0" * (-(len(self.out) - 4) % size) + struct.pack("<" + code, value)

    def text(self, value: str) -> None:
        raw = value.encode() + b"\0"
        self.number("I", len(raw))
        self.out += raw

    def block(self, value: bytes) -> None:
        self.number("I", len(value))
        self.out += value


def decode(raw: bytes, compressed: bool = False) -> Cloud:
    r = Reader(raw)
    sec, nsec, frame = r.number("i"), r.number("I"), r.text()
    height, width, fields = r.number("I"), r.number("I"), []
    for _ in range(r.number("I")):
        name, offset, kind = r.text(), r.number("I"), r.number("B")
        r.number("I")
        fields.append(PointField(name, offset, FieldType(kind)))
    big, step, row = bool(r.number("B")), r.number("I"), r.number("I")
    data, dense = r.bytes_of(r.number("I")), bool(r.number("B"))
    return Cloud(sec, nsec, frame, height, width, tuple(fields), big, step, row, data, dense, r.text() if compressed else None, r.header)


def encode(cloud: Cloud) -> bytes:
    """Written little-endian, each field once, the row's size anew."""
    w = Writer()
    w.number("i", cloud.stamp_sec)
    w.number("I", cloud.stamp_nsec)
    w.text(cloud.frame_id)
    w.number("I", cloud.height)
    w.number("I", cloud.width)
    w.number("I", len(cloud.fields))
    for f in cloud.fields:
        w.text(f.name)
        w.number("I", f.offset)
        w.number("B", f.type)
        w.number("I", 1)
    w.number("B", False)
    w.number("I", cloud.point_step)
    w.number("I", cloud.point_step * cloud.width & 0xFFFFFFFF)
    w.block(cloud.data)
    w.number("B", cloud.is_dense)
    if cloud.format is not None:
        w.text(cloud.format)
    return bytes(w.out)


def header_of(cloud: Cloud) -> Header:
    """Default options: lossy, ZSTD, the fields as they are."""
    return Header(cloud.fields, cloud.width, cloud.height, cloud.point_step, Encoding.LOSSY, Compression.ZSTD)


def is_whole(cloud: Cloud) -> bool:
    """Whether the data's size is what the dimensions say."""
    return len(cloud.data) == cloud.width * cloud.height * cloud.point_step


def to_compressed(raw: bytes, header: Header | None = None, *, format: str = FORMAT, magic: bytes = binary.MAGIC, visual: bool = False) -> bytes:
    """A cloud message to a compressed one. The data's size counts, not the dimensions, if they differ. visual: with a point a
    voxel, as ``clouds.visual``."""
    cloud = decode(raw)
    header = header_of(cloud) if header is None else header
    if not cloud.data:
        return encode(replace(cloud, data=b"", format=format))
    if cloud.point_step == 0:
        raise ValueError("point_step is 0")
    n = len(cloud.data) // cloud.point_step
    if not is_whole(cloud):
        header = replace(header, width=n, height=1)
    data = cloud.data[: n * cloud.point_step]
    if visual:
        header, points = clouds.visual(header, binary.points_of(header, data))
        if not header.points:
            return encode(replace(cloud, data=b"", format=format, fields=header.fields, width=0, height=1))
        data, cloud = np.ascontiguousarray(points), replace(cloud, width=header.width, height=header.height)
    blob = binary.encode_blob(header, data, magic=magic)
    return encode(replace(cloud, data=blob, format=format, fields=header.fields))


def from_compressed(raw: bytes, *, format: str | None = FORMAT, magic: bytes | None = None) -> bytes:
    """A compressed message to a cloud message; bytes that no field covers are zero."""
    cloud = decode(raw, compressed=True)
    if format is not None and cloud.format != format:
        raise ValueError(f"format {cloud.format!r} isn't {format!r}")
    if not cloud.data:
        return encode(replace(cloud, format=None))
    header, points = binary.decode_blob(cloud.data, magic=magic)
    return encode(replace(cloud, data=points.tobytes(), format=None, width=header.width, height=header.height))
