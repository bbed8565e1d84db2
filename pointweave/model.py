"""Point fields and cloud headers."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from enum import IntEnum

import numpy as np


class FieldType(IntEnum):
    """The numbers on the wire."""

    UNKNOWN = 0
    INT8 = 1
    UINT8 = 2
    INT16 = 3
    UINT16 = 4
    INT32 = 5
    UINT32 = 6
    FLOAT32 = 7
    FLOAT64 = 8
    INT64 = 9
    UINT64 = 10


class Encoding(IntEnum):
    NONE = 0
    LOSSY = 1
    LOSSLESS = 2


class Compression(IntEnum):
    NONE = 0
    LZ4 = 1
    ZSTD = 2


DTYPE = {FieldType.INT8: "<i1", FieldType.UINT8: "<u1", FieldType.INT16: "<i2", FieldType.UINT16: "<u2", FieldType.INT32: "<i4", FieldType.UINT32: "<u4", FieldType.FLOAT32: "<f4", FieldType.FLOAT64: "<f8", FieldType.INT64: "<i8", FieldType.UINT64: "<u8"}
SPARK_TYPE = {FieldType.INT8: "tinyint", FieldType.UINT8: "smallint", FieldType.INT16: "smallint", FieldType.UINT16: "int", FieldType.INT32: "int", FieldType.UINT32: "bigint", FieldType.FLOAT32: "float", FieldType.FLOAT64: "double", FieldType.INT64: "bigint", FieldType.UINT64: "decimal(20,0)"}
FROM_SPARK = {"tinyint": FieldType.INT8, "smallint": FieldType.INT16, "int": FieldType.INT32, "bigint": FieldType.INT64, "float": FieldType.FLOAT32, "double": FieldType.FLOAT64, "decimal(20,0)": FieldType.UINT64}
#: Integers that get an adaptive section, and those that are coded as deltas.
WIDE_INTS = (FieldType.INT16, FieldType.UINT16, FieldType.INT32, FieldType.UINT32, FieldType.INT64, FieldType.UINT64)


def enum_of(kind: type[IntEnum], text: str | int) -> IntEnum:
    """A member by its name or its number as text; anything else raises ValueError."""
    text = str(text).strip()
    if text in kind.__members__:
        return kind[text]
    try:
        return kind(int(text))
    except ValueError:
        raise ValueError(f"no {kind.__name__}: {text!r}") from None


def size_of(kind: FieldType) -> int:
    return np.dtype(DTYPE[kind]).itemsize if kind in DTYPE else 0


@dataclass(frozen=True)
class PointField:
    name: str
    offset: int
    type: FieldType
    resolution: float | None = None

    def __post_init__(self):
        object.__setattr__(self, "type", FieldType(self.type))
        if self.resolution is not None:
            object.__setattr__(self, "resolution", float(np.float32(self.resolution)))


@dataclass(frozen=True)
class Header:
    fields: tuple[PointField, ...]
    width: int = 0
    height: int = 1
    point_step: int = 0
    encoding: Encoding = Encoding.LOSSY
    compression: Compression = Compression.ZSTD
    encoding_config: str = field(default="", compare=False)
    version: int = field(default=5, compare=False)

    def __post_init__(self):
        object.__setattr__(self, "fields", tuple(self.fields))

    @property
    def points(self) -> int:
        return self.width * self.height

    def dtype(self) -> np.dtype:
        """The layout of a point in memory, padding included."""
        return np.dtype({"names": [f.name for f in self.fields], "formats": [DTYPE[f.type] for f in self.fields], "offsets": [f.offset for f in self.fields], "itemsize": self.point_step})

    def same_layout(self, other: Header) -> bool:
        """Equal dimensions and fields, whatever their resolutions and the options."""
        strip = lambda h: replace(h, fields=tuple(replace(f, resolution=None) for f in h.fields), encoding=Encoding.NONE, compression=Compression.NONE)
        return strip(self) == strip(other)


def packed_fields(columns: list[tuple[str, FieldType, float | None]]) -> tuple[tuple[PointField, ...], int]:
    """Fields one behind the other without padding, and the point's size."""
    out, at = [], 0
    for name, kind, resolution in columns:
        out.append(PointField(name, at, kind, resolution))
        at += size_of(kind)
    return tuple(out), at
