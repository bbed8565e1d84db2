"""Bit and size expressions, all inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ticks that a packed voxel key has on each side of zero, and bits an axis.
VOXEL_BIAS, VOXEL_BITS = 1 << 20, 21


def zigzag(d: Column) -> Column:
    """Signed to unsigned: 0, -1, 1, -2, ... to 0, 1, 2, 3, ..."""
    return F.shiftleft(d, 1).bitwiseXOR(F.shiftright(d, 63))


def unzigzag(z: Column) -> Column:
    return F.shiftrightunsigned(z, 1).bitwiseXOR(-z.bitwiseAND(F.lit(1)))


def uvarint_size(n: Column) -> Column:
    """Bytes of an unsigned LEB128 number; a negative long stands for 2^64 + n."""
    size = F.when(n < 0, F.lit(10))
    for k in range(1, 9):
        size = size.when(n < (1 << 7 * k), F.lit(k))
    return size.otherwise(F.lit(9)).cast("bigint")


def varint_size(d: Column) -> Column:
    """Bytes of a signed number: zig-zag and one more, as zero marks a missing value. The one isn't added, so as not to
    overflow."""
    z = zigzag(d)
    size = F.when(z < 0, F.lit(10))
    for k in range(1, 10):
        size = size.when(z < (1 << 7 * k) - 1, F.lit(k))
    return size.otherwise(F.lit(10)).cast("bigint")


def index_bits(distinct: Column) -> Column:
    """Bits of an index into so many values; none for one."""
    return F.when(distinct <= 1, F.lit(0)).otherwise(F.length(F.bin(distinct - 1))).cast("bigint")


def half_away(x: Column) -> Column:
    """To the nearest integer, halves away from zero."""
    return F.round(x).cast("bigint")


def half_even(x: Column) -> Column:
    return F.rint(x).cast("bigint")


def wrap32(d: Column) -> Column:
    """Two's complement of 32 bits."""
    return (d + (1 << 31)).bitwiseAND(F.lit((1 << 32) - 1)) - (1 << 31)


def voxel_key(x: Column, y: Column, z: Column) -> Column:
    """Three axes of 21 bits in one long, x lowest. Ticks beyond 2^20 wrap around."""
    mask = F.lit((1 << VOXEL_BITS) - 1)
    part = lambda v: (v + VOXEL_BIAS).bitwiseAND(mask)
    return part(x).bitwiseOR(F.shiftleft(part(y), VOXEL_BITS)).bitwiseOR(F.shiftleft(part(z), 2 * VOXEL_BITS))


def is_finite(*columns: Column) -> Column:
    """Neither NaN nor infinite, all of them."""
    out = F.lit(True)
    for c in columns:
        out = out & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))
    return out
