"""Column transforms along a chunk's order, as window expressions. State begins anew with every chunk."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from pointweave.functions.bits import half_away, half_even, wrap32


def inverse(resolution: float, kind: str = "double") -> float:
    """1 / resolution in the field's type; a resolution itself is a 32-bit float."""
    own = np.float32(resolution)
    if not own > 0 or not np.isfinite(own):
        raise ValueError("a resolution must be positive and finite")
    return float(np.float32(1) / own) if kind == "float" else float(np.float64(1) / np.float64(own))


def quantise(value: Column, resolution: float, kind: str = "double") -> Column:
    """Ticks, halves away from zero; null for NaN."""
    scaled = value.cast(kind) * F.lit(inverse(resolution, kind)).cast(kind)
    return F.when(~F.isnan(value), half_away(scaled.cast("double")))


def quantise_even(value: Column, resolution: float) -> Column:
    """Ticks of a 32-bit float, halves to even; null for NaN."""
    scaled = value.cast("float") * F.lit(inverse(resolution, "float")).cast("float")
    return F.when(~F.isnan(value), half_even(scaled))


def dequantise(ticks: Column, resolution: float) -> Column:
    return ticks * F.lit(float(np.float32(resolution)))


def delta(value: Column, w: WindowSpec) -> Column:
    """Difference to the value before, 0 at first. A null (missing) value has none and counts as 0 for the next."""
    return value - F.coalesce(F.lag(value).over(w), F.lit(0))


def delta32(value: Column, w: WindowSpec) -> Column:
    return wrap32(delta(value, w))


def undelta(df: DataFrame, column: str, cloud: list[str], out: str, *, idx: str = "idx", chunk: str = "chunk") -> DataFrame:
    """Running sums of deltas; a null resets the sum to 0, so sums run in the segments between nulls."""
    w = Window.partitionBy(*cloud, chunk).orderBy(idx)
    segment = f"__{out}_segment"
    df = df.withColumn(segment, F.sum(F.col(column).isNull().cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(*cloud, chunk, segment).orderBy(idx).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.when(F.col(column).isNotNull(), F.sum(column).over(inside))).drop(segment)


def xor_residual(value: Column, w: WindowSpec) -> Column:
    return value.bitwiseXOR(F.coalesce(F.lag(value).over(w), F.lit(0)))


def unxor(residual: Column, w: WindowSpec) -> Column:
    return F.bit_xor(residual).over(w.rowsBetween(Window.unboundedPreceding, 0))


def runs(df: DataFrame, column: str, cloud: list[str], *, idx: str = "idx", chunk: str = "chunk") -> DataFrame:
    """A row per run of equal values: cloud, chunk, run (from 0), first (its first idx), value, length."""
    w = Window.partitionBy(*cloud, chunk).orderBy(idx)
    new = F.when(F.lag(F.col(column)).over(w).eqNullSafe(F.col(column)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    numbered = df.select(*cloud, chunk, idx, F.col(column).alias("value"), new.alias("__new"))
    numbered = numbered.withColumn("run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    found = numbered.groupBy(*cloud, chunk, "run").agg(F.min(idx).alias("first"), F.min("value").alias("value"), F.count("*").alias("length"))
    return found.select(*cloud, chunk, "run", "first", "value", "length")


def unruns(df: DataFrame, cloud: list[str], *, idx: str = "idx", chunk: str = "chunk") -> DataFrame:
    """Runs to rows: cloud, chunk, idx, value."""
    places = F.sequence(F.col("first"), F.col("first") + F.col("length") - 1)
    return df.select(*cloud, chunk, F.explode(places).alias(idx), "value")


def palette(df: DataFrame, column: str, cloud: list[str], out: str = "code", *, idx: str = "idx", chunk: str = "chunk") -> DataFrame:
    """Codes in the order in which values first occur in the chunk."""
    first = f"__{out}_first"
    df = df.withColumn(first, F.min(idx).over(Window.partitionBy(*cloud, chunk, column)))
    return df.withColumn(out, (F.dense_rank().over(Window.partitionBy(*cloud, chunk).orderBy(first)) - 1).cast("bigint")).drop(first)
