"""Filters and deduplication of points, and projection by a resolution profile."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointweave.functions.bits import half_away, is_finite, voxel_key
from pointweave.operators.order import indexed
from pointweave.operators.sequence import inverse, quantise


def finite(df: DataFrame, *columns: str) -> DataFrame:
    return df.where(is_finite(*[F.col(c) for c in columns]))


def not_nan(df: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        df = df.where(~F.isnan(c))
    return df


def voxels(df: DataFrame, resolution: float, xyz: tuple[str, str, str] = ("x", "y", "z")) -> DataFrame:
    """df with vx, vy, vz: 32-bit products rounded half away from zero."""
    inv = F.lit(inverse(resolution, "float")).cast("float")
    return df.withColumns({f"v{axis}": half_away((F.col(c).cast("float") * inv).cast("double")) for axis, c in zip("xyz", xyz, strict=True)})


def voxel_first(df: DataFrame, cloud: list[str], resolution: float, xyz: tuple[str, str, str] = ("x", "y", "z"), *, idx: str = "idx", packed: bool = False) -> DataFrame:
    """The first finite row of each voxel, with vx, vy, vz.

    An aggregation with map-side combining, so a voxel that holds a third of all points costs a row per task; a window would
    sort all its points in one. packed: by the 63-bit key, which takes voxels 2^21 ticks apart for one; else exact.
    """
    rows = voxels(finite(df, *xyz), resolution, xyz)
    keys = [voxel_key(F.col("vx"), F.col("vy"), F.col("vz")).alias("__key")] if packed else ["vx", "vy", "vz"]
    rest = [c for c in rows.columns if c != idx]
    first = rows.groupBy(*cloud, *keys).agg(F.min_by(F.struct(idx, *rest), idx).alias("__first"))
    return first.select("__first.*").select(*rows.columns)


def apply_profile(df: DataFrame, profile: dict[str, float], default: float | None = None) -> DataFrame:
    """Columns that the profile sets to 0 go; float columns with a resolution, their own or the default, become ticks."""
    out = []
    for name, kind in df.dtypes:
        resolution = profile.get(name, default if kind == "float" else None)
        if resolution == 0:
            continue
        ticks = resolution is not None and kind in ("float", "double")
        out.append(quantise(F.col(name), resolution, kind).alias(name) if ticks else F.col(name))
    return df.select(*out)


def removed_percent(df: DataFrame, kept: DataFrame) -> DataFrame:
    """One row: total, kept, removed_pct."""
    n, k = df.agg(F.count("*").alias("total")), kept.agg(F.count("*").alias("kept"))
    both = n.select("total", F.lit(1).alias("one")).join(k.select("kept", F.lit(1).alias("one")), "one")
    return both.select("total", "kept", F.round(100.0 * (1 - F.col("kept") / F.col("total")), 6).alias("removed_pct"))


def fields_as(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """The columns that ``wanted`` (name to type) knows, in its order; others are left out, another type is an error."""
    kinds = dict(df.dtypes)
    for name, kind in wanted.items():
        if name in kinds and kinds[name] != kind:
            raise TypeError(f"{name} is {kinds[name]}, not {kind}")
    return df.select(*[n for n in wanted if n in kinds])


def ranked(df: DataFrame, value: str, prefix: str = "sample") -> DataFrame:
    """df with ``name``: prefix and the row's place by ascending ``value``, then by the other columns, from 0 on."""
    own = indexed(df.withColumn("__one", F.lit(1)), ["__one"], [value, *[c for c in df.columns if c != value]], out="__place")
    return own.withColumn("name", F.concat(F.lit(prefix), F.col("__place").cast("string"))).drop("__one", "__place")
