"""Choice of an integer column's encoding by its exact size in bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointweave.functions.bits import index_bits, uvarint_size, varint_size

#: The modes, in the order in which ties are settled, by wire number.
MODES = ("delta_varint", "palette", "rle", "delta_rle")
PROBE = 4096


def section_sizes(df: DataFrame, column: str, cloud: list[str], width: int, *, idx: str = "idx", chunk: str = "chunk") -> DataFrame:
    """Bytes of each mode's section: cloud, chunk, n, distinct, and a column per mode. width: bytes of a raw value."""
    w = Window.partitionBy(*cloud, chunk).orderBy(idx)
    value = F.col(column).cast("bigint")
    # both kinds of runs and the deltas share one sort
    rows = df.select(*cloud, chunk, idx, value.alias("v"), (value - F.coalesce(F.lag(value).over(w), F.lit(0))).alias("d"))
    first = F.row_number().over(w) == 1
    new = lambda c: F.when(first | (F.lag(c).over(w) != F.col(c)), F.col(idx))
    rows = rows.withColumns({"v_new": new("v"), "d_new": new("d")})
    # a run's length: to the next run's beginning, or the chunk's end; running backwards, as a frame that reaches ahead
    # would be computed anew for each row
    ahead = Window.partitionBy(*cloud, chunk).orderBy(F.col(idx).desc()).rowsBetween(Window.unboundedPreceding, -1)
    end = F.max(idx).over(Window.partitionBy(*cloud, chunk)) + 1
    following = lambda c: F.coalesce(F.min(c).over(ahead), end) - F.col(idx)
    rows = rows.withColumns({"v_run": F.when(F.col("v_new").isNotNull(), following("v_new")), "d_run": F.when(F.col("d_new").isNotNull(), following("d_new"))})
    cost = varint_size(F.col("d"))
    found = rows.groupBy(*cloud, chunk).agg(
        F.count("*").alias("n"),
        F.countDistinct("v").alias("distinct"),
        (F.sum(cost) + 1).alias("delta_varint"),
        (F.sum(F.when(F.col("v_run").isNotNull(), uvarint_size(F.col("v_run")) + width)) + 5).alias("rle"),
        (F.sum(F.when(F.col("d_run").isNotNull(), cost + uvarint_size(F.col("d_run")))) + 5).alias("delta_rle"),
    )
    packed = F.floor((index_bits(F.col("distinct")) * F.col("n") + 7) / 8)
    return found.withColumn("palette", (F.lit(3) + F.col("distinct") * width + packed).cast("bigint"))


def best_mode() -> Column:
    """The smallest section's mode; of equal ones the first in MODES."""
    least = F.least(*[F.col(m) for m in MODES])
    chain = F.when(F.col(MODES[0]) == least, F.lit(MODES[0]))
    for m in MODES[1:]:
        chain = chain.when(F.col(m) == least, F.lit(m))
    return chain


def frozen_mode(df: DataFrame, column: str, cloud: list[str], width: int, *, idx: str = "idx", chunk: str = "chunk", probe: int = PROBE) -> DataFrame:
    """The mode of each cloud, decided by its first ``probe`` rows, or by its first chunk if that has no more: cloud, mode."""
    first = df.where(F.col(chunk) == 0)
    sizes = section_sizes(first.where(F.col(idx) < probe), column, cloud, width, idx=idx, chunk=chunk)
    return sizes.select(*cloud, best_mode().alias("mode"))
