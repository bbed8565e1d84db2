"""Order: every sequence operator needs a row's number within its cloud, and chunks of so many rows.

A window over a whole cloud would put a topic with a third of all rows into one task. ``indexed`` instead sorts the table in
range partitions by cloud and the whole order, whose bounds Spark takes from a sample of the rows themselves, so outliers, text
and constant columns don't matter. The sorted partitions are written to the shared folder, so that their places are settled
whatever is lost later; then rows of each (partition, cloud) are counted with map-side combining, and a row's number is its
place in the partition plus what the partitions before hold of its cloud. Later windows are over chunks, which are bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from pointweave.storage import written

CHUNK = 32 * 1024
#: Rows of a range partition.
RANGE_ROWS = 250_000


def indexed(df: DataFrame, cloud: list[str], order: list[str], *, out: str = "idx", range_rows: int = RANGE_ROWS) -> DataFrame:
    """df with ``out``: the row's number from 0 on in its cloud, by the columns in ``order`` (of any type that sorts; nulls
    first). Rows that are equal in all of them are numbered in an order of their own. A table of up to ``range_rows`` rows is
    numbered by one window, with the same numbers."""
    n = -(-df.count() // range_rows)
    if n <= 1:
        return df.withColumn(out, (F.row_number().over(Window.partitionBy(*cloud).orderBy(*order)) - 1).cast("bigint"))
    part, at, offset = f"__{out}_part", f"__{out}_at", f"__{out}_offset"
    placed = df.repartitionByRange(n, *cloud, *order).sortWithinPartitions(*cloud, *order)
    placed = written(placed.withColumns({part: F.spark_partition_id(), at: F.monotonically_increasing_id()}), "ordered")
    counts = placed.groupBy(*cloud, part).agg(F.count("*").alias("__n"), F.min(at).alias("__first"))
    before = Window.partitionBy(*cloud).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn(offset, F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).drop("__n", "__first")
    keys = {c: f"__{out}_key{k}" for k, c in enumerate([*cloud, part])}
    same = [F.col(c).eqNullSafe(F.col(k)) for c, k in keys.items()]
    joined = placed.join(counts.withColumnsRenamed(keys), same, "left").drop(*keys.values())
    return joined.withColumn(out, F.col(at) + F.col(offset)).drop(part, at, offset)


def chunked(df: DataFrame, *, idx: str = "idx", out: str = "chunk", size: int = CHUNK) -> DataFrame:
    return df.withColumn(out, F.floor(F.col(idx) / size).cast("bigint"))


def in_chunk(cloud: list[str], *, idx: str = "idx", chunk: str = "chunk") -> WindowSpec:
    return Window.partitionBy(*cloud, chunk).orderBy(idx)
