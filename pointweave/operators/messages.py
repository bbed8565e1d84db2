"""Operators on sets of messages: lookups by id, limits, samples and statistics per topic.

Dimensions are broadcast if Spark knows them to be small, in bytes: from files' sizes, or at run time from a shuffle's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def with_schema(messages: DataFrame, channels: DataFrame, schemas: DataFrame) -> DataFrame:
    """Messages of known channels and schemas, with both."""
    return messages.join(channels, "channel_id").join(schemas, "schema_id")


def remapped(df: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """``column`` by mapping (old, new); an id without a new one raises an error."""
    joined = df.join(mapping, F.col(column) == F.col("old"), "left")
    known = F.when(F.col("new").isNull(), F.raise_error(F.concat(F.lit(f"unknown {column}: "), F.col(column).cast("string")))).otherwise(F.col("new"))
    return joined.withColumn(column, known).drop("old", "new")


def of_channels(messages: DataFrame, channels: DataFrame, on: str) -> DataFrame:
    return messages.join(channels.select(on), on, "left_semi")


def first_n(df: DataFrame, topic: list[str], order: list[str], n: int) -> DataFrame:
    """The first n of each topic. Spark keeps n rows per topic and task before the exchange."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*topic).orderBy(*order))).where(F.col("__n") <= n).drop("__n")


def sample(df: DataFrame, topic: list[str], order: list[str], *, first: int, every: int) -> DataFrame:
    """One in ``every`` of the first ``first`` of each topic, with their ordinal ``seen``."""
    seen = df.withColumn("seen", F.row_number().over(Window.partitionBy(*topic).orderBy(*order)))
    return seen.where(F.col("seen") <= first).where((F.col("seen") - 1) % every == 0)


def ratio_of_sums(out: Column, given: Column) -> Column:
    return F.sum(out) / F.sum(given)


def mean_of_ratios(out: Column, given: Column) -> Column:
    return F.avg(out / given)


def with_total(df: DataFrame, topic: str, *aggregates: Column, total: str = "TOTAL") -> DataFrame:
    """A row per topic, and one over all if there is more than one topic."""
    rolled = df.rollup(topic).agg(F.grouping(topic).alias("__all"), F.countDistinct(topic).alias("__topics"), *aggregates)
    rolled = rolled.where((F.col("__all") == 0) | (F.col("__topics") > 1))
    return rolled.withColumn(topic, F.when(F.col("__all") == 1, F.lit(total)).otherwise(F.col(topic))).drop("__all", "__topics")


def count_windows(ordinal: str, size: int = 20) -> Column:
    """The report a message belongs to, by its ordinal from 1 on: the first report is of one message."""
    return F.floor((F.col(ordinal) + size - 2) / size).cast("bigint")


def is_whole(size: Column, width: Column, height: Column, point_step: Column) -> Column:
    """Whether a payload's size is what its dimensions say; as ``cdr.is_whole``."""
    return size == width.cast("bigint") * height.cast("bigint") * point_step.cast("bigint")


def same_layout(one: Column, other: Column) -> Column:
    """Whether two headers (structs of width, height, point_step and fields, those of name, offset and type) are equal but for
    resolutions and options; as ``Header.same_layout``."""
    plain = lambda h: F.transform(h["fields"], lambda f: F.struct(f["name"], f["offset"], f["type"]))
    sizes = [one[c] == other[c] for c in ("width", "height", "point_step")]
    return sizes[0] & sizes[1] & sizes[2] & (plain(one) == plain(other))
