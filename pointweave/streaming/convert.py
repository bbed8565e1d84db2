"""Streams of messages: conversion of each, and a report of the average ratio every so many messages."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def convert(messages: DataFrame, function: Callable[[bytes], bytes], data: str = "data") -> DataFrame:
    """Each message's bytes by function, in a batch or a stream; with raw_bytes and out_bytes. Where it raises ValueError the
    data is null and ``error`` says why, so one bad message doesn't end a stream."""

    kind = pa.struct([("data", pa.binary()), ("error", pa.string())])

    def one(raw: bytes | None) -> dict:
        try:
            return {"data": None if raw is None else function(raw), "error": None}
        except ValueError as e:
            return {"data": None, "error": str(e)}

    @F.arrow_udf("struct<data:binary,error:string>")
    def run(column: pa.Array) -> pa.Array:
        return pa.array([one(raw) for raw in column.to_pylist()], kind)

    made = messages.withColumn("__made", run.asNondeterministic()(F.col(data))).withColumn("raw_bytes", F.length(data).cast("long"))
    made = made.withColumn(data, F.col("__made.data")).withColumn("error", F.col("__made.error")).drop("__made")
    return made.withColumn("out_bytes", F.length(data).cast("long"))


def reports(messages: DataFrame, topic: str, order: str, raw: str | Column = "raw_bytes", out: str | Column = "out_bytes", every: int = 20, first_alone: bool = True) -> DataFrame:
    """A stream's reports: topic, report, messages, raw_bytes, out_bytes, ratio. Sums begin anew with each report; each
    covers ``every`` messages, but the first only one if ``first_alone``. State per topic: four numbers. Messages of a batch are taken by ``order``."""
    kinds = "topic string, report long, messages long, raw_bytes long, out_bytes long, ratio double"

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, n, raw_sum, out_sum = state.get if state.exists else (0, 0, 0, 0)
        rows, held = [], pd.concat(list(batches)).sort_values("order")
        for a, b in zip(held["raw"], held["out"], strict=True):
            n, raw_sum, out_sum = n + 1, raw_sum + int(a), out_sum + int(b)
            if (seen + 1 - first_alone) % every == 0:
                rows.append((key[0], seen // every, n, raw_sum, out_sum, out_sum / raw_sum if raw_sum else None))
                n = raw_sum = out_sum = 0
            seen += 1
        state.update((seen, n, raw_sum, out_sum))
        yield pd.DataFrame(rows, columns=["topic", "report", "messages", "raw_bytes", "out_bytes", "ratio"])

    own = messages.select(F.col(topic).cast("string").alias("topic"), F.col(order).alias("order"), (F.col(raw) if isinstance(raw, str) else raw).alias("raw"), (F.col(out) if isinstance(out, str) else out).alias("out"))
    return own.groupBy("topic").applyInPandasWithState(run, kinds, "seen long, n long, raw long, out long", "append", GroupStateTimeout.NoTimeout)


def sink_name(topic: str, compress: bool = True) -> str:
    return f"{topic}/{'compressed' if compress else 'decompressed'}"


def start(messages: DataFrame, path: str, checkpoint: str, *, available_now: bool = True):
    """Append a converted stream to Parquet files; files of a batch that is written again don't count twice."""
    writer = messages.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def start_batches(messages: DataFrame, current: Callable[[], Callable[[bytes], bytes]], path: str, checkpoint: str, *, available_now: bool = True):
    """As start, with ``current()`` asked for the function anew for each batch, so that a resolution can change while the
    stream runs. A batch is one folder, written over if it is tried again."""

    def write(batch: DataFrame, number: int) -> None:
        convert(batch, current()).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = messages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
