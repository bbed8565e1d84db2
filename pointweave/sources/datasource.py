"""A Spark data source and sink for MCAP messages, ``spark.read`` and ``df.write.format("pointweave_mcap")``, and a sink for files.

A partition per chunk of the container's index (per file without one), so a container of any size is read in parallel and a
chunk at a time. Equality filters on channel_id are pushed down. Paths are
opened by PyArrow (file, hdfs, s3, gs); ``pointweave.sources.tables.read_mcap`` reads from any store that Spark opens.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, InputPartition, WriterCommitMessage

from pointweave.sources import mcap
from pointweave.sources.convert import Conversion
from pointweave.sources.definitions import CLOUD
from pointweave.sources.stores import Staged, definitions_of, discard, listed, opened, settle

SCHEMA = "path string, chunk int, ordinal long, channel_id int, sequence long, log_time long, publish_time long, data binary"
ARROW = pa.schema([("path", pa.string()), ("chunk", pa.int32()), ("ordinal", pa.int64()), ("channel_id", pa.int32()), ("sequence", pa.int64()), ("log_time", pa.int64()), ("publish_time", pa.int64()), ("data", pa.binary())])


@dataclass
class Part(InputPartition):
    path: str
    chunk: int
    place: int | None
    size: int


class McapReader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.channel = path, None

    def pushFilters(self, filters):  # noqa: N802
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("channel_id",):
                self.channel = f.value
            else:
                yield f

    def partitions(self) -> list[Part]:
        (store, _), out = opened(self.path), []
        for i in listed(self.path, ".mcap"):
            with store.open_input_file(i.path) as file:
                ranges = mcap.chunk_ranges(lambda n, at, file=file: file.read_at(n, at), i.size)
            out += [Part(i.path, k, place, size) for k, (place, size) in enumerate(ranges)] if ranges else [Part(i.path, 0, None, i.size)]
        return out

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        store, _ = opened(self.path)
        with store.open_input_file(part.path) as file:
            raw = file.read_at(part.size, part.place or 0)
        if part.place is None:
            found = mcap.all_records(raw)
        else:
            (_, body), *_ = mcap.records(raw)
            found = mcap.records(mcap.body_of_chunk(body))
        rows, ordinal = [], 0
        for op, body in found:
            if op != mcap.MESSAGE:
                continue
            m, ordinal = mcap.message_of(body), ordinal + 1
            if self.channel is None or m.channel_id == self.channel:
                rows.append((part.path, part.chunk, ordinal - 1, m.channel_id, m.sequence, m.log_time, m.publish_time, m.data))
            if len(rows) >= 256:
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(ARROW)], schema=ARROW)
                rows = []
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(ARROW)], schema=ARROW)


@dataclass
class Done(WriterCommitMessage):
    folder: str
    names: list[str]


class Sink(DataSourceArrowWriter):
    """Files of finished tasks alone get their names, when the job is committed."""

    def __init__(self, options: dict):
        self.folder = options["path"]

    def commit(self, messages) -> None:
        settle(self.folder, [(m.folder, m.names) for m in messages if m is not None])

    def abort(self, messages) -> None:
        discard(self.folder)


class McapWriter(Sink):
    """A container for each path in the rows, which come sorted by path. Definitions are those of the containers in ``like``,
    with the schema ``swap`` in its converted form, or the same for all, in ``definitions``."""

    def __init__(self, options: dict):
        super().__init__(options)
        self.like, self.compression = options.get("like"), options.get("compression", "zstd")
        self.swap, self.given = options.get("swap"), options.get("definitions")

    def box(self, path: str) -> mcap.Container:
        if self.like is None:
            return container_of(self.given)
        found = definitions_of(self.like, path)
        return Conversion(encode=self.swap == CLOUD).definitions(found) if self.swap else found

    def name(self, path: str) -> str:
        """Relative to ``like`` if that is a folder above it."""
        root = "" if self.like is None else opened(self.like)[1].rstrip("/") + "/"
        return path[len(root) :] if root and path.startswith(root) else path.rsplit("/", 1)[-1]

    def write(self, batches: Iterator[pa.RecordBatch]) -> Done:
        staged, at, out, writer = Staged(self.folder), None, None, None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("path", "channel_id", "sequence", "log_time", "publish_time", "data")]
            for path, *message in zip(*columns, strict=True):
                if path != at:
                    if writer:
                        writer.close()
                        out.close()
                    at, out = path, staged.create(self.name(path))
                    writer = mcap.Writer(out, self.box(path), compression=self.compression)
                writer.add(mcap.Message(*message))
        if writer:
            writer.close()
            out.close()
        return Done(staged.own, staged.names)


def definitions_json(box: mcap.Container) -> str:
    """Schemas, channels, metadata and profile for the option ``definitions``."""
    schemas = [[s.id, s.name, s.encoding, s.data.hex()] for s in box.schemas]
    channels = [[c.id, c.schema_id, c.topic, c.message_encoding, c.metadata] for c in box.channels]
    return json.dumps({"profile": box.profile, "schemas": schemas, "channels": channels, "metadata": box.metadata})


def container_of(text: str) -> mcap.Container:
    given = json.loads(text)
    schemas = [mcap.Schema(i, name, encoding, bytes.fromhex(data)) for i, name, encoding, data in given["schemas"]]
    channels = [mcap.Channel(*c) for c in given["channels"]]
    return mcap.Container(schemas, channels, [(name, values) for name, values in given["metadata"]], [], given["profile"])


class McapSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pointweave_mcap"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> McapReader:
        return McapReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> McapWriter:
        return McapWriter(dict(self.options))


class FileWriter(Sink):
    def write(self, batches: Iterator[pa.RecordBatch]) -> Done:
        staged = Staged(self.folder)
        for batch in batches:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content"), strict=True):
                with staged.create(name) as out:
                    out.write(content.as_buffer())
        return Done(staged.own, staged.names)


class FileSink(DataSource):
    """Rows (name, content) as files: ``df.write.format("pointweave_files").save(folder)``."""

    @classmethod
    def name(cls) -> str:
        return "pointweave_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> FileWriter:
        return FileWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    """Both sources, and Spark's pushdown of filters to them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(McapSource)
    spark.dataSource.register(FileSink)
