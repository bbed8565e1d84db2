"""Blobs, containers, messages and PCD files as tables, and back.

Files are read by Spark's binaryFile source, from whatever store it opens, and written through PyArrow. Chunks are separate rows as soon as they are cut
out of a file: encoding and decoding run a task per group of chunks, and a chunk has at most 32768 points.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointweave.functions import binary
from pointweave.functions.text import to_yaml
from pointweave.model import DTYPE, FROM_SPARK, SPARK_TYPE, FieldType, Header, packed_fields
from pointweave.operators.adaptive import PROBE
from pointweave.operators.order import CHUNK, chunked
from pointweave.plans.planner import steps
from pointweave.sources import cdr, mcap, pcd
from pointweave.sources.convert import Conversion
from pointweave.sources.stores import definitions_of, opened
from pointweave.storage import written

CHUNKS = "cloud long, chunk long, n long, stage1_bytes long, payload binary"


def header_for(df: DataFrame, columns: list[str], resolutions: dict[str, float] | None = None, **options) -> Header:
    """The header of a table's columns, packed side by side."""
    kinds, resolutions = dict(df.dtypes), resolutions or {}
    fields, step = packed_fields([(c, FROM_SPARK[kinds[c]], resolutions.get(c)) for c in columns])
    return Header(fields, point_step=step, **options)


def spark_schema(header: Header) -> str:
    return ", ".join(f"`{f.name}` {SPARK_TYPE[f.type]}" for f in header.fields)


def from_arrow(table: pa.Table, header: Header) -> np.ndarray:
    out = np.zeros(table.num_rows, header.dtype())
    for f in header.fields:
        column = table.column(f.name)
        if f.type == FieldType.UINT64 and pa.types.is_decimal(column.type):
            out[f.name] = np.array([int(v) for v in column.to_pylist()], np.uint64)
        elif f.type in (FieldType.FLOAT32, FieldType.FLOAT64):
            out[f.name] = column.cast(pa.float64()).fill_null(float("nan")).to_numpy()
        else:
            out[f.name] = column.to_numpy().astype(DTYPE[f.type])
    return out


def to_arrow(points: np.ndarray, header: Header) -> dict[str, pa.Array]:
    wide = {FieldType.UINT8: np.int16, FieldType.UINT16: np.int32, FieldType.UINT32: np.int64}
    out = {}
    for f in header.fields:
        v = np.ascontiguousarray(points[f.name])
        if f.type == FieldType.UINT64:
            out[f.name] = pa.array([int(x) for x in v], pa.decimal128(20, 0))
        else:
            out[f.name] = pa.array(v.astype(wide[f.type]) if f.type in wide else v, from_pandas=False)
    return out


def modes_of(points: DataFrame, header: Header, cloud: str, idx: str) -> DataFrame | None:
    """The mode of each section field of each cloud, by its first points: cloud, and __mode_<field>."""
    own = [f for kind, fs in steps(header) if kind == "section" for f in fs]
    if not own:
        return None

    def probe(key: tuple, table: pa.Table) -> pa.Table:
        held = from_arrow(table.sort_by(idx), header)
        return pa.table({"cloud": pa.array([key[0].as_py()], pa.int64()), **{f"__mode_{f.name}": pa.array([binary.choose_mode(held[f.name])]) for f in own}})

    first = points.where(F.col(idx) < PROBE).select(F.col(cloud).cast("long").alias("cloud"), idx, *[f.name for f in header.fields])
    return first.groupBy("cloud").applyInArrow(probe, "cloud long, " + ", ".join(f"`__mode_{f.name}` string" for f in own))


def encode_chunks(points: DataFrame, header: Header, cloud: str = "cloud", idx: str = "idx") -> DataFrame:
    """A row per chunk: cloud, chunk, n, its bytes before and after compression. Modes are those of the cloud's first points."""
    names = [f.name for f in header.fields]
    rows = chunked(points.select(F.col(cloud).cast("long").alias("cloud"), F.col(idx).cast("long").alias(idx), *names), idx=idx)
    modes = modes_of(points, header, cloud, idx)
    if modes is not None:
        rows = rows.join(written(modes, "modes"), "cloud")  # of a size that the planner knows

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by(idx)
        chosen = {c[7:]: table.column(c)[0].as_py() for c in table.column_names if c.startswith("__mode_")}
        raw = binary.encode_chunk(header, from_arrow(table, header), chosen)
        packed = binary.compress(raw, header.compression)
        return pa.table({"cloud": pa.array([key[0].as_py()], pa.int64()), "chunk": pa.array([key[1].as_py()], pa.int64()), "n": pa.array([table.num_rows], pa.int64()), "stage1_bytes": pa.array([len(raw)], pa.int64()), "payload": pa.array([packed], pa.binary())})

    return rows.groupBy("cloud", "chunk").applyInArrow(run, CHUNKS)


def decode_chunks(chunks: DataFrame, header: Header, columns: list[str] | None = None) -> DataFrame:
    """Points of (cloud, chunk, n, payload): cloud, idx and the fields, or only ``columns`` of them, the others passed over."""
    kept = replace(header, fields=tuple(f for f in header.fields if columns is None or f.name in columns))
    wanted = None if columns is None else set(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in ("cloud", "chunk", "n", "payload")}
                points = binary.open_chunk(header, row["payload"], row["n"], wanted)
                first = row["chunk"] * CHUNK
                yield pa.RecordBatch.from_pydict({"cloud": pa.array(np.full(row["n"], row["cloud"], np.int64)), "idx": pa.array(np.arange(first, first + row["n"])), **to_arrow(points, kept)})

    return chunks.select("cloud", "chunk", "n", "payload").mapInArrow(run, f"cloud long, idx long, {spark_schema(kept)}")


def blobs(chunks: DataFrame, header: Header, *, magic: bytes = binary.MAGIC) -> DataFrame:
    """A row per cloud: cloud, blob. A blob is one value, so it holds 2 GB at most; keep larger clouds as chunks."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk")
        own = replace(header, width=sum(table.column("n").to_pylist()), height=1)
        out = [binary.encode_header(own, magic=magic)]
        for payload in table.column("payload").to_pylist():
            out += [len(payload).to_bytes(4, "little"), payload]
        return pa.table({"cloud": pa.array([key[0].as_py()], pa.int64()), "blob": pa.array([b"".join(out)], pa.binary())})

    return chunks.groupBy("cloud").applyInArrow(run, "cloud long, blob binary")


def split_blobs(df: DataFrame, cloud: str = "cloud", blob: str = "blob", *, magic: bytes | None = None) -> DataFrame:
    """Blobs to chunks: cloud, header (as text), chunk, n, payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                raw = batch.column(1)[k].as_py()
                header, at = binary.decode_header(raw, magic=magic)
                for c, (chunk, n) in enumerate(binary.chunks_of(header, raw, at)):
                    yield pa.RecordBatch.from_pydict({"cloud": pa.array([batch.column(0)[k].as_py()], pa.int64()), "header": [to_yaml(header, exact=True)], "chunk": pa.array([c], pa.int64()), "n": pa.array([n], pa.int64()), "payload": pa.array([chunk], pa.binary())})

    return df.select(F.col(cloud).cast("long"), blob).mapInArrow(run, "cloud long, header string, chunk long, n long, payload binary")


def register(spark: SparkSession) -> None:
    from pointweave.sources import datasource

    datasource.register(spark)


def files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)


#: Bytes of a file that are read for its header at first; four times as many whenever it goes on.
HEAD = 1 << 16


def header_text(read_at, size: int) -> str | None:
    """A blob's header, from as many bytes as it takes; null if there is none. read_at(n, place) reads a part of it."""
    n = HEAD
    while True:
        try:
            return to_yaml(binary.decode_header(read_at(min(n, size), 0))[0], exact=True)
        except (ValueError, KeyError):
            if n >= size:
                return None
            n *= 4


def read_blob_headers(spark: SparkSession, path: str, glob: str = "*.cldn") -> DataFrame:
    """path, header (null for a file without one). Spark lists the files; their first bytes alone are read, through PyArrow
    (file, hdfs, s3, gs). Of other stores Spark reads the whole files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for name, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, inside = opened(name)
                with store.open_input_file(inside) as file:
                    found.append(header_text(lambda n, at, file=file: file.read_at(n, at), size))
            yield pa.record_batch([batch.column(0), pa.array(found, pa.string())], ["path", "header"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column(0), batch.column(1), strict=True):
                held = raw.as_py()
                found = header_text(lambda n, at, held=held: held[at : at + n], len(held))
                yield pa.record_batch([pa.array([name.as_py()]), pa.array([found], pa.string())], ["path", "header"])

    listed = files(spark, path, glob)
    if path.partition("://")[0] in ("file", "hdfs", "s3", "s3a", "gs") or "://" not in path:
        return listed.select("path", "length").mapInArrow(run, "path string, header string")
    return listed.select("path", "content").mapInArrow(whole, "path string, header string")


def pcd_blobs(spark: SparkSession, path: str, glob: str = "*.pcd", **options) -> DataFrame:
    """PCD files as blobs: path, name (of the blob's file), content, error; a file that can't be read has an error and no
    content. options: as for ``pcd.to_blob``. Write them with ``save_files``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    made, error = pcd.to_blob(raw.as_py(), **options), None
                except (ValueError, KeyError) as e:
                    made, error = None, str(e) or type(e).__name__
                own = name.rsplit("/", 1)[-1].rsplit(".", 1)[0] + ".cldn"
                yield pa.record_batch([pa.array([name]), pa.array([own]), pa.array([made], pa.binary()), pa.array([error], pa.string())], ["path", "name", "content", "error"])

    return files(spark, path, glob).select("path", "content").mapInArrow(run, "path string, name string, content binary, error string")


def save_files(df: DataFrame, folder: str, name: str = "name", content: str = "content") -> None:
    """A file in ``folder`` for each row with content, in place of one that has its name; no file is seen half written."""
    register(df.sparkSession)
    rows = df.where(F.col(content).isNotNull()).select(F.col(name).alias("name"), F.col(content).cast("binary").alias("content"))
    rows.write.format("pointweave_files").mode("append").save(folder)


def convert_containers(spark: SparkSession, path: str, out: str, conversion: Conversion) -> None:
    """Every container in ``path`` (a file or a folder) to one with its name in ``out``. Messages are read and converted a chunk
    of a container to a task; each container is then written by one task, a chunk in memory at a time."""
    register(spark)
    messages = spark.read.format("pointweave_mcap").option("path", path).load()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted: dict[str, set[int]] = {}
        for batch in batches:
            for name in set(batch.column(0).to_pylist()) - set(wanted):
                wanted[name] = conversion.channels(definitions_of(path, name))
            rows = zip(*(batch.column(k).to_pylist() for k in (0, 3, 7)), strict=True)
            data = [conversion.message(raw) if channel in wanted[name] else raw for name, channel, raw in rows]
            yield batch.set_column(7, "data", pa.array(data, pa.binary()))

    made = messages.mapInArrow(run, messages.schema).repartition("path").sortWithinPartitions("path", "chunk", "ordinal")
    options = {"like": path, "compression": conversion.compression, "swap": conversion.source}
    made.write.format("pointweave_mcap").options(**options).mode("append").save(out)


def read_pcd(spark: SparkSession, path: str, header: Header, glob: str = "*.pcd") -> DataFrame:
    """Points of files with the header's fields: path, idx and the fields. A file without one of them is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                own, points = pcd.read(batch.column(1)[k].as_py())
                kinds = {f.name: f.type for f in own.fields}
                for f in header.fields:
                    if kinds.get(f.name) != f.type:
                        raise ValueError(f"{batch.column(0)[k].as_py()}: field {f.name} is {kinds.get(f.name)}, not {f.type.name}")
                for at in range(0, len(points), CHUNK):
                    some = points[at : at + CHUNK]
                    yield pa.RecordBatch.from_pydict({"path": pa.array([batch.column(0)[k].as_py()] * len(some)), "idx": pa.array(np.arange(at, at + len(some))), **to_arrow(some, header)})

    return files(spark, path, glob).select("path", "content").mapInArrow(run, f"path string, idx long, {spark_schema(header)}")


MCAP_TABLES = {
    "schemas": "path string, id int, name string, encoding string, data binary",
    "channels": "path string, id int, schema_id int, topic string, message_encoding string, metadata map<string,string>",
    "messages": "path string, ordinal long, channel_id int, sequence long, log_time long, publish_time long, data binary",
    "metadata": "path string, name string, metadata map<string,string>",
    "attachments": "path string, log_time decimal(20,0), create_time decimal(20,0), name string, media_type string, data binary",
}


def mcap_rows(table: str, path: str, raw: bytes) -> Iterator[tuple]:
    if table == "messages":
        held = (mcap.message_of(body) for op, body in mcap.all_records(raw) if op == mcap.MESSAGE)
        yield from ((path, k, m.channel_id, m.sequence, m.log_time, m.publish_time, m.data) for k, m in enumerate(held))
        return
    found, _ = mcap.read(raw)
    if table == "schemas":
        yield from ((path, s.id, s.name, s.encoding, s.data) for s in found.schemas)
    elif table == "channels":
        yield from ((path, c.id, c.schema_id, c.topic, c.message_encoding, list(c.metadata.items())) for c in found.channels)
    elif table == "metadata":
        yield from ((path, name, list(values.items())) for name, values in found.metadata)
    else:
        yield from ((path, *a) for a in found.attachments)


def read_mcap(spark: SparkSession, path: str, table: str = "messages", glob: str = "*.mcap") -> DataFrame:
    """One of MCAP_TABLES. ``ordinal`` is a message's place in its file."""
    return mcap_table(files(spark, path, glob), table)


def stream_mcap(spark: SparkSession, path: str, table: str = "messages", glob: str = "*.mcap", files_per_batch: int = 16) -> DataFrame:
    """As read_mcap, of the containers that come to a folder while the stream runs."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    reader = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_batch)
    return mcap_table(reader.load(path), table)


def mcap_table(given: DataFrame, table: str) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(MCAP_TABLES[table]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                rows = []
                for row in mcap_rows(table, batch.column(0)[k].as_py(), batch.column(1)[k].as_py()):
                    rows.append(row)
                    if len(rows) >= 256:
                        yield arrow_rows(rows, schema)
                        rows = []
                yield arrow_rows(rows, schema)

    return given.select("path", "content").mapInArrow(run, MCAP_TABLES[table])


def arrow_rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


def convert_messages(messages: DataFrame, wanted: str, convert, data: str = "data", schema_name: str = "schema_name") -> DataFrame:
    """``data`` of messages with the schema ``wanted`` by convert(bytes); others go through as they are, in one scan."""

    @F.arrow_udf("binary")
    def own(column: pa.Array) -> pa.Array:
        return pa.array([None if raw is None else convert(raw) for raw in column.to_pylist()], pa.binary())

    return messages.withColumn(data, F.when(F.col(schema_name) == wanted, own(F.when(F.col(schema_name) == wanted, F.col(data)))).otherwise(F.col(data)))


CLOUD = "stamp_sec int, stamp_nsec long, frame_id string, height long, width long, fields array<struct<name:string,offset:long,datatype:smallint,count:long>>, is_bigendian boolean, point_step long, row_step long, data binary, is_dense boolean, format string"


def parse_clouds(column, compressed: bool = False):
    """A column of messages as structs of CLOUD; null for a message that can't be read."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    kind = to_arrow_type(StructType.fromDDL(CLOUD))

    def one(raw: bytes | None) -> dict | None:
        try:
            c = None if raw is None else cdr.decode(raw, compressed)
        except (binary.Broken, ValueError):
            c = None
        if c is None:
            return None
        fields = [{"name": f.name, "offset": f.offset, "datatype": int(f.type), "count": 1} for f in c.fields]
        return {f.name: fields if f.name == "fields" else getattr(c, f.name) for f in kind}

    @F.arrow_udf(CLOUD)
    def parse(messages: pa.Array) -> pa.Array:
        return pa.array([one(raw) for raw in messages.to_pylist()], kind)

    return parse(column)
