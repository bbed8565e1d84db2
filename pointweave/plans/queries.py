"""The query catalogue over the shared tables: clouds are event types, vectors and line items; see the README for the list.

All clouds are numbered by ``indexed`` and cut into chunks, and every window is over a chunk.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, WindowSpec
from pyspark.sql import functions as F

from pointweave import storage
from pointweave.functions import binary, bits, sqlfuncs
from pointweave.functions.text import from_yaml, parse_profile, to_yaml
from pointweave.model import Compression, Encoding, FieldType, Header, PointField, packed_fields
from pointweave.operators import adaptive, messages, rows, sequence
from pointweave.operators.order import chunked, in_chunk, indexed
from pointweave.plans import planner
from pointweave.sources import cdr, datasource, mcap, tables
from pointweave.sources.definitions import CLOUD

TOPIC = ["event_type"]
SIZE = 1000
RES = 0.01
PROFILE = "l_discount: remove; l_quantity: 0.5; l_extendedprice: 0.01"
LINE_ORDER = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """event_type, event_id, idx, chunk (of 1000) and columns, each once."""
    own = table(spark, sf_dir, "events").select(*dict.fromkeys(["event_id", "event_type", *columns]))
    return chunked(indexed(own, TOPIC, ["event_id"]), size=SIZE)


def xyz(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda k: F.col("embedding")[k].cast("float")
    return table(spark, sf_dir, "embeddings").select(F.lit(0).cast("bigint").alias("cloud"), F.col("vec_id").alias("idx"), at(0).alias("x"), at(1).alias("y"), at(2).alias("z"))


def with_gaps(value: Column) -> Column:
    """NaN and infinities at some ids."""
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    return F.when(F.col("event_id") % 97 == 0, nan).when(F.col("event_id") % 89 == 0, inf).when(F.col("event_id") % 83 == 0, -inf).otherwise(value)


def chunks() -> WindowSpec:
    return in_chunk(TOPIC)


def plateau() -> Column:
    return F.pmod(F.floor(F.col("idx") / 64), F.lit(8)).cast("bigint")


def micros(column: str = "ts") -> Column:
    """Microseconds since 1970, whatever the session's time zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {column})")


def q01_quantise_delta(spark, sf_dir):
    df = events(spark, sf_dir, "value").withColumn("q", sequence.quantise(F.col("value"), RES))
    df = df.withColumn("delta", sequence.delta(F.col("q"), chunks()))
    return df.select("event_id", "q", "delta", (bits.zigzag(F.col("delta")) + 1).alias("code"))


def sized(spark, sf_dir):
    """event_type, event_id, out (bytes of the value's code), given (8)."""
    df = events(spark, sf_dir, "value").withColumn("q", sequence.quantise(F.col("value"), RES))
    return df.select("event_type", "event_id", bits.varint_size(sequence.delta(F.col("q"), chunks())).alias("out"), F.lit(8).cast("bigint").alias("given"))


def q02_delta_varint_size_by_topic(spark, sf_dir):
    return sized(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("out").alias("bytes"))


def q03_quantise_half_even(spark, sf_dir):
    df = events(spark, sf_dir, "value").withColumn("q", sequence.quantise_even(F.col("value"), 0.5))
    return df.select("event_id", "q", sequence.delta32(F.col("q"), chunks()).alias("delta"))


def q04_int_delta_chunks(spark, sf_dir):
    df = events(spark, sf_dir, "user_id").withColumn("delta", sequence.delta(F.col("user_id"), chunks()))
    return df.select("event_id", "chunk", "delta", bits.zigzag(F.col("delta")).alias("zz"), bits.unzigzag(bits.zigzag(F.col("delta"))).alias("back"))


def q05_finite_filter(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("event_type", with_gaps(F.col("value")).alias("v"))
    n = lambda d, name: d.groupBy("event_type").agg(F.count("*").alias(name))
    return n(df, "n_all").join(n(rows.finite(df, "v"), "n_finite"), "event_type").join(n(rows.not_nan(df, "v"), "n_not_nan"), "event_type")


def q06_voxel_dedup_first(spark, sf_dir):
    return rows.voxel_first(xyz(spark, sf_dir), ["cloud"], 0.1).select(F.col("idx").alias("vec_id"), "vx", "vy", "vz")


def q07_voxel_key_packed(spark, sf_dir):
    kept = rows.voxel_first(xyz(spark, sf_dir), ["cloud"], 0.1, packed=True)
    return kept.select(F.col("idx").alias("vec_id"), bits.voxel_key(F.col("vx"), F.col("vy"), F.col("vz")).alias("key"))


def q08_resolution_profile_project(spark, sf_dir):
    return rows.apply_profile(table(spark, sf_dir, "lineitem").drop("l_shipdate"), parse_profile(PROFILE))


def q09_viz_removed_pct(spark, sf_dir):
    df = xyz(spark, sf_dir)
    return rows.removed_percent(df, rows.voxel_first(df, ["cloud"], 0.1))


def q10_topic_ratio(spark, sf_dir):
    out = (F.count("*").alias("messages"), F.sum("given").alias("given"), F.sum("out").alias("out"), F.round(messages.ratio_of_sums(F.col("out"), F.col("given")), 6).alias("ratio"))
    return messages.with_total(sized(spark, sf_dir), "event_type", *out)


def q11_rle_runs(spark, sf_dir):
    return sequence.runs(events(spark, sf_dir).withColumn("v", plateau()), "v", TOPIC)


def q12_delta_rle_runs(spark, sf_dir):
    df = events(spark, sf_dir).withColumn("v", F.col("idx") * 3 + F.floor(F.col("idx") / 64) * F.floor(F.col("idx") / 64))
    return sequence.runs(df.withColumn("d", sequence.delta(F.col("v"), chunks())), "d", TOPIC)


def q13_palette_first_occurrence(spark, sf_dir):
    df = events(spark, sf_dir, "user_id").withColumn("v", F.col("user_id") % 16)
    return sequence.palette(df, "v", TOPIC).select("event_id", "v", "code")


def event_sizes(spark, sf_dir):
    return adaptive.section_sizes(events(spark, sf_dir, "user_id"), "user_id", TOPIC, 8)


SIZES = ["n", "distinct", *adaptive.MODES]


def q14_section_sizes(spark, sf_dir):
    return event_sizes(spark, sf_dir).select("event_type", "chunk", *SIZES)


def q15_best_mode_per_chunk(spark, sf_dir):
    own = events(spark, sf_dir).withColumn("v", F.when(F.col("event_type") < "m", plateau()).otherwise(F.col("idx") * 7))
    return adaptive.section_sizes(own, "v", TOPIC, 4).select("event_type", "chunk", adaptive.best_mode().alias("mode"))


def q16_frozen_mode_from_probe(spark, sf_dir):
    own = table(spark, sf_dir, "lineitem").withColumn("cloud", F.lit(0))
    lines = chunked(indexed(own, ["cloud"], LINE_ORDER))
    modes = adaptive.frozen_mode(lines, "l_linenumber", ["cloud"], 4)
    sizes = adaptive.section_sizes(lines, "l_linenumber", ["cloud"], 4).join(modes, "cloud")
    chain = F.when(F.col("mode") == adaptive.MODES[0], F.col(adaptive.MODES[0]))
    for m in adaptive.MODES[1:]:
        chain = chain.when(F.col("mode") == m, F.col(m))
    return sizes.select("chunk", "n", "mode", chain.alias("bytes"))


def q17_palette_index_bits(spark, sf_dir):
    return event_sizes(spark, sf_dir).select("event_type", "chunk", "distinct", bits.index_bits(F.col("distinct")).alias("bits"))


def q18_delta_roundtrip_error(spark, sf_dir):
    df = events(spark, sf_dir, "value").withColumn("d", sequence.delta(sequence.quantise(F.col("value"), RES), chunks()))
    back = sequence.undelta(df, "d", TOPIC, "q")
    error = F.abs(sequence.dequantise(F.col("q"), RES) - F.col("value"))
    return back.groupBy("event_type").agg(F.round(F.max(error), 9).alias("max_error"), F.sum("q").alias("sum_q"))


def q19_nan_reset_roundtrip(spark, sf_dir):
    df = events(spark, sf_dir, "value").withColumn("v", F.when(F.col("event_id") % 97 == 0, F.lit(float("nan"))).otherwise(F.col("value")))
    df = df.withColumn("q", sequence.quantise(F.col("v"), RES)).withColumn("d", sequence.delta(F.col("q"), chunks()))
    return sequence.undelta(df, "d", TOPIC, "back").select("event_id", "d", "back")


def q20_rle_decode_explode(spark, sf_dir):
    return sequence.unruns(q11_rle_runs(spark, sf_dir), TOPIC)


def q21_xor_int_residual_roundtrip(spark, sf_dir):
    df = events(spark, sf_dir, "user_id").withColumn("residual", sequence.xor_residual(F.col("user_id"), chunks()))
    return df.select("event_id", "residual", sequence.unxor(F.col("residual"), chunks()).alias("back"))


def q22_schema_join_filter(spark, sf_dir):
    channels = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("channel_id"), F.col("n_name").alias("topic"), F.col("n_regionkey").alias("schema_id"))
    schemas = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("schema_id"), F.col("r_name").alias("schema_name"))
    own = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("channel_id"))
    return messages.with_schema(own, channels, schemas.where(F.col("schema_name").contains("A"))).select("c_custkey", "topic", "schema_name")


def q23_id_remap(spark, sf_dir):
    named = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("old"), F.col("n_name").alias("name"))
    new = indexed(named.withColumn("one", F.lit(1)), ["one"], ["old"], out="new").select("old", (F.col("new") + 100).alias("new"))
    return messages.remapped(table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("id")), "id", new)


def q24_semi_channel_filter(spark, sf_dir):
    wanted = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return messages.of_channels(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), wanted, "o_custkey")


def q25_first_n_per_topic(spark, sf_dir):
    return messages.first_n(table(spark, sf_dir, "events").select("event_id", "event_type", "ts"), TOPIC, ["ts", "event_id"], 100).select("event_id", "event_type")


def q26_sample_every(spark, sf_dir):
    return messages.sample(table(spark, sf_dir, "events").select("event_id", "event_type"), TOPIC, ["event_id"], first=500, every=7).select("event_id", F.col("seen").cast("bigint").alias("seen"))


def q27_mean_of_ratios_vs_ratio_of_sums(spark, sf_dir):
    df = sized(spark, sf_dir).withColumn("given", F.col("given") + F.col("event_id") % 3)
    own = messages.mean_of_ratios(F.col("out"), F.col("given")), messages.ratio_of_sums(F.col("out"), F.col("given"))
    return df.groupBy("event_type").agg(F.round(own[0], 6).alias("mean_of_ratios"), F.round(own[1], 6).alias("ratio_of_sums"), F.floor(F.sum("event_id") / F.count("*")).cast("bigint").alias("mean_whole"))


def q28_topic_rollup(spark, sf_dir):
    return messages.with_total(table(spark, sf_dir, "events").select("event_type", "user_id"), "event_type", F.count("*").alias("n"), F.sum("user_id").alias("users"))


def q29_count_window_report(spark, sf_dir):
    df = sized(spark, sf_dir).withColumn("one", F.lit(1))
    df = indexed(df, ["one"], ["event_id"], out="seen").withColumn("seen", F.col("seen") + 1)
    df = df.groupBy(messages.count_windows("seen").alias("report"))
    return df.agg(F.count("*").alias("messages"), F.round(messages.ratio_of_sums(F.col("out"), F.col("given")), 6).alias("ratio"))


def line_header(n: int = 0) -> Header:
    columns = [("l_quantity", FieldType.FLOAT64, 0.5), ("l_extendedprice", FieldType.FLOAT64, None), ("l_linenumber", FieldType.INT32, None), ("l_flag", FieldType.UINT8, None)]
    fields, step = packed_fields(columns)
    return Header(fields, n, 1, step, Encoding.LOSSY, Compression.NONE)


def q30_max_compressed_size(spark, sf_dir):
    """The planner's bound as a column: per point, and per chunk the slack and a length."""
    header = line_header()
    per_point = sum(planner.field_bound(f, header.encoding) for f in header.fields)
    per_chunk = 4 + (32 * len(header.fields) + 1024 if planner.is_adaptive(header) else 0)
    sizes = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"))
    return sizes.select("l_returnflag", "n", (F.col("n") * per_point + F.ceil(F.col("n") / 32768) * per_chunk).cast("bigint").alias("bound"))


def q31_float_bits_xor(spark, sf_dir):
    """Residuals of 32-bit floats' bits within each chunk, and the floats again."""
    header = Header(packed_fields([("x", FieldType.FLOAT32, None)])[0], point_step=4, encoding=Encoding.LOSSLESS, compression=Compression.NONE)
    df = xyz(spark, sf_dir).select("cloud", "idx", "x")
    return tables.decode_chunks(tables.encode_chunks(df, header), header).select(F.col("idx").alias("vec_id"), "x")


def q32_gorilla_size(spark, sf_dir):
    header = Header(packed_fields([("value", FieldType.FLOAT64, None)])[0], point_step=8, compression=Compression.NONE)
    return tables.encode_chunks(event_points(spark, sf_dir, "value"), header).select("cloud", "chunk", "n", F.col("stage1_bytes").alias("bytes"))


def event_points(spark, sf_dir, *columns):
    """cloud (a hash of the topic), idx and columns."""
    df = events(spark, sf_dir, *columns)
    return df.select(cloud_of("event_type"), "idx", *columns)


def cloud_of(topic: str) -> Column:
    """A number for a topic: the first 60 bits of its SHA-256."""
    return F.conv(F.substring(F.sha2(F.col(topic), 256), 1, 15), 16, 10).cast("bigint").alias("cloud")


def event_header(df: DataFrame, compression: Compression = Compression.ZSTD) -> Header:
    return tables.header_for(df, ["event_id", "value", "user_id"], {"value": RES}, compression=compression)


def q33_blob_roundtrip(spark, sf_dir):
    df = event_points(spark, sf_dir, "event_id", "value", "user_id")
    header = event_header(df)
    blob = tables.blobs(tables.encode_chunks(df, header), header)
    back = tables.decode_chunks(tables.split_blobs(blob), header)
    return back.select("event_id", F.round("value", 6).alias("value"), "user_id")


def q34_zstd_chunk_size(spark, sf_dir):
    df = event_points(spark, sf_dir, "event_id", "value", "user_id")
    return tables.encode_chunks(df, event_header(df)).select("cloud", "chunk", "n", "stage1_bytes", F.length("payload").alias("bytes"))


YAML_HEADER = Header((PointField("x", 0, FieldType.FLOAT32, 0.001), PointField("ring", 16, FieldType.UINT16)), 10, 2, 18)


def q35_header_yaml(spark, sf_dir):
    return spark.createDataFrame([(1, to_yaml(YAML_HEADER, exact=True))], "id long, header string")


def q36_message_totals(spark, sf_dir):
    """Per topic: messages, bytes, points (of 8 bytes), MB/s over the time between first and last message."""
    df = table(spark, sf_dir, "events").select("event_type", micros().alias("us"), F.length("props").cast("bigint").alias("bytes"))
    found = df.groupBy("event_type").agg(F.count("*").alias("messages"), F.sum("bytes").alias("bytes"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))
    rate = F.col("bytes") / F.nullif(F.col("last_us") - F.col("first_us"), F.lit(0))
    return found.select("event_type", "messages", "bytes", F.floor(F.col("bytes") / 8).cast("bigint").alias("points"), (F.col("last_us") - F.col("first_us")).alias("duration_us"), F.round(rate, 9).alias("mb_per_s"))


def q37_channel_counts_by_schema(spark, sf_dir):
    own = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("schema_id")).agg(F.count("*").alias("channels"))
    names = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("schema_id"), F.col("r_name").alias("schema_name"))
    return own.join(names, "schema_id").select("schema_name", "channels")


def q38_weighted_throughput(spark, sf_dir):
    """Mean of rates weighted by size: sum(rate * size) / sum(size)."""
    df = sized(spark, sf_dir).select("event_type", (F.col("event_id") % 50 + 1).alias("rate"), F.col("out").alias("size"))
    return df.groupBy("event_type").agg(F.round(F.sum(F.col("rate") * F.col("size")) / F.sum("size"), 6).alias("weighted"))


def q39_first_message_per_topic(spark, sf_dir):
    """By an aggregation: a struct's least is its first field's."""
    df = table(spark, sf_dir, "events").select("event_type", "event_id", micros().alias("us"))
    return df.groupBy("event_type").agg(F.min(F.struct("us", "event_id")).alias("first")).select("event_type", "first.event_id", "first.us")


def q40_global_first_n(spark, sf_dir):
    return table(spark, sf_dir, "events").orderBy("ts", "event_id").limit(25).select("event_id", "event_type")


def q41_sorted_schema_names(spark, sf_dir):
    own = table(spark, sf_dir, "events").select(F.col("event_type").alias("name")).distinct().withColumn("one", F.lit(1))
    return indexed(own, ["one"], ["name"]).select((F.col("idx") + 1).alias("place"), "name")


def q42_pass_through_union(spark, sf_dir):
    """Some topics' values converted, the others' untouched, in one scan and in order."""
    df = events(spark, sf_dir, "value")
    wanted = F.col("event_type") < "m"
    return df.select("event_id", F.when(wanted, sequence.quantise(F.col("value"), RES).cast("double")).otherwise(F.col("value")).alias("value"), wanted.alias("converted"))


def q43_payload_size_check(spark, sf_dir):
    """Payloads whose size isn't what their dimensions say: a flag a row, of which some lines have two."""
    step = F.when(F.col("l_quantity") > 25, 2).otherwise(1)
    whole = messages.is_whole(F.length("l_returnflag"), F.lit(1), F.lit(1), step)
    return table(spark, sf_dir, "lineitem").groupBy(whole.alias("whole")).agg(F.count("*").alias("n"))


def q44_interleaved_payload(spark, sf_dir):
    """Vectors as points of 64 fields: field offsets and quantised sums."""
    df = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("field", "v"))
    q = sequence.quantise(F.col("v"), 0.001, "float")
    return df.groupBy("field").agg(F.count("*").alias("n"), F.sum(q).alias("ticks")).select(F.col("field").cast("bigint").alias("field"), (F.col("field") * 4).cast("bigint").alias("offset"), "n", "ticks")


def q45_nanosecond_times(spark, sf_dir):
    """Nanoseconds to seconds and a remainder, and back to a timestamp."""
    ns = (micros() * 1000 + F.col("event_id") % 1000).alias("ns")
    df = table(spark, sf_dir, "events").select("event_id", ns)
    return df.select("event_id", F.floor(F.col("ns") / F.lit(10**9).cast("decimal(20,0)")).cast("bigint").alias("sec"), F.pmod("ns", F.lit(10**9)).alias("nsec"), F.unix_micros(F.timestamp_micros(F.expr("ns div 1000"))).alias("us"))


def q46_topic_fingerprint(spark, sf_dir):
    """FNV-1a over each chunk's ids in order, a chunk at a time."""
    df = events(spark, sf_dir)

    def run(key, held):
        raw = held.sort_by("idx").column("event_id").to_numpy().astype("<i8").tobytes()
        return pa.table({"event_type": [key[0].as_py()], "chunk": pa.array([key[1].as_py()], pa.int64()), "fnv": [f"{binary.fingerprint(raw):016x}"]})

    return df.groupBy("event_type", "chunk").applyInArrow(run, "event_type string, chunk long, fnv string")


def q47_header_equality(spark, sf_dir):
    """Vectors' headers (a field per component, some cut short or of another type) against the first one's of their label."""
    n = F.size("embedding") - F.when(F.col("vec_id") % 7 == 0, 1).otherwise(0)
    kind = F.when(F.col("vec_id") % 11 == 0, "FLOAT64").otherwise("FLOAT32")
    field = lambda k: F.struct(F.concat(F.lit("f"), k.cast("string")).alias("name"), (k * 4).alias("offset"), kind.alias("type"), (F.col("vec_id") / 2).alias("resolution"))
    header = F.struct(F.lit(1).alias("width"), F.lit(1).alias("height"), (n * 4).alias("point_step"), F.transform(F.sequence(F.lit(0), n - 1), field).alias("fields"))
    df = table(spark, sf_dir, "embeddings").select("vec_id", "label", header.alias("header"))
    first = df.groupBy("label").agg(F.min_by("header", "vec_id").alias("first"))
    same = messages.same_layout(F.col("header"), F.col("first")).alias("same")
    return df.join(first, "label").groupBy("label", same).agg(F.count("*").alias("n"))


def q48_nan_free_subset(spark, sf_dir):
    """Points with their numbers in an organised cloud of 100 columns, NaN ones left out."""
    df = events(spark, sf_dir, "value").withColumn("v", with_gaps(F.col("value")))
    kept = rows.not_nan(df, "v")
    return kept.select("event_id", F.floor(F.col("idx") / 100).cast("bigint").alias("row"), (F.col("idx") % 100).alias("col"))


def q49_ranked_samples(spark, sf_dir):
    """Topics by ascending ratio, named by their place."""
    ratios = q10_topic_ratio(spark, sf_dir).select("event_type", "ratio")
    return rows.ranked(ratios, "ratio").select("name", "event_type", "ratio")


def q50_typed_fields(spark, sf_dir):
    """The fields that a type knows, of those that a table has."""
    wanted = {"l_orderkey": "bigint", "intensity": "float", "l_linenumber": "int"}
    return rows.fields_as(table(spark, sf_dir, "lineitem"), wanted)


def q51_stage1_size(spark, sf_dir):
    """Bytes of each chunk before compression: varints of ticks, and two sections in the mode of the cloud's first points."""
    df = event_points(spark, sf_dir, "event_id", "value", "user_id")
    return tables.encode_chunks(df, event_header(df, Compression.NONE)).select("cloud", "chunk", "n", "stage1_bytes", F.length("payload").cast("bigint").alias("bytes"))


def event_messages(spark, sf_dir) -> DataFrame:
    """event_type, chunk, data: each chunk's values and users as a cloud message."""
    fields, step = packed_fields([("value", FieldType.FLOAT64, None), ("user", FieldType.INT32, None)])

    def run(key, held):
        held = held.sort_by("idx")
        points = np.zeros(held.num_rows, Header(fields, point_step=step).dtype())
        points["value"], points["user"] = held.column("value").to_numpy(), held.column("user_id").to_numpy()
        cloud = cdr.Cloud(key[1].as_py(), 5, key[0].as_py(), 1, len(points), fields, False, step, step * len(points), points.tobytes(), True)
        return pa.table({"event_type": [key[0].as_py()], "chunk": pa.array([key[1].as_py()], pa.int64()), "data": pa.array([cdr.encode(cloud)], pa.binary())})

    return events(spark, sf_dir, "value", "user_id").groupBy("event_type", "chunk").applyInArrow(run, "event_type string, chunk long, data binary")


def q52_cdr_messages(spark, sf_dir):
    """Messages written and read again."""
    own = event_messages(spark, sf_dir).select("event_type", "chunk", F.length("data").cast("bigint").alias("message_bytes"), tables.parse_clouds(F.col("data")).alias("c"))
    names = F.array_join(F.transform("c.fields", lambda f: F.concat(f["name"], F.lit("@"), f["offset"].cast("string"), F.lit(":"), f["datatype"].cast("string"))), ",")
    return own.select("event_type", "chunk", "message_bytes", "c.stamp_sec", "c.stamp_nsec", "c.frame_id", "c.height", "c.width", "c.point_step", "c.row_step", F.length("c.data").cast("bigint").alias("size"), "c.is_dense", names.alias("fields"))


def q53_compressed_messages(spark, sf_dir):
    """Messages to compressed ones (values in ticks of 0.01) and back: their points again."""

    def packed(raw):
        return cdr.to_compressed(raw, planner.apply_profile(cdr.header_of(cdr.decode(raw)), {"value": RES}))

    own = event_messages(spark, sf_dir).withColumn("schema_name", F.lit(CLOUD))
    made = tables.convert_messages(own, CLOUD, packed)
    back = tables.convert_messages(made, CLOUD, cdr.from_compressed)
    fields = tables.parse_clouds(F.col("data")).alias("c")
    step = 12

    @F.arrow_udf("struct<ticks:long,users:long>")
    def sums(data: pa.Array) -> pa.Array:
        kind, rows = np.dtype([("value", "<f8"), ("user", "<i4")]), []
        for raw in data.to_pylist():
            points = np.frombuffer(raw, kind)
            rows.append({"ticks": int(np.rint(points["value"] / np.float64(np.float32(RES))).sum()), "users": int(points["user"].sum(dtype=np.int64))})
        return pa.array(rows, pa.struct([("ticks", pa.int64()), ("users", pa.int64())]))

    read = back.select("event_type", "chunk", fields).select("event_type", "chunk", "c.width", (F.col("c.point_step") == step).alias("packed"), sums(F.col("c.data")).alias("s"))
    return read.select("event_type", "chunk", "width", "packed", "s.ticks", "s.users")


def q54_display_messages(spark, sf_dir):
    """Vectors of a label as a message, converted for display: a point a voxel of 0.1, by the packed key."""
    fields, step = packed_fields([(n, FieldType.FLOAT32, None) for n in "xyz"])

    def run(key, held):
        held = held.sort_by("idx")
        points = np.zeros(held.num_rows, Header(fields, point_step=step).dtype())
        for n in "xyz":
            points[n] = held.column(n).to_numpy()
        raw = cdr.encode(cdr.Cloud(0, 0, "", 1, len(points), fields, False, step, step * len(points), points.tobytes(), True))
        made = cdr.to_compressed(raw, planner.apply_profile(cdr.header_of(cdr.decode(raw)), {}, 0.1), visual=True)
        back = cdr.decode(cdr.from_compressed(made))
        return pa.table({"label": key[:1], "points": pa.array([len(points)], pa.int64()), "kept": pa.array([back.width], pa.int64()), "kept_bytes": pa.array([len(back.data)], pa.int64())})

    own = xyz(spark, sf_dir).join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("idx"), F.col("label").cast("bigint").alias("label")), "idx")
    return own.groupBy("label").applyInArrow(run, "label long, points long, kept long, kept_bytes long")


def q55_blob_headers(spark, sf_dir):
    """Blobs written as files; their headers read from the files' beginnings, and the headers' text parsed."""
    df = event_points(spark, sf_dir, "event_id", "value", "user_id")
    header = event_header(df)
    blob = tables.blobs(tables.encode_chunks(df, header), header).select(F.concat(F.col("cloud").cast("string"), F.lit(".cldn")).alias("name"), F.col("blob").alias("content"))
    folder = storage.new_path(spark, "blobs")
    tables.save_files(blob, folder)

    @F.arrow_udf("struct<width:long,point_step:long,fields:string>")
    def parsed(texts: pa.Array) -> pa.Array:
        rows = []
        for h in map(from_yaml, texts.to_pylist()):
            rows.append({"width": h.width, "point_step": h.point_step, "fields": ",".join(f"{f.name}:{f.type.name}" for f in h.fields)})
        return pa.array(rows, pa.struct([("width", pa.int64()), ("point_step", pa.int64()), ("fields", pa.string())]))

    read = tables.read_blob_headers(spark, folder).select(F.regexp_extract("path", r"(\d+)\.cldn$", 1).cast("bigint").alias("cloud"), parsed(F.col("header")).alias("h"))
    return read.select("cloud", "h.width", "h.point_step", "h.fields")


def q56_pcd_files(spark, sf_dir):
    """A PCD text file a label, written and read again."""
    df = xyz(spark, sf_dir).join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("idx"), "label"), "idx")
    line = F.concat_ws(" ", *[F.col(n).cast("string") for n in "xyz"], F.col("idx").cast("string"))
    rows = df.groupBy("label").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("idx", line.alias("line")))).alias("points"))
    head = F.concat(F.lit("VERSION .7\nFIELDS x y z id\nSIZE 4 4 4 8\nTYPE F F F I\nCOUNT 1 1 1 1\nWIDTH "), F.col("n").cast("string"), F.lit("\nHEIGHT 1\nPOINTS "), F.col("n").cast("string"), F.lit("\nDATA ascii\n"))
    made = rows.select(F.concat(F.col("label").cast("string"), F.lit(".pcd")).alias("name"), F.concat(head, F.array_join("points.line", "\n"), F.lit("\n")).cast("binary").alias("content"))
    folder = storage.new_path(spark, "pcd")
    tables.save_files(made, folder)
    fields, step = packed_fields([(n, FieldType.FLOAT32, None) for n in "xyz"] + [("id", FieldType.INT64, None)])
    read = tables.read_pcd(spark, folder, Header(fields, point_step=step))
    return read.select(F.regexp_extract("path", r"(-?\d+)\.pcd$", 1).cast("bigint").alias("label"), "idx", "id", *[F.round(F.col(n).cast("double"), 5).alias(n) for n in "xyz"])


def q57_containers(spark, sf_dir):
    """Events as messages of containers, written by a task each and read again by chunks: topics, schemas, messages, bytes."""
    tables.register(spark)
    topics = [r[0] for r in table(spark, sf_dir, "events").select("event_type").distinct().orderBy("event_type").collect()]  # topics of a container
    box = mcap.Container([mcap.Schema(1, "even"), mcap.Schema(2, "odd")], [mcap.Channel(k + 1, 1 + k % 2, t) for k, t in enumerate(topics)])
    number = F.create_map(*[F.lit(x) for k, t in enumerate(topics) for x in (t, k + 1)])
    own = table(spark, sf_dir, "events").select(F.concat(F.pmod("event_id", F.lit(3)).cast("string"), F.lit(".mcap")).alias("path"), F.lit(0).alias("chunk"), F.col("event_id").alias("ordinal"), number[F.col("event_type")].alias("channel_id"), F.pmod("event_id", F.lit(1000)).alias("sequence"), micros().alias("log_time"), micros().alias("publish_time"), F.col("props").cast("binary").alias("data"))
    folder = storage.new_path(spark, "containers")
    dealt = own.repartition("path").sortWithinPartitions("path", "ordinal")
    dealt.write.format("pointweave_mcap").option("definitions", datasource.definitions_json(box)).mode("append").save(folder)
    read = spark.read.format("pointweave_mcap").option("path", folder).load()
    channels = tables.read_mcap(spark, folder, "channels").select("path", F.col("id").alias("channel_id"), "schema_id", "topic")
    schemas = tables.read_mcap(spark, folder, "schemas").select("path", F.col("id").alias("schema_id"), F.col("name").alias("schema_name"))
    file = F.regexp_extract("path", r"([^/]+)$", 1).alias("file")
    named = channels.join(schemas, ["path", "schema_id"]).select(file, "channel_id", "topic", "schema_name")
    found = read.groupBy(file, "channel_id").agg(F.count("*").alias("messages"), F.sum(F.length("data")).alias("bytes"), F.min("log_time").alias("first"), F.sum("sequence").alias("sequences"))
    return found.join(named, ["file", "channel_id"]).select("file", "topic", "schema_name", "messages", "bytes", "first", "sequences")


def q58_stream_reports(spark, sf_dir):
    """Events as a stream, converted (here cut to eight bytes, odd users an error) and reported on every 20 messages of a topic;
    the first report has one."""
    from pointweave.streaming import convert

    own = table(spark, sf_dir, "events").select("event_type", "event_id", F.concat(F.pmod("user_id", F.lit(2)).cast("string"), F.col("props")).cast("binary").alias("data"))
    given, out, state = (storage.new_path(spark, n) for n in ("arrivals", "reports", "state"))
    own.write.parquet(given)  # all files are one batch, which is taken in order

    def half(raw):
        if raw[:1] == b"1":
            raise ValueError("odd")
        return raw[:8]

    made = convert.convert(spark.readStream.schema(own.schema).parquet(given), half)
    convert.start(convert.reports(made, "event_type", "event_id", out=F.coalesce("out_bytes", F.lit(0).cast("bigint"))), out, state).awaitTermination()
    return spark.read.parquet(out).select("topic", "report", "messages", "raw_bytes", "out_bytes", F.round("ratio", 6).alias("ratio"))


def q59_versions_and_encodings(spark, sf_dir):
    """Vectors of a label through blobs of every version and encoding, with as many leading floats as four: bytes of the points,
    and whether they come back as near as the encoding promises; a header in binary form too."""
    kinds = [(n, FieldType.FLOAT32, 0.01) for n in "xyz"] + [("w", FieldType.FLOAT32, None), ("id", FieldType.INT64, None), ("low", FieldType.UINT8, None), ("t", FieldType.FLOAT64, None)]
    fields, step = packed_fields(kinds)

    def run(key, held):
        held, rows = held.sort_by("idx"), []
        points = np.zeros(held.num_rows, Header(fields, point_step=step).dtype())
        for n in "xyz":
            points[n] = held.column(n).to_numpy()
        points["w"], points["id"] = points["x"], held.column("idx").to_numpy()
        points["low"], points["t"] = points["id"] % 256, points["id"] / 8
        for version in (2, 3, 4, 5):
            for encoding in Encoding:
                header = Header(fields, len(points), 1, step, encoding, Compression.NONE, version=version)
                read, back = binary.decode_blob(binary.encode_blob(header, points, text=version > 3))
                near = [np.abs(back[n] - points[n]).max() <= (0.00502 if encoding == Encoding.LOSSY else 0) for n in "xyz"]
                same = [np.array_equal(back[n], points[n]) for n in ("w", "id", "low", "t")]
                rows.append({"label": key[0].as_py(), "version": read.version, "encoding": read.encoding.name, "points": len(back), "kept": bool(all(near + same))})
        return pa.Table.from_pylist(rows, pa.schema([("label", pa.int64()), ("version", pa.int64()), ("encoding", pa.string()), ("points", pa.int64()), ("kept", pa.bool_())]))

    own = xyz(spark, sf_dir).join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("idx"), F.col("label").cast("bigint").alias("label")), "idx")
    return own.groupBy("label").applyInArrow(run, "label long, version long, encoding string, points long, kept boolean")


def q60_sql_functions(spark, sf_dir):
    """The codec's functions in SQL over messages: sizes, headers, points and messages again."""
    sqlfuncs.register(spark)
    own = event_messages(spark, sf_dir).withColumn("packed", F.expr("pw_encode_message(data, 'value: 0.01')"))
    again = own.selectExpr(
        "event_type", "chunk", "pw_decompressed_size(packed) AS size", "cast(length(pw_decode_message(packed)) AS bigint) AS points_bytes",
        "regexp_extract(pw_message_header(packed), 'width: ([0-9]+)', 1) AS width", "cast(length(pw_message_to_message(packed)) AS bigint) AS message_bytes",
        "pw_compressed_size(packed) BETWEEN 1 AND length(packed) AS fits", "pw_message_header(data) IS NULL AS refused",
    )
    return again.withColumn("width", F.col("width").cast("bigint"))


def q61_bit_packing(spark, sf_dir):
    """Indexes into a chunk's distinct values, packed side by side, and unpacked again."""

    def run(key, held):
        values = held.sort_by("idx").column("v").to_numpy()
        found, codes = binary.first_seen(values)
        bits = binary.bits_of(len(found))
        raw = binary.pack(codes, bits)
        whole = np.array_equal(found[binary.unpack(raw, bits, len(codes))], values)
        return pa.table({"event_type": [key[0].as_py()], "chunk": pa.array([key[1].as_py()], pa.int64()), "bits": pa.array([bits], pa.int64()), "bytes": pa.array([len(raw)], pa.int64()), "whole": [bool(whole)]})

    own = events(spark, sf_dir, "user_id").withColumn("v", F.col("user_id") % 37)
    return own.groupBy("event_type", "chunk").applyInArrow(run, "event_type string, chunk long, bits long, bytes long, whole boolean")


def q62_scalar_texts(spark, sf_dir):
    """Header texts and scalars written by SQL and read by the parser: types by name, numbers, nulls, quotes and comments."""
    names = F.array(*[F.lit(t.name) for t in FieldType if t])
    kind = F.element_at(names, (F.col("n_nationkey") % 10 + 1).cast("int"))
    resolution = F.when(F.col("n_nationkey") % 3 == 0, "null").otherwise(F.concat(F.lit("0."), (F.col("n_nationkey") + 1).cast("string")))
    text = F.concat_ws("\n", F.lit("version: 5 # the newest"), F.concat(F.lit("width: "), F.col("n_nationkey").cast("string")), F.lit("height: 1"), F.lit("point_step: 8"), F.lit("encoding_opt: 'LOSSY'"), F.lit("compression_opt: 2"), F.lit("fields:"), F.concat(F.lit('  - name: "'), F.col("n_name"), F.lit('"')), F.lit("    offset: 0"), F.concat(F.lit("    type: "), kind), F.concat(F.lit("    resolution: "), resolution))

    @F.arrow_udf("struct<width:long,compression:string,name:string,type:string,resolution:double>")
    def parsed(texts: pa.Array) -> pa.Array:
        rows = [(h, h.fields[0]) for h in map(from_yaml, texts.to_pylist())]
        found = [{"width": h.width, "compression": h.compression.name, "name": f.name, "type": f.type.name, "resolution": f.resolution} for h, f in rows]
        return pa.array(found, pa.struct([("width", pa.int64()), ("compression", pa.string()), ("name", pa.string()), ("type", pa.string()), ("resolution", pa.float64())]))

    own = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("id"), parsed(text).alias("h"))
    return own.select("id", "h.width", "h.compression", "h.name", "h.type", F.round("h.resolution", 6).alias("resolution"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: f for name, f in list(globals().items()) if name[:1] == "q" and name[1:3].isdigit()}
