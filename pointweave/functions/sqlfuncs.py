"""Functions for SQL: the codec's entry points. Input that can't be read gives null, or size 0."""

from __future__ import annotations

from dataclasses import replace
from inspect import signature

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from pointweave.functions import binary
from pointweave.functions.text import from_yaml, parse_profile, to_yaml
from pointweave.plans import planner
from pointweave.sources import cdr


def quiet(function, default=None):
    def run(*args):
        if any(a is None for a in args):
            return default
        try:
            return function(*args)
        except (ValueError, KeyError, OverflowError):
            return default

    run.columns = len(signature(function).parameters)
    return run


def blob_header(raw) -> str:
    return to_yaml(binary.decode_header(bytes(raw))[0], exact=True)


def message_header(raw) -> str:
    return blob_header(cdr.decode(bytes(raw), compressed=True).data)


def compressed_size(raw) -> int:
    """Of a compressed message's blob."""
    return len(cdr.decode(bytes(raw), compressed=True).data)


def decompressed_size(raw) -> int:
    header, _ = binary.decode_header(cdr.decode(bytes(raw), compressed=True).data)
    return header.points * header.point_step


def decode_data(raw) -> bytes:
    return binary.decode_blob(bytes(raw))[1].tobytes()


def decode_message(raw) -> bytes:
    """A compressed message's points."""
    return decode_data(cdr.decode(bytes(raw), compressed=True).data)


def message_to_message(raw) -> bytes:
    return cdr.from_compressed(bytes(raw), format=None)


def encode_message(raw, profile: str) -> bytes:
    """A cloud message to a compressed one, by a resolution profile."""
    cloud = cdr.decode(bytes(raw))
    header = planner.apply_profile(cdr.header_of(cloud), parse_profile(profile))
    return cdr.to_compressed(bytes(raw), header)


def encode_data(raw, header: str) -> bytes:
    """Points to a blob, by a header's text; the number of points is the data's."""
    own = from_yaml(header)
    if own.point_step == 0:
        raise ValueError("point_step is 0")
    raw = bytes(raw)
    if own.points * own.point_step != len(raw):
        own = replace(own, width=len(raw) // own.point_step, height=1)
    return binary.encode_blob(own, raw)


FUNCTIONS = {
    "pw_blob_header": (blob_header, "string", None),
    "pw_message_header": (message_header, "string", None),
    "pw_compressed_size": (compressed_size, "long", 0),
    "pw_decompressed_size": (decompressed_size, "long", 0),
    "pw_decode_data": (decode_data, "binary", None),
    "pw_decode_message": (decode_message, "binary", None),
    "pw_message_to_message": (message_to_message, "binary", None),
    "pw_encode_message": (encode_message, "binary", None),
    "pw_encode_data": (encode_data, "binary", None),
}


def in_batches(function, kind: str):
    """An Arrow function of one or two columns."""
    arrow = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[kind]

    @F.arrow_udf(kind)
    def one(a: pa.Array) -> pa.Array:
        return pa.array([function(x) for x in a.to_pylist()], arrow)

    @F.arrow_udf(kind)
    def two(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([function(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], arrow)

    return two if function.columns == 2 else one


def register(spark: SparkSession) -> list[str]:
    """Register all; their names."""
    for name, (function, kind, default) in FUNCTIONS.items():
        spark.udf.register(name, in_batches(quiet(function, default), kind))
    return list(FUNCTIONS)
