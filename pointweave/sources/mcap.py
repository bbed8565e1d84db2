"""MCAP containers, by the public specification: reading through the index or front to back, and writing in chunks."""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import zstandard

from pointweave.functions.binary import Broken

MAGIC = b"\x89MCAP0\r\n"
#: Opcodes.
HEADER, FOOTER, SCHEMA, CHANNEL, MESSAGE, CHUNK, CHUNK_INDEX, ATTACHMENT, STATISTICS, METADATA, DATA_END = 1, 2, 3, 4, 5, 6, 8, 9, 11, 12, 15


@dataclass
class Schema:
    id: int
    name: str
    encoding: str = "ros2msg"
    data: bytes = b""


@dataclass
class Channel:
    id: int
    schema_id: int
    topic: str
    message_encoding: str = "cdr"
    metadata: dict[str, str] = field(default_factory=dict)


@dataclass
class Message:
    channel_id: int
    sequence: int
    log_time: int
    publish_time: int
    data: bytes


@dataclass
class Container:
    schemas: list[Schema] = field(default_factory=list)
    channels: list[Channel] = field(default_factory=list)
    metadata: list[tuple[str, dict[str, str]]] = field(default_factory=list)
    attachments: list[tuple[int, int, str, str, bytes]] = field(default_factory=list)
    profile: str = ""


class Body:
    def __init__(self, raw: bytes):
        self.raw, self.at = raw, 0

    def number(self, code: str) -> int:
        size = struct.calcsize("<" + code)
        if self.at + size > len(self.raw):
            raise Broken("a record is cut off")
        self.at += size
        return struct.unpack_from("<" + code, self.raw, self.at - size)[0]

    def block(self, code: str = "I") -> bytes:
        n = self.number(code)
        if self.at + n > len(self.raw):
            raise Broken("a record is cut off")
        self.at += n
        return self.raw[self.at - n : self.at]

    def text(self) -> str:
        return self.block().decode()

    def texts(self) -> dict[str, str]:
        inner, out = Body(self.block()), {}
        while inner.at < len(inner.raw):
            key = inner.text()
            out[key] = inner.text()
        return out


def records(raw: bytes, at: int = 0, end: int | None = None) -> Iterator[tuple[int, bytes]]:
    end = len(raw) if end is None else end
    while at < end:
        if at + 9 > end:
            raise Broken("a record is cut off")
        op, size = struct.unpack_from("<BQ", raw, at)
        if at + 9 + size > end:
            raise Broken("a record is cut off")
        yield op, raw[at + 9 : at + 9 + size]
        at += 9 + size


def inflated(kind: str, raw: bytes, size: int) -> bytes:
    if kind == "zstd":
        return zstandard.ZstdDecompressor().decompressobj().decompress(raw)
    if kind == "lz4":
        return pa.Codec("lz4").decompress(raw, size, asbytes=True)
    if kind:
        raise Broken(f"compression {kind} isn't known")
    return raw


def body_of_chunk(raw: bytes) -> bytes:
    b = Body(raw)
    b.number("Q"), b.number("Q")
    size, crc, kind = b.number("Q"), b.number("I"), b.text()
    out = inflated(kind, b.block("Q"), size)
    if len(out) != size or crc and zlib.crc32(out) != crc:
        raise Broken("a chunk isn't what was written")
    return out


def all_records(raw: bytes) -> Iterator[tuple[int, bytes]]:
    """Front to back, chunks opened."""
    if raw[:8] != MAGIC:
        raise Broken("not an MCAP file")
    end = len(raw) - 8 if raw[-8:] == MAGIC else len(raw)
    for op, body in records(raw, 8, end):
        if op == CHUNK:
            yield from records(body_of_chunk(body))
        elif op in (DATA_END, FOOTER):
            return
        else:
            yield op, body


def schema_of(raw: bytes) -> Schema:
    b = Body(raw)
    return Schema(b.number("H"), b.text(), b.text(), b.block())


def channel_of(raw: bytes) -> Channel:
    b = Body(raw)
    return Channel(b.number("H"), b.number("H"), b.text(), b.text(), b.texts())


def message_of(raw: bytes) -> Message:
    channel, sequence, log, publish = struct.unpack_from("<HIQQ", raw)
    return Message(channel, sequence, log, publish, raw[22:])


class Definitions:
    """Gathers all but messages from records; repeated schemas and channels once."""

    def __init__(self):
        self.schemas: dict[int, Schema] = {}
        self.channels: dict[int, Channel] = {}
        self.box = Container()

    def add(self, op: int, body: bytes) -> None:
        if op == HEADER:
            self.box.profile = Body(body).text()
        elif op == SCHEMA:
            self.schemas.setdefault((s := schema_of(body)).id, s)
        elif op == CHANNEL:
            self.channels.setdefault((c := channel_of(body)).id, c)
        elif op == METADATA:
            b = Body(body)
            self.box.metadata.append((b.text(), b.texts()))
        elif op == ATTACHMENT:
            b = Body(body)
            self.box.attachments.append((b.number("Q"), b.number("Q"), b.text(), b.text(), b.block("Q")))

    def done(self) -> Container:
        self.box.schemas = [self.schemas[k] for k in sorted(self.schemas)]
        self.box.channels = [self.channels[k] for k in sorted(self.channels)]
        return self.box


def read(raw: bytes) -> tuple[Container, list[Message]]:
    """All of a file."""
    found, messages = Definitions(), []
    for op, body in all_records(raw):
        if op == MESSAGE:
            messages.append(message_of(body))
        else:
            found.add(op, body)
    return found.done(), messages


def read_definitions(read_at, size: int) -> Container:
    """All but the messages, a record at a time. Of chunks only those are opened that come before any schema or channel is
    known from elsewhere. read_at(n, place) reads a part of the file."""
    if size < 8 or read_at(8, 0) != MAGIC:
        raise Broken("not an MCAP file")
    found, at, chunks = Definitions(), 8, []
    end = size - 8 if size >= 16 and read_at(8, size - 8) == MAGIC else size
    while at + 9 <= end:
        op, n = struct.unpack("<BQ", read_at(9, at))
        if at + 9 + n > end:
            raise Broken("a record is cut off")
        if op == CHUNK:
            chunks.append((at, n))
        elif op in (HEADER, SCHEMA, CHANNEL, METADATA, ATTACHMENT):
            found.add(op, read_at(n, at + 9))
        at += 9 + n
    if not found.channels:  # without a summary they are in the chunks alone
        for at, n in chunks:
            for op, body in records(body_of_chunk(read_at(n, at + 9))):
                if op in (SCHEMA, CHANNEL):
                    found.add(op, body)
    return found.done()


def chunk_ranges(read_at, size: int) -> list[tuple[int, int]] | None:
    """(place, bytes) of each chunk from the summary, None without one. read_at(n, place) reads a part of the file."""
    if size < 45 or read_at(8, size - 8) != MAGIC:
        return None
    op, n = struct.unpack("<BQ", read_at(9, size - 37))
    if op != FOOTER or n != 20:
        return None
    summary = struct.unpack_from("<Q", read_at(20, size - 28))[0]
    if not summary:
        return None
    out = []
    for op, body in records(read_at(size - 37 - summary, summary)):
        if op == CHUNK_INDEX:
            b = Body(body)
            b.number("Q"), b.number("Q")
            out.append((b.number("Q"), b.number("Q")))
    return out or None


def record(op: int, body: bytes) -> bytes:
    return struct.pack("<BQ", op, len(body)) + body


def text(value: str) -> bytes:
    raw = value.encode()
    return struct.pack("<I", len(raw)) + raw


def texts(value: dict[str, str]) -> bytes:
    raw = b"".join(text(k) + text(v) for k, v in value.items())
    return struct.pack("<I", len(raw)) + raw


class Writer:
    """Writes a container to ``out`` (anything with write) a message at a time: schemas and channels in ascending order first,
    messages in chunks of about ``chunk_bytes``, then a summary. Holds a chunk and a row of the index for each chunk."""

    def __init__(self, out, container: Container, *, compression: str = "zstd", chunk_bytes: int = 2 << 20):
        self.out, self.box, self.compression, self.chunk_bytes = out, container, compression, chunk_bytes
        self.at, self.index, self.held, self.times = 0, [], bytearray(), []
        schemas, channels = sorted(container.schemas, key=lambda s: s.id), sorted(container.channels, key=lambda c: c.id)
        self.known = {c.id for c in channels}
        self.defined = b"".join(record(SCHEMA, struct.pack("<H", s.id) + text(s.name) + text(s.encoding) + struct.pack("<I", len(s.data)) + s.data) for s in schemas)
        self.defined += b"".join(record(CHANNEL, struct.pack("<HH", c.id, c.schema_id) + text(c.topic) + text(c.message_encoding) + texts(c.metadata)) for c in channels)
        self.put(MAGIC + record(HEADER, text(container.profile) + text("pointweave")) + self.defined)

    def put(self, raw: bytes) -> None:
        self.out.write(raw)
        self.at += len(raw)

    def add(self, m: Message) -> None:
        if m.channel_id not in self.known:
            raise ValueError(f"channel {m.channel_id} isn't defined")
        self.held += record(MESSAGE, struct.pack("<HIQQ", m.channel_id, m.sequence, m.log_time, m.publish_time) + m.data)
        self.times.append(m.log_time)
        if len(self.held) >= self.chunk_bytes:
            self.flush()

    def flush(self) -> None:
        if not self.times:
            return
        raw, kind = bytes(self.held), self.compression
        packed = zstandard.ZstdCompressor(level=1).compress(raw) if kind == "zstd" else pa.Codec("lz4").compress(raw, asbytes=True) if kind == "lz4" else raw
        low, high, place = min(self.times), max(self.times), self.at
        self.put(record(CHUNK, struct.pack("<QQQI", low, high, len(raw), zlib.crc32(raw)) + text(kind) + struct.pack("<Q", len(packed)) + packed))
        self.index.append(record(CHUNK_INDEX, struct.pack("<QQQQ", low, high, place, self.at - place) + struct.pack("<IQ", 0, 0) + text(kind) + struct.pack("<QQ", len(packed), len(raw))))
        self.held.clear()
        self.times.clear()

    def close(self) -> None:
        self.flush()
        for log, created, name, media, data in self.box.attachments:
            body = struct.pack("<QQ", log, created) + text(name) + text(media) + struct.pack("<Q", len(data)) + data
            self.put(record(ATTACHMENT, body + struct.pack("<I", zlib.crc32(body))))
        for name, values in self.box.metadata:
            self.put(record(METADATA, text(name) + texts(values)))
        self.put(record(DATA_END, struct.pack("<I", 0)))
        summary = self.at
        self.put(self.defined + b"".join(self.index))
        self.put(record(FOOTER, struct.pack("<QQI", summary if self.defined or self.index else 0, 0, 0)) + MAGIC)


def write(container: Container, messages: list[Message], **options) -> bytes:
    """A whole container in memory; options as for Writer."""
    out = io.BytesIO()
    writer = Writer(out, container, **options)
    for m in messages:
        writer.add(m)
    writer.close()
    return out.getvalue()
