"""WARC archives and a normaliser of monolithic gzip files.

``write_archives`` writes a record per row, each partition as one file that is a single gzip stream, as many crawlers
leave them. ``normalise`` inflates such a stream once, front to back, and writes each record as a gzip member of its own,
beside a sidecar index of (offset, length, type, target, id), one JSON line per record. ``read_archives`` then reads
records by the index alone, member by member.

Of records with equal payloads of at least ``min_bytes`` the one with the least id is a response and holds the payload;
the others are revisits that refer to it and hold none. Equal payloads meet by SHA-1: digests with more than one record
are found with map-side combining and are broadcast while they are few (counted), joined beyond that, where AQE splits
a digest that many rows share.

Defined results: a null payload is an empty one. A null id is greater than every other and is null again when read; if a
digest's ids are all null, all its records are responses. Rows that repeat the least id of a payload are responses too. A
null URI is written as ``urn:pointweave:none``. Only the three columns named are read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointweave.llm.files import Folder, own_name
from pointweave.storage import drop_written, new_path, written

GZIP, CHUNK = 31, 1 << 18
MANIFEST = "folder string, name string, n_records bigint"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, uri: str | None, payload: bytes, sha1: str, refers_to: int | None) -> bytes:
    """A WARC/1.1 record. A revisit keeps the payload's digest and length in its header."""
    uri = "".join(c for c in (uri or "urn:pointweave:none") if c >= " " and c != "\x7f")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:pointweave:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{sha1}", f"X-Payload-Length: {len(payload)}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:pointweave:page:{refers_to}>"]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    body = http + (payload if refers_to is None else b"")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def fields(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def inflated(file) -> Iterator[bytes]:
    """The bytes of a gzip file, whatever its members."""
    press = zlib.decompressobj(GZIP)
    while raw := file.read(CHUNK):
        while raw:
            if out := press.decompress(raw):
                yield out
            raw = press.unused_data
            if press.eof:
                press = zlib.decompressobj(GZIP)


def records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """The header and all bytes of each record of a stream; a record at a time is in memory."""
    held = bytearray()
    for piece in pieces:
        held += piece
        while (end := held.find(b"\r\n\r\n")) >= 0:
            head = fields(bytes(held[:end]))
            size = end + 4 + int(head["content-length"]) + 4
            if len(held) < size:
                for more in pieces:
                    held += more
                    if len(held) >= size:
                        break
                else:
                    raise ValueError("a record is cut off")
            yield head, bytes(held[:size])
            del held[:size]
    if held:
        raise ValueError("a record is cut off")


def press(raw: bytes, level: int) -> bytes:
    one = zlib.compressobj(level, zlib.DEFLATED, GZIP)
    return one.compress(raw) + one.flush()


def normalise_file(file, out, index, level: int = 6) -> int:
    """One gzip stream to a member per record in ``out`` and a line per record in ``index``; the number of records."""
    at = n = 0
    for head, raw in records(inflated(file)):
        member = press(raw, level)
        out.write(member)
        line = {"offset": at, "length": len(member), "type": head["warc-type"], "target": head.get("warc-target-uri"), "id": head["warc-record-id"]}
        index.write(json.dumps(line).encode() + b"\n")
        at += len(member)
        n += 1
    return n


def page_of(urn: str | None) -> int | None:
    number = (urn or "").strip("<>").rpartition(":")[2]
    return int(number) if number else None


def parsed(raw: bytes) -> dict:
    """A record's row. A response's payload is measured and hashed anew and must have the digest of its header."""
    head_end = raw.index(b"\r\n\r\n")
    head = fields(raw[:head_end])
    body = raw[head_end + 4 : head_end + 4 + int(head["content-length"])]
    payload, sha1, size = body[body.index(b"\r\n\r\n") + 4 :], head["warc-payload-digest"].removeprefix("sha1:"), int(head["x-payload-length"])
    if head["warc-type"] == "response" and (digest(payload) != sha1 or len(payload) != size):
        raise ValueError(f"{head['warc-record-id']} isn't what was written")
    refers = page_of(head["warc-refers-to"]) if "warc-refers-to" in head else None
    return {"page_id": page_of(head["warc-record-id"]), "payload_bytes": size, "payload_digest": sha1, "record_type": head["warc-type"], "refers_to": refers, "url": head["warc-target-uri"], "payload": payload if head["warc-type"] == "response" else None}


# Spark


def manifest_rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(("folder", "name", "n_records"), r, strict=True)) for r in rows], pa.schema([("folder", pa.string()), ("name", pa.string()), ("n_records", pa.int64())]))


def listed(df: DataFrame) -> DataFrame:
    """A stage's manifest, a row per file, dealt out a file to a task."""
    held = written(df, "manifest")
    rows = [tuple(r) for r in held.collect()]
    drop_written(held)
    return df.sparkSession.createDataFrame(rows, MANIFEST).repartition(max(1, len(rows)))


def write_archives(pages: DataFrame, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", *, min_bytes: int = 0, folder: str | None = None, broadcast_rows: int = 200_000, level: int = 1) -> DataFrame:
    """Each partition to one monolithic gzip file; the manifest."""
    folder = folder or new_path(pages.sparkSession, "warc")
    rows = pages.select(F.col(id_col).cast("bigint").alias("id"), F.col(uri_col).cast("string").alias("uri"), F.coalesce(F.encode(F.col(payload_col).cast("string"), "utf-8"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload"))
    small = rows.select("sha1", "id", F.length("payload").alias("size")).where(F.col("size") >= min_bytes)
    many = written(small.groupBy("sha1").agg(F.count("*").alias("n"), F.min("id").alias("first")).where("n > 1").select("sha1", "first"), "payloads")
    few = many.limit(broadcast_rows + 1).count() <= broadcast_rows  # 60 bytes each
    many = many.withColumnRenamed("sha1", "sha1_of")
    joined = rows.join(F.broadcast(many) if few else many, (F.col("sha1") == F.col("sha1_of")) & (F.length("payload") >= min_bytes), "left")
    joined = joined.select("id", "uri", "payload", F.when(F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, out, n = own_name("whole") + ".warc.gz", None, 0
        one = zlib.compressobj(level, zlib.DEFLATED, GZIP)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                for r in batch.slice(at, 64).to_pylist():
                    if out is None:
                        out = Folder(folder).write(name)
                    out.write(one.compress(record(r["id"], r["uri"], r["payload"], digest(r["payload"]), r["refers_to"])))
                    n += 1
        if out is not None:
            out.write(one.flush())
            out.close()
            yield manifest_rows([(folder, name, n)])

    return listed(joined.mapInArrow(run, MANIFEST))


def normalise(manifest: DataFrame, *, level: int = 6, delete_source: bool = False) -> DataFrame:
    """Every file of the manifest to members, with a sidecar index; the new manifest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                folder, name = Folder(row["folder"]), own_name("members")
                with folder.stream(row["name"]) as file, folder.write(f"{name}.warc.gz") as out, folder.write(f"{name}.idx") as index:
                    n = normalise_file(file, out, index, level)
                yield manifest_rows([(row["folder"], name, n)])

    out = listed(manifest.mapInArrow(run, MANIFEST))
    if delete_source:  # after all files are normalised, so that a lost task finds its source
        for r in manifest.select("folder", "name").distinct().collect():
            Folder(r["folder"]).delete(r["name"])
    return out


RECORDS = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())])


def read_archives(manifest: DataFrame, *, payloads: bool = True) -> DataFrame:
    """A row per record, each member opened by its place in the index."""
    kinds = RECORDS if payloads else pa.schema([f for f in RECORDS if f.name != "payload"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                folder, rows, held = Folder(row["folder"]), [], 0
                with folder.read(f"{row['name']}.warc.gz") as file, folder.stream(f"{row['name']}.idx") as index:
                    for line in lines(index):
                        at = json.loads(line)
                        rows.append(parsed(zlib.decompress(file.read_at(at["length"], at["offset"]), GZIP)))
                        held += len(rows[-1]["payload"] or b"") if payloads else 0
                        if len(rows) >= 4096 or held > CHUNK * 32:
                            yield pa.RecordBatch.from_pylist(rows, kinds)
                            rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, kinds)

    return manifest.select("folder", "name").mapInArrow(run, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string" + ", payload binary" * payloads)


def lines(file) -> Iterator[bytes]:
    rest = b""
    while piece := file.read(CHUNK):
        *whole, rest = (rest + piece).split(b"\n")
        yield from whole
    if rest:
        yield rest
