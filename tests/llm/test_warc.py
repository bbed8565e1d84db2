import base64
import gzip
import hashlib
import io
import json
import zlib

import pytest

from pointweave.llm import queries, warc
from pointweave.llm.files import Folder


def pages_of(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 3) for i, u, h in rows], "page_id long, url string, html string, sha1 string, first long")


ROWS = [(1, "http://a/é", "<p>one</p>"), (2, "http://b", "<p>one</p>"), (3, None, None), (4, "http://d\r\nX: y", ""), (5, "u", "WARC/1.1\r\n\r\n\r\nContent-Length: 9\r\n\r\n"), (6, "u", "long " * 300_000), (7, "u", "<p>one</p>"), (7, "u", "<p>one</p>"), (None, "u", "<p>one</p>"), (None, "u", "only nulls"), (None, "u", "only nulls"), (8, "u", "é中😀"), (1, "u", "<p>one</p>")]


def brute(rows):
    payloads = [(i, (h or "").encode()) for i, _, h in rows]
    first = {}
    for i, p in payloads:
        if i is not None:
            first[p] = min(first.get(p, i), i)
    out = []
    for i, p in payloads:
        least = first.get(p)
        refers = least if least is not None and least != i else None
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=str)


@pytest.mark.parametrize("broadcast_rows", [1000, 0])
def test_round_trip(spark, broadcast_rows):
    whole = warc.write_archives(pages_of(spark, ROWS).repartition(3), broadcast_rows=broadcast_rows)
    found = warc.read_archives(warc.normalise(whole)).collect()
    assert sorted((tuple(r)[:5] for r in found), key=str) == brute(ROWS)
    assert all(bytes(r["payload"]) in {(h or "").encode() for _, _, h in ROWS} for r in found if r["record_type"] == "response")
    again = warc.read_archives(warc.normalise(whole, delete_source=True), payloads=False).collect()
    assert sorted((tuple(r)[:5] for r in again), key=str) == brute(ROWS)


def test_empty(spark):
    assert warc.read_archives(warc.normalise(warc.write_archives(pages_of(spark, [])))).collect() == []


def test_members_and_index():
    records = [warc.record(k, "u", (b"x" * k * 100), warc.digest(b"x" * k * 100), None) for k in range(30)]
    out, index = io.BytesIO(), io.BytesIO()
    assert warc.normalise_file(io.BytesIO(gzip.compress(b"".join(records))), out, index) == 30
    lines = [json.loads(x) for x in index.getvalue().splitlines()]
    for raw, line in zip(records, lines, strict=True):
        assert zlib.decompress(out.getvalue()[line["offset"] : line["offset"] + line["length"]], 31) == raw
    assert gzip.decompress(out.getvalue()) == b"".join(records)
    # of members already: the same
    again = io.BytesIO()
    warc.normalise_file(io.BytesIO(out.getvalue()), again, io.BytesIO())
    assert again.getvalue() == out.getvalue()


def test_cut_off():
    raw = gzip.compress(warc.record(1, "u", b"abc", warc.digest(b"abc"), None)[:-3])
    with pytest.raises(ValueError, match="cut off"):
        warc.normalise_file(io.BytesIO(raw), io.BytesIO(), io.BytesIO())


def test_changed_payload():
    raw = warc.record(1, "u", b"abc", warc.digest(b"abd"), None)
    with pytest.raises(ValueError, match="written"):
        warc.parsed(raw)


def test_folder(tmp_path):
    folder = Folder(f"file://{tmp_path}/new")
    with folder.write("a.gz") as f:
        f.write(b"plain")
    assert folder.stream("a.gz").read() == b"plain"
    folder.delete("a.gz")
    assert not list((tmp_path / "new").iterdir())


def test_query(spark, sf_dir):
    rows = [(r["page_id"], r["url"], r["html"]) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    assert sorted((tuple(r) for r in queries.op4_warc(spark, sf_dir).collect()), key=str) == brute(rows)
