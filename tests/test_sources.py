import struct
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointweave import cli
from pointweave.functions import binary, clouds, sqlfuncs, text
from pointweave.model import Compression, Encoding, FieldType, Header, PointField, enum_of, packed_fields
from pointweave.plans import planner
from pointweave.sources import cdr, datasource, definitions, mcap, pcd, tables
from pointweave.sources.convert import Conversion

F32 = FieldType.FLOAT32


def cloud(n=100, seed=0, frame="lidar"):
    fields, step = packed_fields([("x", F32, None), ("y", F32, None), ("z", F32, None), ("ring", FieldType.UINT16, None)])
    rng = np.random.default_rng(seed)
    points = np.zeros(n, Header(fields, n, 1, step).dtype())
    for k in "xyz":
        points[k] = rng.uniform(-50, 50, n)
    points["ring"] = np.arange(n) % 16
    return cdr.Cloud(12, 34, frame, 1, n, fields, False, step, step * n, points.tobytes(), True)


def lossy(raw):
    """With ticks of a millimetre."""
    return cdr.to_compressed(raw, planner.apply_profile(cdr.header_of(cdr.decode(raw)), {}, 0.001))


def test_cdr_round_trip():
    for frame in ("", "a", "abc", "frame_id"):
        c = cloud(7, frame=frame)
        assert cdr.decode(cdr.encode(c)) == c
        d = replace(c, format="own")
        assert cdr.decode(cdr.encode(d), compressed=True) == d
    raw = cdr.encode(cloud(3))
    for cut in (0, 3, 10, 40, len(raw) - 1):
        with pytest.raises(binary.Broken):
            cdr.decode(raw[:cut])


def test_cdr_big_endian_and_alignment():
    raw = b"\0\0\0\0" + struct.pack(">iI", 1, 2) + struct.pack(">I", 2) + b"a\0" + b"\0\0" + struct.pack(">II", 1, 0) + struct.pack(">I", 0) + b"\0" + b"\0" * 3 + struct.pack(">II", 4, 0) + struct.pack(">I", 0) + b"\1"
    got = cdr.decode(raw)
    assert (got.stamp_sec, got.frame_id, got.point_step, got.is_dense) == (1, "a", 4, True)
    eight = cdr.Reader(b"\0\7\0\0" + b"\1\0\0\0" + struct.pack("<d", 2.5))  # XCDR2: eight bytes are aligned to four
    eight.number("I")
    assert eight.number("d") == 2.5


def test_messages():
    c = cloud(500)
    header = planner.apply_profile(cdr.header_of(c), {}, 0.001)
    packed = cdr.to_compressed(cdr.encode(c), header)
    back = cdr.decode(cdr.from_compressed(packed))
    a, b = (np.frombuffer(m.data, header.dtype()) for m in (c, back))
    assert np.abs(a["x"] - b["x"]).max() <= 0.00051 and np.array_equal(a["ring"], b["ring"]) and len(packed) < len(c.data)
    empty = replace(c, data=b"", width=0, row_step=0)
    assert cdr.decode(cdr.from_compressed(cdr.to_compressed(cdr.encode(empty)))).data == b""
    with pytest.raises(ValueError, match="format"):
        cdr.from_compressed(packed, format="other")
    wrong = replace(c, width=10**9)
    assert len(cdr.decode(cdr.from_compressed(cdr.to_compressed(cdr.encode(wrong), replace(header, width=10**9)))).data) == len(c.data)
    assert not cdr.is_whole(wrong) and cdr.is_whole(c)


def container(n=6):
    box = mcap.Container([mcap.Schema(2, "other", data=b"x"), mcap.Schema(1, cli.CLOUD)], [mcap.Channel(5, 1, "/lidar", metadata={"a": "b"}), mcap.Channel(3, 2, "/text"), mcap.Channel(9, 1, "/rear")], [("notes", {"k": "v"})], [(1, 2, "calib", "text/plain", b"abc")], "ros2")
    messages = []
    for k in range(n):
        messages.append(mcap.Message(5, k, 100 + k, 100 + k, cdr.encode(cloud(150, k))))
        messages.append(mcap.Message(3, k, 100 + k, 100 + k, b"hello %d" % k))
        if k % 2:
            messages.append(mcap.Message(9, k, 100 + k, 100 + k, cdr.encode(cloud(120, k))))
    return box, messages


@pytest.mark.parametrize("compression", ["zstd", "lz4", ""])
def test_mcap_round_trip(compression):
    box, messages = container()
    raw = mcap.write(box, messages, compression=compression, chunk_bytes=6000)
    got, back = mcap.read(raw)
    assert back == messages and got.schemas == sorted(box.schemas, key=lambda s: s.id) and [c.id for c in got.channels] == [3, 5, 9]
    assert got.metadata == box.metadata and got.attachments == box.attachments
    ranges = mcap.chunk_ranges(lambda n, at: raw[at : at + n], len(raw))
    assert len(ranges) > 2
    cut = mcap.read(raw[: ranges[1][0]])[1]  # without its end: front to back
    assert cut == messages[: len(cut)] and cut
    for bad in (b"", raw[: ranges[1][0] + 20]):
        with pytest.raises((binary.Broken, struct.error)):
            mcap.read(bad)
    with pytest.raises(ValueError, match="channel"):
        mcap.write(box, [mcap.Message(77, 0, 0, 0, b"")])


def test_transcoded_definitions():
    box, messages = container()
    raw = mcap.write(box, messages)
    packed = cli.transcode(raw, encode=True)[0]
    got = mcap.read(packed)[0]
    assert got.profile == "ros2" and got.metadata == box.metadata
    assert {s.name: s.data for s in got.schemas} == {"other": b"x", cli.COMPRESSED: definitions.COMPRESSED_TEXT.encode()}
    back = mcap.read(cli.transcode(packed, encode=False)[0])[0]
    assert {s.name: s.data for s in back.schemas} == {"other": b"x", cli.CLOUD: definitions.CLOUD_TEXT.encode()} and back.profile == "ros2"
    assert "uint8[] compressed_data" in definitions.COMPRESSED_TEXT and "uint8[] data " in definitions.CLOUD_TEXT
    read_at = lambda n, at: packed[at : at + n]
    assert mcap.read_definitions(read_at, len(packed)) == got
    bare = mcap.MAGIC + mcap.record(mcap.HEADER, mcap.text("p") + mcap.text(""))  # definitions in a chunk alone
    inner = mcap.record(mcap.SCHEMA, b"\1\0" + mcap.text("n") + mcap.text("e") + mcap.text("d")) + mcap.record(mcap.CHANNEL, b"\2\0\1\0" + mcap.text("/t") + mcap.text("cdr") + mcap.texts({}))
    bare += mcap.record(mcap.CHUNK, struct.pack("<QQQI", 0, 0, len(inner), 0) + mcap.text("") + struct.pack("<Q", len(inner)) + inner)
    found = mcap.read_definitions(lambda n, at: bare[at : at + n], len(bare))
    assert [c.topic for c in found.channels] == ["/t"] and found.schemas[0].data == b"d" and found.profile == "p"


def test_visual(capsys, tmp_path):
    """Non-finite points and second ones of a voxel go, in order; times get microseconds."""
    fields, step = packed_fields([("x", F32, None), ("y", F32, None), ("z", F32, None), ("t", FieldType.FLOAT64, None)])
    header = Header(fields, 7, 1, step)
    points = np.zeros(7, header.dtype())
    points["x"] = [0.0, np.nan, 1.0, 0.004, np.inf, 2.0, 1.0049]
    points["y"], points["t"] = 5.0, 1.7e9 + np.arange(7) / 8
    given = planner.apply_profile(header, {}, 0.01)
    made, kept = clouds.visual(given, points)
    assert kept["x"].tolist() == [0.0, 1.0, 2.0] and kept["t"].tolist() == [points["t"][k] for k in (0, 2, 5)]
    assert (made.width, made.height) == (3, 1) and made.fields[3].resolution == float(np.float32(1e-6))
    assert clouds.visual(header, points)[1] is points and clouds.visual(given, points[:0])[0] is given  # no geometry, no points
    keys = clouds.voxel_keys(np.array([[0.5, -0.5, 1.25]], np.float32), 1.0).tolist()
    assert keys == [(2**20 + 1) | (2**20 - 1) << 21 | (2**20 + 1) << 42]
    cloud_of = cdr.Cloud(1, 2, "f", 1, 7, fields, False, step, 7 * step, points.tobytes(), True)
    box = mcap.Container([mcap.Schema(1, cli.CLOUD)], [mcap.Channel(1, 1, "/a"), mcap.Channel(2, 1, "/b")])
    raw = mcap.write(box, [mcap.Message(1, 0, 0, 0, cdr.encode(cloud_of)), mcap.Message(2, 0, 0, 0, cdr.encode(replace(cloud_of, data=b"", width=0)))])
    got = mcap.read(cli.transcode(raw, encode=True, default=0.01, visual=True)[0])[1]
    back = cdr.decode(cdr.from_compressed(got[0].data))
    assert back.width == 3 and np.allclose(np.frombuffer(back.data, header.dtype())["x"], [0, 1, 2], atol=0.005)
    assert cdr.decode(got[1].data, compressed=True).data == b""
    everywhere_nan = np.full(7, np.nan, "<f4")
    points["x"] = everywhere_nan
    empty = cdr.to_compressed(cdr.encode(replace(cloud_of, data=points.tobytes())), given, visual=True)
    assert cdr.decode(cdr.from_compressed(empty)).width == 0

    (tmp_path / "a.mcap").write_bytes(raw)
    assert cli.main(["benchmark", str(tmp_path / "a.mcap"), "--resolution", "0.01"]) == 0
    out = capsys.readouterr().out
    assert "/a codec: 1 messages, 7 points" in out and "TOTAL visual+zstd: 2 messages" in out and "MB/s" in out
    assert cli.main(["benchmark", str(tmp_path / "a.mcap"), "--resolution", "0.01", "--explain"]) == 0
    assert "/a: 7 points of 20 bytes, 3 for display" in capsys.readouterr().out


@pytest.mark.parametrize("options", [{"encode": True, "profile": {"ring": 0.0}}, {"encode": True, "compression": ""}, {"encode": False}])
def test_containers_on_spark_are_the_command_lines(spark, tmp_path, options):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    for name, n in (("a.mcap", 6), ("deep/b.mcap", 40), ("c.mcap", 0)):
        raw = mcap.write(*container(n), chunk_bytes=5000)
        (tmp_path / "in" / name).write_bytes(raw if options["encode"] else cli.transcode(raw, encode=True)[0])
    tables.convert_containers(spark, str(tmp_path / "in"), str(tmp_path / "out"), Conversion(**options))
    made = sorted(str(p.relative_to(tmp_path / "out")) for p in (tmp_path / "out").rglob("*") if p.is_file())
    assert made == ["a.mcap", "deep/b.mcap"]  # a container without messages has no rows
    for name in made:
        assert (tmp_path / "out" / name).read_bytes() == cli.transcode((tmp_path / "in" / name).read_bytes(), **options)[0]
    one = str(tmp_path / "in" / "a.mcap")
    tables.convert_containers(spark, one, str(tmp_path / "single"), Conversion(**options))
    assert (tmp_path / "single" / "a.mcap").read_bytes() == (tmp_path / "out" / "a.mcap").read_bytes()


def test_new_containers_and_failed_writes(spark, tmp_path):
    datasource.register(spark)
    box, messages = container(3)
    rows = [(f"p{k % 2}.mcap", 0, k, m.channel_id, m.sequence, m.log_time, m.publish_time, m.data) for k, m in enumerate(messages)]
    df = spark.createDataFrame(rows, datasource.SCHEMA).repartition("path").sortWithinPartitions("path", "ordinal")
    save = lambda d: d.write.format("pointweave_mcap").option("definitions", datasource.definitions_json(box)).mode("append").save(str(tmp_path / "new"))
    save(df)
    for k in range(2):
        got, own = mcap.read((tmp_path / "new" / f"p{k}.mcap").read_bytes())
        assert own == messages[k::2] and got.profile == "ros2" and got.metadata == box.metadata
    with pytest.raises(Exception, match="isn't defined"):
        save(df.withColumn("channel_id", F.lit(77)))
    assert sorted(p.name for p in (tmp_path / "new").iterdir()) == ["p0.mcap", "p1.mcap"]


def test_containers_as_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.mcap").write_bytes(mcap.write(*container(k + 1)))
    stream = tables.stream_mcap(spark, str(tmp_path / "in"), files_per_batch=1)
    query = stream.writeStream.format("memory").queryName("arrivals").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.table("arrivals").count() == tables.read_mcap(spark, str(tmp_path / "in")).count() > 10


def test_pcd_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.pcd").write_bytes(pcd_bytes(k % 2 == 0, 10 + k)[2])
    (tmp_path / "in" / "bad.pcd").write_bytes(b"FIELDS x\nDATA nothing\n")
    made = tables.pcd_blobs(spark, str(tmp_path / "in"), resolution=0.01)
    assert made.where("error IS NOT NULL").count() == made.where("content IS NULL").count() == 1
    tables.save_files(made, str(tmp_path / "out"))
    tables.save_files(made, str(tmp_path / "out"))  # again, in their place
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["0.cldn", "1.cldn", "2.cldn"]
    for k in range(3):
        assert (tmp_path / "out" / f"{k}.cldn").read_bytes() == pcd.to_blob((tmp_path / "in" / f"{k}.pcd").read_bytes(), resolution=0.01)


def test_long_headers(spark, tmp_path, monkeypatch):
    names = [f"a_field_with_a_long_name_{k:05d}" for k in range(2000)]
    fields, step = packed_fields([(n, F32, 0.5) for n in names])
    raw = binary.encode_blob(Header(fields, 1, 1, step), np.zeros(1, Header(fields, 1, 1, step).dtype()))
    assert raw.find(b"\0", 13) > 100_000
    (tmp_path / "long.cldn").write_bytes(raw)
    (tmp_path / "none.cldn").write_bytes(b"nothing")
    old = binary.encode_blob(Header(fields[:3], 1, 1, 12, version=4), np.zeros(1, Header(fields[:3], 1, 1, 12).dtype()), text=False)
    (tmp_path / "old.cldn").write_bytes(old)
    got = {r["path"].rsplit("/", 1)[-1]: r["header"] for r in tables.read_blob_headers(spark, str(tmp_path)).collect()}
    assert got["long.cldn"].count("type: FLOAT32") == 2000 and got["none.cldn"] is None and got["old.cldn"].count("type: FLOAT32") == 3
    monkeypatch.setattr(tables, "HEAD", 20)
    assert tables.header_text(lambda n, at: raw[at : at + n], len(raw)) == got["long.cldn"]


def test_transcode_and_cut(tmp_path, capsys):
    box, messages = container()
    raw = mcap.write(box, messages)
    made, (given, out) = cli.transcode(raw, encode=True, profile={"ring": 0.0})
    assert out < given
    got, packed = mcap.read(made)
    assert {s.name for s in got.schemas} == {"other", cli.COMPRESSED} and [m.data for m in packed if m.channel_id == 3] == [m.data for m in messages if m.channel_id == 3]
    assert [(m.channel_id, m.log_time) for m in packed] == [(m.channel_id, m.log_time) for m in messages]
    header = binary.decode_header(cdr.decode(packed[0].data, compressed=True).data)[0]
    assert header.compression == Compression.NONE and [f.name for f in header.fields] == ["x", "y", "z"] and header.point_step == 14
    back, _ = cli.transcode(made, encode=False)
    assert {s.name for s in mcap.read(back)[0].schemas} == {"other", cli.CLOUD}
    assert len([m for m in mcap.read(cli.cut(raw, 2))[1] if m.channel_id == 5]) == 2
    assert {m.channel_id for m in mcap.read(cli.cut(raw, 2, cli.CLOUD))[1]} == {5, 9}
    assert "point_step: 14" in cli.inspect(made) and cli.inspect(raw) == "no compressed message\n"

    (tmp_path / "bag").mkdir()
    (tmp_path / "bag" / "bag.mcap").write_bytes(raw)
    (tmp_path / "bag" / "metadata.yaml").write_text(f"file: bag.mcap\ntype: {cli.CLOUD}\n")
    (tmp_path / "profile.txt").write_text("xyz: 0.01; ring: remove\n")
    assert cli.main(["encode", str(tmp_path / "bag"), str(tmp_path / "out"), "--profile", str(tmp_path / "profile.txt")]) == 0
    assert (tmp_path / "out" / "metadata.yaml").read_text() == f"file: out.mcap\ntype: {cli.COMPRESSED}\n"
    assert cli.main(["inspect", str(tmp_path / "out" / "out.mcap")]) == 0 and "resolution: 0.01" in capsys.readouterr().out
    assert cli.main(["decode", str(tmp_path / "out"), str(tmp_path / "again")]) == 0
    assert cli.main(["cut", str(tmp_path / "again" / "again.mcap"), str(tmp_path / "cut.mcap"), "-n", "1"]) == 0
    with pytest.raises(ValueError, match="metadata"):
        cli.bag(tmp_path, tmp_path / "no", encode=True)


def pcd_bytes(binary_data=True, n=40):
    fields, step = packed_fields([("x", F32, None), ("t", FieldType.FLOAT64, None), ("id", FieldType.INT64, None), ("u", FieldType.UINT8, None)])
    header = Header(fields, n, 1, step)
    points = np.zeros(n, header.dtype())
    points["x"], points["t"], points["id"], points["u"] = np.linspace(-1, 1, n), 1.7e9 + np.arange(n) * 1e-3, -np.arange(n) * 10**12, np.arange(n) % 256
    points["x"][3] = np.nan
    return header, points, pcd.write(header, points, binary=binary_data)


@pytest.mark.parametrize("binary_data", [True, False])
def test_pcd(spark, tmp_path, binary_data):
    header, points, raw = pcd_bytes(binary_data)
    own, got = pcd.read(raw)
    assert got.tobytes() == points.tobytes() and own.points == 40
    for k in range(3):
        (tmp_path / f"{k}.pcd").write_bytes(raw)
    df = tables.read_pcd(spark, str(tmp_path), header)
    assert df.count() == 120 and df.where("id = -5000000000000").count() == 3
    assert cli.pcd_folder(tmp_path, resolution=0.01) == (3, 0)
    blob_header, back = binary.decode_blob((tmp_path / "0.cldn").read_bytes())
    assert blob_header.fields[0].resolution == pytest.approx(0.01) and np.nanmax(np.abs(back["x"] - points["x"])) <= 0.0051
    assert tables.read_blob_headers(spark, str(tmp_path)).where("header LIKE '%point_step: 21%'").count() == 3
    (tmp_path / "bad.pcd").write_bytes(raw[:60])
    assert cli.main(["pcd", str(tmp_path), "--encoding", "LOSSLESS", "--compression", "LZ4"]) == 1
    with pytest.raises((binary.Broken, ValueError)):
        pcd.read(raw[:-5])


def test_pcd_headers():
    with pytest.raises(ValueError, match="type"):
        text.parse_pcd_header(b"FIELDS a\nSIZE 3\nTYPE F\nDATA ascii\n")
    header, kind, _ = text.parse_pcd_header(b"# c\nVERSION .7\nFIELDS a n\nSIZE 4 2\nTYPE F U\nCOUNT 1 2\nWIDTH 2\nHEIGHT 3\nPOINTS 6\nDATA binary\n")
    assert [f.name for f in header.fields] == ["a", "n_0", "n_1"] and kind == "binary" and header.height == 3


def test_texts():
    assert text.parse_profile("xyz:0.001; ring:remove; x : 2") == {"x": 2.0, "y": 0.001, "z": 0.001, "ring": 0.0}
    for bad in ("x:1;", "x", "x:1:2", "x:wide", ":1", "x:-1", "x:nan"):
        with pytest.raises(ValueError):
            text.parse_profile(bad)
    header = Header((PointField("x", 0, F32, 0.1),), 1, 1, 4, encoding_config="abc")
    for exact in (True, False):
        assert text.from_yaml(text.to_yaml(header, exact)) == header
    with pytest.raises(ValueError):
        text.to_yaml(Header((PointField("a#b", 0, F32),)))
    with pytest.raises(ValueError):
        text.from_yaml("version: 5\n  odd: 1\n")
    assert [text.typed(t) for t in ("null", "3", "2.5", "x")] == [None, 3, 2.5, "x"]
    assert sorted(["ring", "z", "a", "x"], key=text.listing_order) == ["x", "z", "a", "ring"]
    assert text.renamed("a/msg ab", {"a": "b", "ab": "c"}) == "b/msg c"
    assert enum_of(Encoding, "LOSSY") == enum_of(Encoding, "1") == Encoding.LOSSY
    with pytest.raises(ValueError):
        enum_of(Encoding, "fast")


def test_planner():
    def header(n, *rest, **options):
        return Header(tuple(PointField(f"f{k}", 4 * k, F32, 0.1) for k in range(n)) + rest, 1, 1, 40, **options)

    ring = PointField("ring", 36, FieldType.UINT16)
    assert [planner.leading_floats(header(n)) for n in range(1, 6)] == [0, 0, 3, 4, 0]
    assert planner.is_adaptive(header(3, ring)) and not planner.is_adaptive(header(3)) and not planner.is_adaptive(header(3, ring, version=4)) and not planner.is_adaptive(header(3, ring, encoding=Encoding.LOSSLESS))
    time = PointField("t", 20, FieldType.FLOAT64)
    assert planner.geometry(header(3)) and planner.geometry(header(2)) is None
    assert planner.geometry(replace(header(3), fields=(*header(3).fields[:2], PointField("z", 8, F32, 0.2)))) is None
    assert planner.with_time_resolution(header(3, time)).fields[3].resolution == pytest.approx(1e-6)
    assert planner.with_time_resolution(header(2, time)).fields[2].resolution is None
    kept = planner.apply_profile(header(3, ring), {"ring": 0.0, "f0": 0.5}, 0.01)
    assert [f.name for f in kept.fields] == ["f0", "f1", "f2"] and kept.point_step == 40 and kept.fields[0].resolution == 0.5
    assert planner.max_size(replace(header(1, ring), compression=Compression.NONE), 32769) == 32769 * 20 + 2 * (4 + 64 + 1024)
    assert header(3).same_layout(header(3, encoding=Encoding.NONE)) and not header(3).same_layout(header(4))
    with pytest.raises(ValueError):
        planner.transform(header(1), PointField("u", 0, FieldType.UNKNOWN))


def test_tables(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(c, k, float(np.float32(rng.uniform(-9, 9))), int(k // 7 * (c + 1)), float(rng.uniform())) for c in range(2) for k in range(33000 if c else 10)]
    df = spark.createDataFrame(rows, "cloud long, idx long, x float, n int, d double").repartition(3)
    header = tables.header_for(df, ["x", "n", "d"], {"x": 0.01})
    chunks = tables.encode_chunks(df, header)
    assert sorted((r["cloud"], r["chunk"], r["n"]) for r in chunks.collect()) == [(0, 0, 10), (1, 0, 32768), (1, 1, 232)]
    blobs = tables.blobs(chunks, header)
    back = tables.decode_chunks(tables.split_blobs(blobs), header).toPandas().sort_values(["cloud", "idx"])
    assert np.abs(back["x"].to_numpy() - [r[2] for r in rows]).max() <= 0.0051
    assert back["n"].tolist() == [r[3] for r in rows] and back["d"].tolist() == [r[4] for r in rows]
    only = tables.decode_chunks(chunks, header, columns=["d"])
    assert only.columns == ["cloud", "idx", "d"] and only.count() == len(rows)
    for r in blobs.collect():
        own, points = binary.decode_blob(bytes(r["blob"]))
        assert own.points == len(points) == (10, 33000)[r["cloud"]]
        (tmp_path / f"{r['cloud']}.cldn").write_bytes(bytes(r["blob"]))
    files = tables.files(spark, str(tmp_path), "*.cldn").selectExpr("length(path) AS cloud", "content AS blob")
    assert tables.split_blobs(files).count() == 3
    assert tables.encode_chunks(df.limit(0), header).collect() == []


def test_mcap_tables(spark, tmp_path):
    box, messages = container(8)
    for k in range(2):
        (tmp_path / f"{k}.mcap").write_bytes(mcap.write(box, messages, chunk_bytes=6000))
    path = str(tmp_path)
    found = {t: tables.read_mcap(spark, path, t) for t in tables.MCAP_TABLES}
    assert {t: d.count() for t, d in found.items()} == {"schemas": 4, "channels": 6, "messages": 2 * len(messages), "metadata": 2, "attachments": 2}
    from pointweave.operators.messages import with_schema

    channels = found["channels"].where("path LIKE '%0.mcap'").selectExpr("id AS channel_id", "schema_id", "topic")
    schemas = found["schemas"].where("path LIKE '%0.mcap'").selectExpr("id AS schema_id", "name AS schema_name")
    joined = with_schema(found["messages"], channels, schemas)
    assert joined.count() == 2 * len(messages)
    made = tables.convert_messages(joined, cli.CLOUD, lossy)
    assert made.where(f"schema_name = '{cli.CLOUD}'").selectExpr("sum(length(data))").first()[0] < joined.where(f"schema_name = '{cli.CLOUD}'").selectExpr("sum(length(data))").first()[0]
    assert made.where("schema_name = 'other'").select("data").subtract(joined.select("data")).count() == 0
    clouds = joined.where(f"schema_name = '{cli.CLOUD}'").select(tables.parse_clouds(joined["data"]).alias("c")).select("c.*")
    assert clouds.groupBy("width").count().orderBy("width").collect()[0][0] == 120

    datasource.register(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    df = spark.read.format("pointweave_mcap").option("path", path).load()
    assert df.rdd.getNumPartitions() > 4 and df.count() == 2 * len(messages)
    assert df.where("channel_id = 3").count() == 16
    whole = df.orderBy("path", "chunk", "ordinal").where("path LIKE '%0.mcap'").collect()
    assert [bytes(r["data"]) for r in whole] == [m.data for m in messages]


def test_sql_functions(spark):
    sqlfuncs.register(spark)
    c = cloud(64)
    raw, bad = cdr.encode(c), b"\0\1\0\0oops"
    df = spark.createDataFrame([(raw,), (bad,), (None,)], "m binary")
    df.createOrReplaceTempView("messages")
    packed = spark.sql("SELECT pw_encode_message(m, 'xyz:0.001; ring:remove') AS p FROM messages")
    packed.createOrReplaceTempView("packed")
    got = spark.sql("SELECT pw_compressed_size(p) AS n, pw_decompressed_size(p) AS m, pw_message_header(p) AS h, length(pw_decode_message(p)) AS d, pw_message_to_message(p) AS back FROM packed").collect()
    assert got[0]["m"] == got[0]["d"] == 64 * 14 and "name: x" in got[0]["h"] and cdr.decode(bytes(got[0]["back"])).width == 64
    assert [(r["n"], r["m"], r["h"]) for r in got[1:]] == [(0, 0, None)] * 2
    header = "version: 5\nwidth: 0\nheight: 1\npoint_step: 4\nencoding_opt: LOSSY\ncompression_opt: ZSTD\nfields:\n  - name: v\n    offset: 0\n    type: UINT32\n    resolution: null\n"
    data = np.arange(100, dtype="<u4").tobytes()
    df = spark.createDataFrame([(data, header)], "d binary, h string")
    df.createOrReplaceTempView("datas")
    row = spark.sql("SELECT pw_decode_data(pw_encode_data(d, h)) AS d, pw_blob_header(pw_encode_data(d, h)) AS h FROM datas").first()
    assert bytes(row["d"]) == data and "width: 100" in row["h"]


def test_stream(spark, tmp_path):
    from pointweave.streaming import convert

    raw = [cdr.encode(cloud(130, k)) for k in range(45)] + [b"bad"]
    given, out, state = tmp_path / "in", tmp_path / "out", tmp_path / "state"
    for part in range(3):
        rows = [("a" if k % 3 else "b", k, raw[k]) for k in range(46) if k // 16 == part]
        spark.createDataFrame(rows, "topic string, seq long, data binary").coalesce(1).write.mode("append").parquet(str(given))
    source = spark.readStream.schema("topic string, seq long, data binary").option("maxFilesPerTrigger", 1).parquet(str(given))
    made = convert.convert(source, lossy)
    query = convert.start(made, str(out), str(state))
    query.awaitTermination(120)
    got = spark.read.parquet(str(out))
    assert got.count() == 46 and got.where("error IS NOT NULL").count() == 1 and got.where("out_bytes < raw_bytes").count() == 45

    again = spark.readStream.schema(got.schema).parquet(str(out)).where("error IS NULL")
    query = convert.reports(again, "topic", "seq").writeStream.format("memory").queryName("reports").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    found = {(r["topic"], r["report"]): r["messages"] for r in spark.table("reports").collect()}
    assert found == {("a", 0): 1, ("a", 1): 20, ("b", 0): 1}
    query = convert.reports(again, "topic", "seq", every=10, first_alone=False).writeStream.format("memory").queryName("tens").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted((r["topic"], r["report"], r["messages"]) for r in spark.table("tens").collect()) == [("a", 0, 10), ("a", 1, 10), ("a", 2, 10), ("b", 0, 10)]
    assert convert.sink_name("/t") == "/t/compressed" and convert.sink_name("/t", False) == "/t/decompressed"


def test_resolution_changes_between_batches(spark, tmp_path):
    from pointweave.streaming import convert

    given, raw = tmp_path / "in", cdr.encode(cloud(400))
    for part in range(2):
        spark.createDataFrame([(part, raw)], "seq long, data binary").coalesce(1).write.mode("append").parquet(str(given))
    resolutions = iter([0.001, 0.1])

    def current():
        own = next(resolutions)
        return lambda raw: cdr.to_compressed(raw, planner.apply_profile(cdr.header_of(cdr.decode(raw)), {}, own))

    source = spark.readStream.schema("seq long, data binary").option("maxFilesPerTrigger", 1).parquet(str(given))
    convert.start_batches(source, current, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    sizes = [r[0] for r in spark.read.parquet(str(tmp_path / "out")).orderBy("batch").select("out_bytes").collect()]
    assert len(sizes) == 2 and sizes[1] < sizes[0]


def test_formats():
    assert text.mib(3 << 20) == "3.00 MiB" and text.percent(1, 4) == "25.0 %" and text.percent(1, 0) == "-"
    assert text.megabytes_per_second(5_000_000, 10**9) == 5.0 and text.megabytes_per_second(1, 0) == 0.0
