import numpy as np
import pytest
from pyspark.sql import functions as F

from pointweave.functions import bits
from pointweave.functions.binary import fingerprint, varints
from pointweave.operators import adaptive, messages, rows, sequence
from pointweave.operators.order import chunked, in_chunk, indexed


def test_bits(spark):
    numbers = [0, 1, -1, 63, 64, -64, -65, 8191, 8192, 2**31, -(2**31), 2**55, 2**62 - 1, 2**62, -(2**62), 2**63 - 1, -(2**63) + 1]
    df = spark.createDataFrame([(x,) for x in numbers], "x long")
    z, size, back = bits.zigzag(F.col("x")), bits.varint_size(F.col("x")), bits.unzigzag(bits.zigzag(F.col("x")))
    for r in df.select("x", z.alias("z"), size.alias("size"), back.alias("back")).collect():
        assert r["back"] == r["x"]
        if abs(r["x"]) < 2**62:
            assert r["size"] == varints(np.array([r["x"]]))[1][0]
    d = spark.createDataFrame([(k,) for k in (1, 2, 3, 4, 5, 16, 17, 65535)], "u long")
    assert [r[0] for r in d.select(bits.index_bits(F.col("u"))).collect()] == [0, 1, 2, 2, 3, 4, 5, 16]
    w = spark.createDataFrame([(2**31,), (-(2**31) - 1,), (5,)], "d long")
    assert [r[0] for r in w.select(bits.wrap32(F.col("d"))).collect()] == [-(2**31), 2**31 - 1, 5]


def test_rounding(spark):
    df = spark.createDataFrame([(2.5,), (-2.5,), (0.49999999999999994,)], "v double")
    got = df.select(bits.half_away(F.col("v")), bits.half_even(F.col("v"))).collect()
    assert [tuple(r) for r in got] == [(3, 2), (-3, -2), (0, 0)]


@pytest.mark.parametrize("range_rows", [10, 1000])
def test_indexed_numbers_large_clouds_in_ranges(spark, range_rows):
    r = np.random.default_rng(4)
    data = [(int(k), "hot" if r.random() < 0.6 else str(r.integers(0, 3))) for k in r.permutation(300)] + [(500, None), (900, None)]
    df = spark.createDataFrame(data, "id long, topic string")
    got = {x["id"]: x["idx"] for x in indexed(df, ["topic"], ["id"], range_rows=range_rows).collect()}
    for topic in {t for _, t in data}:
        own = sorted(i for i, t in data if t == topic)
        assert [got[i] for i in own] == list(range(len(own)))
    assert indexed(df.limit(0), ["topic"], ["id"]).collect() == []


def test_indexed_takes_text_outliers_and_constants(spark):
    r = np.random.default_rng(5)
    names = [f"n{k:04d}" for k in r.permutation(400)]
    data = [(n, 10**15 if k == 7 else k, 1, None if k % 9 else "x") for k, n in enumerate(names)]
    df = spark.createDataFrame(data, "name string, far long, same int, gaps string").repartition(7)
    for order in (["name"], ["far"], ["same", "name"], ["gaps", "far"]):
        columns = [df.columns.index(c) for c in order]
        want = sorted(data, key=lambda row: [(row[c] is not None, row[c]) for c in columns])
        got = indexed(df.withColumn("one", F.lit(1)), ["one"], order, range_rows=25)
        assert [tuple(x)[:4] for x in got.orderBy("idx").select(*df.columns, "idx").collect()] == want
        assert sorted(x[0] for x in got.select("idx").collect()) == list(range(400))
    ties = indexed(df, ["same"], ["same"], range_rows=25)  # not a total order: still a number for each
    assert sorted(x[0] for x in ties.select("idx").collect()) == list(range(400))
    outlier = df.withColumn("one", F.lit(1)).repartitionByRange(16, "one", "far")
    assert max(x["count"] for x in outlier.groupBy(F.spark_partition_id()).count().collect()) < 100


def test_voxel_key_has_x_lowest(spark):
    df = spark.createDataFrame([(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1), (-1, -2, -3), (2**20, 0, 0)], "x long, y long, z long")
    base = 2**20
    want = [((x + base) % 2**21) + ((y + base) % 2**21) * 2**21 + ((z + base) % 2**21) * 2**42 for x, y, z in map(tuple, df.collect())]
    assert [r[0] for r in df.select(bits.voxel_key(F.col("x"), F.col("y"), F.col("z"))).collect()] == want


def points(spark, values, size=4):
    df = spark.createDataFrame([("t", k, v) for k, v in enumerate(values)], "event_type string, idx long, v double")
    return chunked(df, size=size)


def test_missing_values_reset(spark):
    nan = float("nan")
    values = [nan, nan, 0.5, 1.0, nan, 2.0, 3.0, nan, nan, 1.0]
    w = in_chunk(["event_type"])
    df = points(spark, values).withColumn("q", sequence.quantise(F.col("v"), 0.5)).withColumn("d", sequence.delta(F.col("q"), w))
    back = sequence.undelta(df, "d", ["event_type"], "back").orderBy("idx").collect()
    assert [r["back"] for r in back] == [None if v != v else round(v / 0.5) for v in values]


def test_runs_and_back(spark):
    values = [1.0, 1.0, 1.0, 1.0, 1.0, 2.0, 2.0, 1.0, 1.0]
    df = points(spark, values).withColumn("x", F.col("v").cast("long"))
    found = sequence.runs(df, "x", ["event_type"])
    assert sorted((r["first"], r["value"], r["length"]) for r in found.collect()) == [(0, 1, 4), (4, 1, 1), (5, 2, 2), (7, 1, 1), (8, 1, 1)]
    assert [r["value"] for r in sequence.unruns(found, ["event_type"]).orderBy("idx").collect()] == values


@pytest.mark.parametrize("pattern", [lambda i: 1000 + 3 * i, lambda i: i % 4, lambda i: i // 256 % 8, lambda i: (i * 7919) % 65536])
def test_sizes_equal_the_bytes(spark, pattern):
    from pointweave.functions import binary

    i = np.arange(5000)
    v = pattern(i)
    df = spark.createDataFrame([("t", int(a), int(b)) for a, b in zip(i, v, strict=True)], "event_type string, idx long, v long")
    df = chunked(df, size=4000)
    modes = {r["event_type"]: r["mode"] for r in adaptive.frozen_mode(df, "v", ["event_type"], 4).collect()}
    first = v[:4000].astype("<u4")
    assert modes["t"] == binary.choose_mode(first)
    sizes = adaptive.section_sizes(df, "v", ["event_type"], 4).where("chunk = 0").first()
    assert [sizes[m] for m in adaptive.MODES] == [binary.section_size(first, m) for m in adaptive.MODES]


def test_voxels(spark):
    nan, inf = float("nan"), float("inf")
    data = [(0, 0, 0.01, 0.0, 0.0), (0, 1, nan, 0.0, 0.0), (0, 2, 0.0, inf, 0.0), (0, 3, 0.04, 0.0, 0.0), (0, 4, 0.05, 0.0, 0.0), (1, 0, -0.05, 0.0, 0.0), (1, 1, 300000.0, 0.0, 0.0), (1, 2, 300000.0 + 209715.2, 0.0, 0.0)]
    df = spark.createDataFrame(data, "cloud long, idx long, x float, y float, z float")
    kept = rows.voxel_first(df, ["cloud"], 0.1)
    assert sorted((r["cloud"], r["idx"]) for r in kept.collect()) == [(0, 0), (0, 4), (1, 0), (1, 1), (1, 2)]
    assert rows.voxel_first(df, ["cloud"], 0.1, packed=True).where("cloud = 1").count() == 2  # 2^21 ticks apart
    assert rows.not_nan(df, "x").count() == 7 and rows.finite(df, "x", "y", "z").count() == 6
    with pytest.raises(ValueError):
        sequence.inverse(0.0)


def test_profile(spark):
    df = spark.createDataFrame([(1.234, 0.5, 7)], "x float, y double, ring int")
    got = rows.apply_profile(df, {"y": 0.0, "ring": 0.5}, default=0.001)
    assert got.dtypes == [("x", "bigint"), ("ring", "int")] and got.first()["x"] == 1234


def test_unknown_id_raises(spark):
    df = spark.createDataFrame([(1,), (2,)], "id long")
    mapping = spark.createDataFrame([(1, 10)], "old long, new long")
    assert [r["id"] for r in messages.remapped(df.where("id = 1"), "id", mapping).collect()] == [10]
    with pytest.raises(Exception, match="unknown id: 2"):
        messages.remapped(df, "id", mapping).collect()


def test_total_needs_two_topics(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 5)], "topic string, n long")
    out = lambda d: sorted(tuple(r) for r in messages.with_total(d, "topic", F.sum("n").alias("n")).collect())
    assert out(df) == [("TOTAL", 8), ("a", 3), ("b", 5)] and out(df.where("topic = 'a'")) == [("a", 3)]


def test_samples(spark):
    df = spark.createDataFrame([("a", k) for k in range(10)] + [("b", 0)], "topic string, t long")
    got = messages.sample(df, ["topic"], ["t"], first=8, every=3)
    assert sorted((r["topic"], r["seen"]) for r in got.collect()) == [("a", 1), ("a", 4), ("a", 7), ("b", 1)]
    assert messages.first_n(df, ["topic"], ["t"], 2).count() == 3


def test_plans_stay_in_generated_code(spark, sf_dir):
    from pointweave.plans import queries

    for name in ("q02_delta_varint_size_by_topic", "q10_topic_ratio", "q06_voxel_dedup_first", "q14_section_sizes"):
        plan = queries.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan
    plan = queries.q02_delta_varint_size_by_topic(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "props" not in plan and "user_id" not in plan  # pruned at the scan


def test_fingerprint_depends_on_order():
    assert fingerprint(b"ab") != fingerprint(b"ba")


def test_fields_as(spark):
    df = spark.createDataFrame([(1, 2.0, "x")], "a int, b double, c string")
    assert rows.fields_as(df, {"b": "double", "d": "int", "a": "int"}).columns == ["b", "a"]
    with pytest.raises(TypeError, match="b is double"):
        rows.fields_as(df, {"b": "float"})
