import psutil
import pytest
from pyspark.sql import functions as F

from pointweave.llm import common


def test_fresh(spark):
    df = spark.createDataFrame([(1, 2)], "counts int, Counts_1 int")
    assert common.fresh(df, "counts") == "counts_2" and common.fresh(df, "x") == "x"


def test_cache_forgets():
    cache, calls = common.TwoGenerations(2), 0
    for _ in range(3):
        for key in ("a", "bb", "ccc", "a", "x" * 100):
            new = cache.unknown([key])
            calls += len(new)
            cache.update({k: len(k) for k in new})
            assert cache[key] == len(key)
            cache.rotate()
            assert len(cache) + len(cache.old) <= 5 and "x" * 100 not in cache
    assert calls > 6


@pytest.mark.skipif(common.TRIM is None, reason="no glibc")
def test_released():
    held = [bytes(1000) for _ in range(200_000)]
    last = [bytes(1000) for _ in range(10)]  # above them, so that they don't go by themselves
    del held
    before = psutil.Process().memory_info().rss
    common.released()
    assert psutil.Process().memory_info().rss < before - 100_000_000 and last


def test_unclaimed(docs_of):
    common.unclaimed(docs_of([]), "free")
    with pytest.raises(ValueError, match="words"):
        common.unclaimed(docs_of([]), "free", "Words")


def test_a_hot_star_is_split(spark):
    """A star's links meet their minimum in a join that AQE splits, as both sides are plain."""
    own = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    links = common.written(spark.range(1, 60_000).select(F.lit(0).alias("u"), F.col("id").alias("v")), "star")
    least = common.written(links.groupBy("u").agg(F.min("v").alias("m")), "starleast")
    before = {k: spark.conf.get(k, None) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        joined = links.join(least, "u").select("v", "m")
        joined.write.format("noop").mode("overwrite").save()
        joined.count()
        plan = joined._jdf.queryExecution().executedPlan()
        joined.collect()
        assert "skew=true" in plan.toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
        common.drop_written(links, least)


@pytest.mark.parametrize("broadcast", [500_000, 0])
def test_components_of_many_and_few(spark, monkeypatch, broadcast):
    monkeypatch.setattr(common, "BROADCAST_LINKS", broadcast)
    links = [(k, k + 1) for k in range(0, 60)] + [(1000, k) for k in range(1001, 1200)] + [(5, 5), (2000, 2001)]
    got = {r["node"]: r["root"] for r in common.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(1000, 1200), 1000), 2000: 2000, 2001: 2000}


def test_components_ignores_nulls(spark):
    links = spark.createDataFrame([(1, None), (None, 2), (3, 3), (4, 5)], "a long, b long")
    assert sorted(tuple(r) for r in common.components(links).collect()) == [(4, 4), (5, 4)]
    assert common.components(links.limit(0)).collect() == []
    with pytest.raises(RuntimeError, match="settle"):
        common.components(spark.createDataFrame([(k, k + 1) for k in range(50)], "a long, b long"), max_rounds=1)
