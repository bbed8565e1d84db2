from pathlib import Path
from types import SimpleNamespace

import pytest

from pointweave import storage


def test_written_and_clean(spark):
    df = storage.written(spark.range(5), "five")
    folder = Path(df.written_path.removeprefix("file://"))
    assert df.count() == 5 and folder.is_dir()
    storage.clean(spark)
    assert not folder.exists() and not storage.WRITTEN
    other, more = storage.written(spark.range(0), "none"), storage.written(spark.range(1), "one")
    assert other.count() == 0 and other.columns == ["id"]
    storage.drop_written(other, more)
    assert not storage.WRITTEN


def test_scratch_keeps_what_is_asked_for(spark):
    before = storage.written(spark.range(1), "before")
    with storage.scratch(spark) as keep:
        storage.written(spark.range(2), "inner")
        kept = keep(storage.written(spark.range(3), "kept"))
    assert storage.WRITTEN == {before.written_path, kept.written_path} and kept.count() == 3
    with pytest.raises(KeyError), storage.scratch(spark) as keep:
        keep(storage.written(spark.range(2), "failed"))
        raise KeyError
    assert storage.WRITTEN == {before.written_path, kept.written_path}
    storage.clean(spark)


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "k8s://https://host", "local-cluster[2,1,1024]"])
def test_a_cluster_needs_a_shared_folder(master):
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: default), sparkContext=SimpleNamespace(master=master))
    with pytest.raises(RuntimeError, match="checkpoint"):
        storage.shared_folder(session)
    session.conf.get = lambda key, default: "hdfs://host/shared/"
    assert storage.shared_folder(session) == "hdfs://host/shared"
