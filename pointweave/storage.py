"""The folder that driver and executors share, and tables written there to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Folders of tables that this driver has written and not dropped.
WRITTEN: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where that is unset a local master, whose driver and executors are one process,
    gets a new local folder; any other master is an error, as a machine's own folder isn't shared."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that the driver and all executors of {master} share")
        folder = "file://" + tempfile.mkdtemp(prefix="pointweave-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop, whatever store it is in."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back. It outlives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_path = path
    WRITTEN.add(path)
    return out


def drop_written(*tables: DataFrame) -> None:
    """Delete written tables whose last reader is done."""
    for df in tables:
        delete(df.sparkSession, df.written_path)
        WRITTEN.discard(df.written_path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables written inside are deleted at its end, or when it fails, but for those given to the function that it yields: what is
    lazily computed from others must have been written by then. Not for threads that write at the same time."""
    before, kept = set(WRITTEN), set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df.written_path)
        return df

    try:
        yield keep
    except BaseException:
        kept.clear()
        raise
    finally:
        for path in WRITTEN - before - kept:
            delete(spark, path)
            WRITTEN.discard(path)


def clean(spark: SparkSession) -> None:
    """Delete all tables that ``written`` has left; results that read them must have been used."""
    for path in list(WRITTEN):
        delete(spark, path)
        WRITTEN.discard(path)
