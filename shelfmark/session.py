"""Session settings and table access shared by the whole package."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str = "*", shuffle_partitions: int = 8, name: str = "shelfmark") -> SparkSession:
    """A local session for tests and the bench; on a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt over all cores, where the input has no more parts than these: a few large row groups would leave cores
    idle in costly passes. Larger inputs stay as they are and are not shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() <= cores else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- shared folders -------------------------------------------------------------------------------------------------


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors see; a temporary one only in a local session without it."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="shelfmark-")
        context.setCheckpointDir(found)
    return found


def new_folder(spark: SparkSession) -> str:
    """The path of a folder in the shared one that nothing has been written to."""
    path = f"{shared_dir(spark).rstrip('/')}/{uuid.uuid4().hex}"
    if (own := _written.get()) is not None:
        own.append(path)
    return path


#: Folders that were made inside a ``temporary`` block of this thread; None outside of one.
_written: ContextVar[list[str] | None] = ContextVar("written", default=None)


def stored(df: DataFrame) -> DataFrame:
    """A table as compressed Parquet in the shared folder, so that a lost executor costs no lineage."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Removes at its end what was stored in it, and nothing that other threads store meanwhile; for results that are
    written before it ends."""
    token = _written.set([])
    try:
        yield
    finally:
        own = _written.get()
        _written.reset(token)
        for path in own:
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def finished_folders(spark: SparkSession, path: str) -> list[int]:
    """The folders under a path whose names are numbers and that a finished job has written."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(folder):
        return []
    names = [s.getPath().getName() for s in system.listStatus(folder)]
    return sorted(int(n) for n in names if n.isdigit() and system.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS")))
