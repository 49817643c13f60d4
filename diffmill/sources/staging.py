"""Tables between the steps of a job, in the folder the cluster shares.

A staged table cuts the lineage: a lost executor costs the tasks of one step, not the
whole job, and steps that read a result twice do not compute it twice. Being Parquet, it
keeps column pruning and statistics for the next step.

What is staged inside ``run`` lies in that run's folder and goes with it. A run that dies
leaves its folder; the next run sweeps those that have shown no life for a while. Outside a
run, tables stay until the folder's own retention rule removes them.
"""

import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
#: A run touches this file whenever it stages a table.
ALIVE = "_alive"
#: Hours without life after which a run counts as dead.
PATIENCE = 48.0

_run: ContextVar[str | None] = ContextVar("staging_run", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Only a local session without one, such
    as a test, gets a temporary folder; on a cluster executors would not share it."""
    path = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getConf().get(
        CHECKPOINT_DIR
    )
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{CHECKPOINT_DIR} must name a folder that all executors share")
    path = tempfile.mkdtemp(prefix="diffmill-")
    spark.conf.set(CHECKPOINT_DIR, path)
    return path


def _files(spark: SparkSession, path: str):
    """The Hadoop path and its file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    where, system = _files(spark, path)
    system.delete(where, True)


def found(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that a glob pattern matches."""
    where, system = _files(spark, pattern)
    return sorted(s.getPath().toString() for s in system.globStatus(where) or [])


def _touch(spark: SparkSession, folder: str) -> None:
    where, system = _files(spark, f"{folder}/{ALIVE}")
    system.create(where, True).close()


def sweep(spark: SparkSession, patience: float = PATIENCE) -> list[str]:
    """Remove the folders of runs without life for so many hours; returns their paths."""
    limit, gone = (time.time() - patience * 3600) * 1000, []
    for folder in found(spark, f"{shared_dir(spark)}/diffmill/runs/*"):
        where, system = _files(spark, f"{folder}/{ALIVE}")
        last = system.getFileStatus(where if system.exists(where) else where.getParent()).getModificationTime()
        if last < limit:
            remove(spark, folder)
            gone.append(folder)
    return gone


@contextmanager
def run(spark: SparkSession, name: str, patience: float = PATIENCE) -> Iterator[str]:
    """A run: what this thread stages inside is removed at its end, however it ends. Frames
    that read it must not be used later."""
    sweep(spark, patience)
    folder = f"{shared_dir(spark)}/diffmill/runs/{name}-{uuid.uuid4().hex}"
    _touch(spark, folder)
    before = _run.set(folder)
    try:
        yield folder
    finally:
        _run.reset(before)
        remove(spark, folder)


def new_path(spark: SparkSession, name: str) -> str:
    folder = _run.get()
    if folder is None:
        folder = f"{shared_dir(spark)}/diffmill"
    else:
        _touch(spark, folder)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` to a new table, at ``path`` if given, and read it back."""
    path = path or new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Step:
    """A staged table that the next one of its kind takes the place of, as in a loop."""

    def __init__(self, name: str):
        self.name, self.path = name, None

    def replace(self, df: DataFrame) -> DataFrame:
        """Stage ``df``, which may read the table before it, then remove that one."""
        spark, old = df.sparkSession, self.path
        self.path = new_path(spark, self.name)
        out = staged(df, self.name, self.path)
        if old is not None:
            remove(spark, old)
        return out

    def drop(self, spark: SparkSession) -> None:
        if self.path is not None:
            remove(spark, self.path)
            self.path = None
