"""Tables that outlive one job, in the folder that all executors share.

Iterative operators cut lineage by writing a table here and reading it again.
Such a table survives a lost executor, unlike a local checkpoint or a cache.
"""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
#: A job's shuffle files go as soon as it ends.
CLEANUP = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}

#: Whole texts pass between Spark and Python so many at a time, as each batch stands in both.
FEW_TEXTS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "512"}


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Where that is unset, a temporary one if all of Spark runs in this process; else an error, as executors would not see each other's files."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="textloom-")
        atexit.register(shutil.rmtree, _own[app], True)
    return f"file://{_own[app]}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/textloom/{name}-{uuid.uuid4().hex}"


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """The session's settings while a job runs; they are as before afterwards."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def written(df: DataFrame, name: str, compression: str = "zstd", during: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return it as read back. The job's shuffle files go as soon as it ends."""
    path = new_path(df.sparkSession, name)
    with settings(df.sparkSession, CLEANUP | (during or {})):
        df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def erase(df: DataFrame) -> None:
    """Delete the files behind a table made by :func:`written`, once nothing reads it any more."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def lean(run):
    """``run`` of mapInArrow, after which the process gives free memory back: idle Python workers stay, and count for the executor."""

    def wrapped(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return wrapped
