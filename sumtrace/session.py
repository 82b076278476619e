"""Session settings and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession

# Runtime settings worth having on any cluster. Join sides are broadcast only
# when Spark's own size check allows it; no query carries a broadcast hint.
RUNTIME = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def tune(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME.items():
        spark.conf.set(key, value)
    return spark


def local_session(cpus: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("sumtrace")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # Recording a call site for every column expression slows down building plans.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder: on a cluster the
    folder has to be readable from every machine, so a missing setting is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="sumtrace-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and read it back.

    Each round of an iterative operator starts from files, so the plan stays short
    and a lost executor costs one round. Files carry their size, which is what the
    broadcast check of the next round goes by.
    """
    spark = df.sparkSession
    path = f"{_cut_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _made.get() is not None:
        _made.get().append(path)
    return spark.read.schema(df.schema).parquet(path)


def _cut_folder(spark: SparkSession) -> str:
    return f"{checkpoint_folder(spark)}/{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is such a file, on whatever file system the path names."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(context._jsc.hadoopConfiguration()).exists(path)


def scratch(spark: SparkSession) -> str:
    """A new folder of this application for files that are written and read again."""
    return f"{_cut_folder(spark)}/{uuid.uuid4().hex}"


def uncut(*frames: DataFrame) -> None:
    """Delete the files behind frames that came from :func:`cut` and are not needed any more."""
    for df in frames:
        mine = f"/{df.sparkSession.sparkContext.applicationId}/"
        for folder in {unquote(f.rsplit("/", 1)[0]) for f in df.inputFiles()}:
            if mine in folder:
                _delete(df.sparkSession, folder)


@contextmanager
def only_kept(spark: SparkSession) -> Iterator[None]:
    """Delete what was cut within the block, but for the last: for blocks that end with cutting their result."""
    token = _made.set([])
    try:
        yield
    finally:
        for path in _made.get()[:-1]:
            _delete(spark, path)
        _made.reset(token)


def drop_cuts(spark: SparkSession) -> None:
    """Delete everything this application has cut; frames built on it stop working."""
    _delete(spark, _cut_folder(spark))
