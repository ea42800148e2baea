"""Tables between the steps of a job, in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Only where it is unset and all runs in one process (tests) a temporary folder is made and set."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


#: Folders of the tables written in each open step of this thread, the outermost first.
_steps: contextvars.ContextVar[tuple[list[str], ...]] = contextvars.ContextVar("steps", default=())


def materialise(df: DataFrame, keep: bool = False) -> DataFrame:
    """Writes `df` as a table and reads it: cuts the lineage, survives lost executors, and what is used more than
    once is worked out once. The table goes with the step that it is written in (see `step`), or with `keep` with the one
    around it; outside of any when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    folder, files = _folder(spark, path)
    files.deleteOnExit(folder)
    steps = _steps.get()[:-1] if keep else _steps.get()
    if steps:
        steps[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _folder(spark: SparkSession, path: str):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


@contextlib.contextmanager
def step(spark: SparkSession) -> Iterator[None]:
    """`with step(spark): found = materialise(job(...), keep=True)` leaves the table of what was found and deletes all
    others that were written on the way, also where the job fails. What is read later must be kept. Steps may be nested;
    each thread has its own."""
    written: list[str] = []
    token = _steps.set((*_steps.get(), written))
    try:
        yield
    finally:
        _steps.reset(token)
        for path in written:
            folder, files = _folder(spark, path)
            files.delete(folder, True)


def spread(df: DataFrame) -> DataFrame:
    """Rows of a scan dealt over all cores where it has fewer splits than there are cores (a small file before work on
    every line); any larger input stays as it is read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
