"""Tables written in the folder that all executors share."""

from __future__ import annotations

import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a local session (one machine) has a temporary folder; on a cluster
    there is no safe place for intermediate tables, and the job stops."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (found or f"file://{tempfile.gettempdir()}/schemaloom-shared").rstrip("/")


class _Open(threading.local):
    """Paths that open scratch() blocks of this thread are to delete."""

    def __init__(self):
        self.blocks: list[list[str]] = []


_open = _Open()


@contextmanager
def scratch(spark: SparkSession):
    """Tables written within are deleted at its end, but for those written with keep=True. For a step whose result is a written table and
    reads none of the others any more."""
    _open.blocks.append([])
    try:
        yield
    finally:
        conf = spark._jsc.hadoopConfiguration()
        for path in _open.blocks.pop():
            path = spark._jvm.org.apache.hadoop.fs.Path(path)
            path.getFileSystem(conf).delete(path, True)


def written(df: DataFrame, keep: bool = False) -> DataFrame:
    """`df` written as a table in the shared folder and read again: lineage ends here, and a lost executor costs a
    read, not the work above. The owner of the folder clears it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    if _open.blocks and not keep:
        _open.blocks[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
