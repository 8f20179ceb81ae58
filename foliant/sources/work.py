"""Tables that a job reads more than once, written to the folder all executors share.

They go as Parquet to the folder named by ``spark.checkpoint.dir``.  That cuts
the lineage, so a lost executor costs a reread and never a recomputation of
what came before, and it leaves nothing on the machines' own disks.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_WORK = "foliant-work"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder serves local sessions (tests); on a
    cluster a machine's own folder would not do, so that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="foliant-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    made = "file://" + folder
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def _forget(spark: SparkSession, path: str) -> None:
    try:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # the session is gone already; the folder stays for its owner
        return


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; removed when the driver's process ends."""
    path = f"{shared_dir(spark)}/{_WORK}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    atexit.register(_forget, spark, path)
    return path


#: For each open ``scratch`` the tables written in it: session and path.
_scratches: list[dict[str, SparkSession]] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back."""
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._foliant_path = path
    if _scratches:
        _scratches[-1][path] = spark
    return found


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables written inside are removed at its end, except those given to the function it yields."""
    tables: dict[str, SparkSession] = {}
    _scratches.append(tables)

    def keep(df: DataFrame) -> DataFrame:
        tables.pop(df._foliant_path, None)
        return df

    try:
        yield keep
    finally:
        _scratches.remove(tables)
        for path, spark in tables.items():
            _forget(spark, path)
