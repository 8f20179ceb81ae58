"""What the training-data operators share: tables, row keys, batches of texts.

Intermediate results that a job reads more than once are written to the shared
folder (``foliant.sources.work``).
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.sources.work import scratch, shared_dir, work_path, written

__all__ = [
    "scratch", "shared_dir", "table", "text_or_empty", "unused", "with_row_keys", "with_text_batches", "work_path", "written",
]

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_row_keys(df: DataFrame, name: str, id_col: str) -> DataFrame:
    """``df`` with a string column that tells its rows apart, the same at every reading.

    Keys sort by id, then by a digest of the row's content, so which of two
    rows has the smaller key is the same in every run and for every layout of
    the files; only rows that are equal in every column are told apart by file
    and position.  Rows that do not come straight from Parquet files are written
    first.
    """
    kind = df.schema[id_col].dataType
    own = F.lpad(F.hex(F.col(id_col).cast("long")), 16, "0") if isinstance(kind, T.IntegralType) else F.col(id_col).cast("string")
    content = [F.col(f"`{f.name}`") for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    key = F.concat_ws(":", F.coalesce(own, F.lit("~")), F.hex(F.xxhash64(*content)), _file_position())
    try:
        return df.withColumn(name, key)
    except AnalysisException:
        return written(df, "rows").withColumn(name, key)


def _file_position():
    return F.concat_ws(":", F.hex(F.xxhash64("_metadata.file_path")), F.col("_metadata.row_index").cast("string"))


def unused(df: DataFrame, name: str) -> str:
    """``name``, longer if ``df`` has such a column already."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


#: Bytes of whole texts that go to a Python worker at once, about.
BATCH_BYTES = 4 << 20


def with_text_batches(df: DataFrame) -> DataFrame:
    """``df`` itself; its session hands rows to Python workers in Arrow batches of few bytes from now on.

    A batch stands in memory several times (Arrow buffers on either side and
    Python strings).  The bound is by bytes, so rows of numbers still travel in
    large batches; it stays set, as the plans that need it run later.
    """
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    df.sparkSession.conf.set(setting, str(BATCH_BYTES))
    return df


def text_or_empty(column: str):
    return F.coalesce(F.col(column), F.lit(""))
