"""Collections as a stream: new input files are ranked as they arrive.

Stateless: each micro-batch of new collection files is run as the batch plan
runs it, so no watermark is needed; the checkpoint makes it exactly once for
sinks that replace by batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from foliant.sources.collections import INPUT_NAME, INPUT_SCHEMA


def collection_stream(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of new collection files under ``folder``."""
    return (
        spark.readStream.schema(INPUT_SCHEMA)
        .option("multiLine", True)
        .option("pathGlobFilter", INPUT_NAME)
        .option("recursiveFileLookup", True)
        .json(folder)
    )


def run_stream(stream: DataFrame, run: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Write ``run`` of each micro-batch as JSON under ``out``, in a folder per batch."""

    def each(batch: DataFrame, batch_id: int) -> None:
        run(batch).write.mode("overwrite").json(f"{out}/batch={batch_id}")

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each)
    return (writer.trigger(availableNow=True) if once else writer).start()
