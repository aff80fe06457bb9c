"""Jobs that pick up new files: each run takes those that no run has finished, and every key gets one output however runs end."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def outputs(spark: SparkSession, path: str) -> DataFrame | None:
    """What all batches of a job have written, with the batch; None before the first."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def advance(source: DataFrame, work: Callable[[DataFrame], DataFrame], keys: Sequence[str], path: str, checkpoint: str, files_done: Callable[[int], None] | None = None) -> None:
    """Runs `work` over the new files of a stream and returns when they are done.

    The stream's checkpoint remembers which files went into which batch, before the batch begins.  A batch writes to a folder of its own number and replaces
    what a broken attempt has left there, so a run that dies, at any point, is taken up by the next one without a loss or a repeat.  Keys that an earlier
    batch has written (a file that came again under another name) are passed over, before `work` sees them; of rows that share a key in one batch one stays.

    files_done is called with the number of each batch after its output stands and before the stream knows.
    """

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        fresh = rows.dropDuplicates(list(keys))
        before = outputs(spark, path)
        if before is not None:
            earlier = before.filter(F.col("batch") < number).select(*keys).distinct()
            fresh = fresh.join(earlier, list(keys), "left_anti")
        work(fresh).write.mode("overwrite").parquet(f"{path}/batch={number}")
        if files_done:
            files_done(number)

    query = source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def chain(source: DataFrame, steps: Sequence[tuple[str, Sequence[str], Callable[[DataFrame], DataFrame]]], path: str) -> DataFrame | None:
    """Runs steps (name, keys, work) one after the other over what is new: each reads as a stream what the one before has written.

    Outputs and checkpoints lie in path, by the step's name.  A run that dies leaves finished batches finished, in every step; the next run goes on from there.
    Gives the outputs of the last step, or None while there are none.
    """
    spark, found = source.sparkSession, None
    for name, keys, work in steps:
        advance(source, work, keys, f"{path}/{name}/out", f"{path}/{name}/state")
        found = outputs(spark, f"{path}/{name}/out")
        if found is None:
            return None
        source = spark.readStream.schema(found.drop("batch").schema).option("recursiveFileLookup", True).parquet(f"{path}/{name}/out")
    return found
