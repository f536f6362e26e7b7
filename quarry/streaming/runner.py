"""Run a streaming DataFrame into a Parquet sink with a checkpoint.

The file sink plus checkpoint gives exactly-once output across restarts
and executor loss.  Paths default to fresh folders under
``spark.checkpoint.dir`` (shared storage on a cluster).
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from quarry.session import is_folder, scratch_path

#: Bytes of input files that one trigger takes at most (what a stateful key can hold in memory).
TRIGGER_BYTES = 1 << 30


def run_available(stream: DataFrame, name: str, sink: str | None = None,
                  checkpoint: str | None = None, timeout_s: int | None = None) -> DataFrame:
    """Process everything available now, then return the sink as a batch DataFrame.

    There is no time limit unless ``timeout_s`` sets one.
    """
    spark = stream.sparkSession
    sink = sink or scratch_path(spark, f"{name}-out")
    checkpoint = checkpoint or scratch_path(spark, f"{name}-ckpt")
    q = (stream.writeStream.format("parquet").option("path", sink)
         .option("checkpointLocation", checkpoint).outputMode("append")
         .trigger(availableNow=True).queryName(name).start())
    if timeout_s is None:
        q.awaitTermination()
    else:
        q.awaitTermination(timeout_s)
    if q.isActive:
        q.stop()
        raise TimeoutError(f"stream {name} did not finish in {timeout_s}s")
    if q.exception():
        raise RuntimeError(str(q.exception()))
    return spark.read.schema(stream.schema).parquet(sink)


def read_table_stream(spark, directory: str, table: str, max_files: int | None = None,
                      max_bytes: int = TRIGGER_BYTES) -> DataFrame:
    """A file stream over ``<table>.parquet`` of a directory, a single file or a folder of parts."""
    path = f"{directory}/{table}.parquet"
    r = spark.readStream.schema(spark.read.parquet(path).schema)
    r = r.option("maxFilesPerTrigger", max_files) if max_files else r.option("maxBytesPerTrigger", max_bytes)
    if is_folder(spark, path):
        return r.parquet(path)
    return r.option("pathGlobFilter", f"{table}.parquet").parquet(directory)
