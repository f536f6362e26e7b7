"""P1 on a stored result: any page by reading one file, or two where a page spans their border.

A result is written once, in ranges of its order, one folder a range, each row
with its place in the range.  The manifest says at which row of the whole a
range begins; it has a row per range.  A page looks up its ranges there and
reads those rows of those files.  ``remove`` deletes data and manifest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.names import col
from quarry.operators.results import CHUNK_ROWS
from quarry.session import estimated_partitions, scratch_path


class StoredResult:
    """A result under ``path``: ``rows/part=<k>`` and ``manifest`` (part, first, n)."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType):
        self.spark, self.path, self.columns = spark, path, schema.names
        self.reader = spark.read.schema(T.StructType([*schema.fields, T.StructField("__at", T.LongType())]))
        self.manifest = spark.read.schema("part int, first long, n long").parquet(f"{path}/manifest")
        self.total = int(self.manifest.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])

    def page(self, number: int, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
        """Page ``number`` (from 0) in order: the rows and ``rn`` (from 1 over the whole result).

        A data column called ``rn`` is kept as ``rn_data``; a page beyond the end is empty.
        """
        low, high = number * chunk_rows + 1, min((number + 1) * chunk_rows, self.total)
        parts = [(r.part, r["first"]) for r in self.manifest.where(
            (F.col("first") <= high) & (F.col("first") + F.col("n") > low)).orderBy("first").collect()]
        rows = None
        for part, first in parts:
            one = self.reader.parquet(f"{self.path}/rows/part={part}")
            one = one.where(F.col("__at").between(low - first, high - first))
            one = one.select((F.col("__at") + first).alias("__rn"), *[col(c) for c in self.columns])
            rows = one if rows is None else rows.unionByName(one)
        if rows is None:
            rows = self.reader.parquet(f"{self.path}/rows").where("false").select(
                F.col("__at").alias("__rn"), *[col(c) for c in self.columns])
        if "rn" in self.columns:
            rows = rows.withColumnRenamed("rn", "rn_data")
        return rows.withColumnRenamed("__rn", "rn").orderBy("rn")

    def pages(self, chunk_rows: int = CHUNK_ROWS) -> int:
        return -(-self.total // chunk_rows)

    def remove(self) -> None:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)


def store(df: DataFrame, order: list[str], path: str | None = None, partitions: int | None = None) -> StoredResult:
    """Write ``df`` for paging in ``order``; ``path`` must not exist (default: a folder in the shared scratch space)."""
    spark = df.sparkSession
    path = path or scratch_path(spark, "result")
    keys = [col(c) for c in order]
    ranged = df.repartitionByRange(partitions or estimated_partitions(df), *keys).sortWithinPartitions(*keys)
    # in one partition the ids count up by one from part << 33
    ranged = ranged.withColumn("part", F.spark_partition_id()).withColumn(
        "__at", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33))
    ranged.write.partitionBy("part").parquet(f"{path}/rows")
    written = spark.read.schema("__at long, part int").parquet(f"{path}/rows")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)      # one row a range
    counts = written.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    counts.select("part", (F.coalesce(F.sum("n").over(before), F.lit(0)) + 1).alias("first"), "n") \
        .coalesce(1).write.parquet(f"{path}/manifest")
    return StoredResult(spark, path, df.schema)
