"""Global 1-based row ordinal without a single-partition window.

``row_number() over (order by k)`` moves every row into one task.  Here the
data is range-partitioned on the order keys (sampled bounds split even a
hot key prefix across tasks), sorted inside each partition, and numbered
``offset(partition) + position``.  Offsets come from one count per
partition, a table with as many rows as partitions, so broadcasting it is
bounded by construction.  The numbered data is written once as Parquet in
the shared scratch folder (``spark.checkpoint.dir``) so that every later
use sees the same numbering even if an executor is lost and a stage is
recomputed.  The range count follows the optimizer's size estimate, so
partitions stay near 128 MB as the data grows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import ensure_checkpoint_dir, estimated_partitions, materialize


def with_ordinal(df: DataFrame, order: list[str | Column], name: str = "rn",
                 partitions: int | None = None, total: str | None = None) -> DataFrame:
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = partitions or estimated_partitions(df)
    numbered = materialize(df.repartitionByRange(n, *order).sortWithinPartitions(*order)
                           .withColumn("__pid", F.spark_partition_id())
                           .withColumn("__mid", F.monotonically_increasing_id()), "ordinal")
    counts = numbered.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"),
                                           F.min("__mid").alias("__base"))
    before = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("__off", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    if total:
        offsets = offsets.withColumn("__total", F.sum("__n").over(Window.partitionBy()))
    out = numbered.join(F.broadcast(offsets.drop("__n")), "__pid")
    out = out.withColumn(name, F.col("__off") + (F.col("__mid") - F.col("__base")) + 1)
    if total:
        out = out.withColumnRenamed("__total", total)
    return out.drop("__pid", "__mid", "__base", "__off")
