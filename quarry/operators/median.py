"""Exact medians of groups of any size, by distributed selection.

``median`` as an aggregate function holds the values of a group in one buffer.
Here equal values are counted first (a hash aggregate by group and value, so a
hot group is spread over its values), the counts are cut into ranges of
(group, value), and each range knows how many values of its groups lie in it.
Running totals over those few numbers show in which range the middle of a
group lies; only the rows of that range are put in order, and the one or two
in the middle are read off.  No task sees more of a group than one range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import discard, estimated_partitions, materialize


def exact_median(df: DataFrame, keys: list[Column], value: Column, partitions: int | None = None) -> DataFrame:
    """(k0, k1, ..., median): the middle value of each group, or the mean of the two in the middle.

    Null values do not count; a group without any other has no row.  Null keys
    form groups of their own.  ``partitions`` is the number of ranges (default:
    by the input's size).
    """
    names = [f"k{i}" for i in range(len(keys))]
    rows = df.select(*[k.alias(n) for k, n in zip(keys, names, strict=True)], value.cast("double").alias("v"))
    counts = rows.where(F.col("v").isNotNull()).groupBy(*names, "v").agg(F.count(F.lit(1)).alias("c"))
    n = partitions or estimated_partitions(df)
    counts = materialize(counts.repartitionByRange(n, *names, "v").withColumn("part", F.spark_partition_id()), "median")

    whole = Window.partitionBy(*names)
    parts = counts.groupBy(*names, "part").agg(F.sum("c").alias("here"))
    parts = parts.withColumn("n", F.sum("here").over(whole)).withColumn(
        "before", F.coalesce(F.sum("here").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    parts = parts.withColumn("low", F.expr("(n + 1) DIV 2")).withColumn("high", F.expr("n DIV 2 + 1"))
    parts = parts.where("before < high AND before + here >= low").select(
        *[F.col(k).alias(f"__{k}") for k in names], F.col("part").alias("__part"), "before", "low", "high")

    on = F.col("part") == F.col("__part")
    for k in names:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    upto = F.sum("c").over(Window.partitionBy(*names, "part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    rows = counts.join(parts, on).withColumn("upto", F.col("before") + upto)
    middle = lambda rank: F.max(F.when((F.col("upto") >= F.col(rank)) & (F.col("upto") - F.col("c") < F.col(rank)),
                                       F.col("v")))
    out = rows.groupBy(*names).agg(((middle("low") + middle("high")) / 2).alias("median"))
    out = materialize(out, "medians")
    discard(counts)
    return out
