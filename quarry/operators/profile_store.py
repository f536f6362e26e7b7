"""M1 as a stored profile: sketches per column, merged as files arrive.

Every batch of new files leaves one row per column: rows, missing values, least
and greatest value as text, a HyperLogLog sketch of the distinct values and a
KLL sketch of the numbers.  The profile of the whole table is the union of
those rows, so a table that has grown is profiled by reading its new files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.names import col
from quarry.operators.file_summary import FileSummary

#: Sketch sizes: 2 ** LG_K registers (standard error 0.8 %), KLL_K items a level (rank error about 1.3 %).
LG_K, KLL_K = 14, 200
NESTED = (T.ArrayType, T.MapType, T.StructType)


def _present(name: str, dtype: T.DataType) -> Column:
    """The column with NaN as missing."""
    return F.when(~F.isnan(col(name)), col(name)) if isinstance(dtype, (T.DoubleType, T.FloatType)) else col(name)


class ProfileStore(FileSummary):
    """The stored profile of one table of files."""

    schema = ("column_name string, data_type string, ordinal int, row_count long, null_count long, "
              "distinct_sketch binary, number_sketch binary")

    def __init__(self, spark: SparkSession, root: str, table: str, files: Callable[[], list[str]],
                 read: Callable[[list[str]], DataFrame]):
        super().__init__(spark, root, f"profile:{table}", files, read)

    def summarise(self, rows: DataFrame) -> DataFrame:
        """One pass over the rows for all columns."""
        none = F.lit(None).cast("binary")
        cells = []
        for i, f in enumerate(rows.schema.fields):
            value = _present(f.name, f.dataType)
            distinct = none if isinstance(f.dataType, NESTED) else F.hll_sketch_agg(value.cast("string"), LG_K)
            numbers = F.kll_sketch_agg_double(value.cast("double"), KLL_K) if isinstance(f.dataType, T.NumericType) else none
            cells.append(F.struct(F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("data_type"),
                                  F.lit(i + 1).alias("ordinal"), F.count(F.lit(1)).alias("row_count"),
                                  (F.count(F.lit(1)) - F.count(value)).alias("null_count"),
                                  distinct.alias("distinct_sketch"), numbers.alias("number_sketch")))
        return rows.agg(F.array(*cells).alias("cells")).select(F.explode("cells").alias("c")).select("c.*")

    def merge(self, parts: DataFrame) -> DataFrame:
        """One row per column; a column's rows are as many as there are batches."""
        return parts.groupBy("column_name", "data_type", "ordinal").agg(
            F.sum("row_count").alias("row_count"), F.sum("null_count").alias("null_count"),
            F.hll_union_agg("distinct_sketch").alias("distinct_sketch"),
            F.kll_merge_agg_double("number_sketch").alias("number_sketch"))

    def profile(self) -> DataFrame:
        """column_name, data_type, ordinal, row_count, null_count, approx_distinct (null for nested types) and
        approx_median (null but for numbers), as of the last refresh."""
        some = (F.col("row_count") > F.col("null_count")) & F.col("data_type").rlike(
            r"^(tinyint|smallint|int|bigint|float|double|decimal\(.*)$")
        return self.values().select(
            "column_name", "data_type", "ordinal", "row_count", "null_count",
            F.when(~F.col("data_type").rlike("^(array|map|struct)<"), F.hll_sketch_estimate("distinct_sketch"))
            .alias("approx_distinct"),
            F.when(some, F.kll_sketch_get_quantile_double("number_sketch", F.lit(0.5))).alias("approx_median"))
