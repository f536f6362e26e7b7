"""A stored dictionary of a text column's values.

Resolving a value needs the distinct values of a column, not its rows.  The
dictionary keeps them with their counts and is refreshed by new files only
(:mod:`quarry.operators.file_summary`); a lookup reads the dictionary alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.names import col
from quarry.operators.file_summary import FileSummary


class ValueDictionary(FileSummary):
    """(v, n): every distinct value of one text column and its number of rows."""

    schema = "v string, n long"

    def __init__(self, spark: SparkSession, root: str, table: str, column: str, files: Callable[[], list[str]],
                 read: Callable[[list[str]], DataFrame]):
        super().__init__(spark, root, f"{len(table)}:{table}{column}", files, read)
        self.column = column

    def summarise(self, rows: DataFrame) -> DataFrame:
        values = rows.select(col(self.column).alias("v")).where("v IS NOT NULL")
        return values.groupBy("v").agg(F.count(F.lit(1)).alias("n"))

    def merge(self, parts: DataFrame) -> DataFrame:
        return parts.groupBy("v").agg(F.sum("n").alias("n"))
