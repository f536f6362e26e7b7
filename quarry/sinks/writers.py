"""Sinks (K1-K3, K5): timestamped batch output, exports, publishing."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.names import col
from quarry.functions.values import as_text
from quarry.operators.session_results import forget, recall
from quarry.operators.tables import Tables, view_name


def timestamped_name(base: str, now: datetime | None = None) -> str:
    """K1: ``yyyyMMddHHmmss_<base>``; the prefix marks the output as primary."""
    return f"{(now or datetime.now()).strftime('%Y%m%d%H%M%S')}_{base}"


def write_timestamped(df: DataFrame, folder: str, base: str, fmt: str = "parquet",
                      now: datetime | None = None) -> str:
    """K1: write a new run; never overwrites an earlier one (errorifexists)."""
    path = f"{folder.rstrip('/')}/{timestamped_name(base, now)}"
    df.write.mode("errorifexists").format(fmt).option("header", "true").save(path)
    return path


def blank_filled(df: DataFrame) -> DataFrame:
    """K3: every column as text (numbers as they are read, no E notation up to 1e16), NULL and NaN -> '', column order kept."""
    cells = []
    for f in df.schema.fields:
        c = col(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(~F.isnan(c), c)
        cells.append(F.coalesce(as_text(c, f.dataType), F.lit("")).alias(f.name))
    return df.select(*cells)


def export(df: DataFrame, folder: str, table: str, fmt: str = "csv") -> tuple[str | None, int]:
    """K2/K3: export a result as ``<table>_<8 hex>``; returns (path, rows).

    Zero rows: no files, ``(None, 0)``.  The plan runs once: the row count is
    observed during the write itself (``DataFrame.observe``), and an empty
    write is taken back.
    """
    obs = Observation(f"export_{uuid.uuid4().hex[:8]}")
    path = f"{folder.rstrip('/')}/{table}_{uuid.uuid4().hex[:8]}"
    out = blank_filled(df).observe(obs, F.count(F.lit(1)).alias("rows"))
    out.write.mode("errorifexists").format(fmt).option("header", "true").save(path)
    rows = int(obs.get["rows"])
    if rows:
        return path, rows
    target = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)
    return None, 0


def export_last(spark: SparkSession, conversation: str, folder: str, tables: Tables | None = None, table: str = "",
                filter_column: str = "", filter_value: str = "", fmt: str = "csv") -> tuple[str | None, int, str]:
    """K2: export a conversation's last result and forget it; (path, rows, message).

    A last result goes first: table and filter are then ignored.  Without one
    the named table is exported, filtered as ``Tables.get_rows`` does.
    """
    last = recall(spark, conversation)
    if last is not None:
        path, rows = export(last, folder, "result", fmt)
        forget(spark, conversation)
    elif tables is not None and table:
        name = tables.resolve_table(table)
        path, rows = export(tables.get_rows(name, filter_column, filter_value), folder, view_name(name), fmt)
    else:
        return None, 0, "There is no result to export; name a table."
    return path, rows, f"{rows} rows exported." if path else "No rows matched."


def publish(df: DataFrame, path: str, partition_by: list[str] | None = None,
            fmt: str = "parquet") -> None:
    """K5: append enriched rows to a partitioned dataset for downstream jobs."""
    w = df.write.mode("append").format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)
