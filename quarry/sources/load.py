"""One switch for where tables come from."""

from __future__ import annotations

from pyspark.sql import SparkSession

from quarry.operators.tables import Tables
from quarry.sources.files import load_folder
from quarry.sources.sql import load_sql_tables

KINDS = {"files": load_folder, "jdbc": load_sql_tables}


def load_source(spark: SparkSession, kind: str, *args, **options) -> Tables:
    """A catalogue of a folder (``files``) or a database (``jdbc``), by a flag in any case."""
    if kind.lower() not in KINDS:
        raise ValueError(f"Unknown source kind: {kind!r}; known: {sorted(KINDS)}")
    return KINDS[kind.lower()](spark, *args, **options)
