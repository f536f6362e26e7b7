"""Columns by their whole name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(name: str) -> Column:
    """The column of exactly this name: dots and back-ticks in it are part of the name."""
    return F.col("`" + name.replace("`", "``") + "`")
