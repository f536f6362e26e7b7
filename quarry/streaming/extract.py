"""Continuous extraction of arriving comments (rule or model extractor)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from quarry.operators import extract as X


def extract_stream(stream: DataFrame, text_col: str = "Comments",
                   make_extractor: Callable | None = None, partitions: int | None = None) -> DataFrame:
    """Same columns as the batch job; stateless, so each trigger is independent."""
    if make_extractor is None:
        return X.extract_rules(stream, text_col)
    return X.extract_with_model(stream, make_extractor, text_col, partitions=partitions)
