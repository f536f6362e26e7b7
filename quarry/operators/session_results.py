"""P5: the last result of one conversation, kept per conversation.

The reference kept one buffer shared by all conversations (a leak across
users).  Here each conversation gets its own temp view.
"""

from __future__ import annotations

import hashlib

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def _view(conversation: str) -> str:
    """One view per conversation id; ids that differ in any character never share one."""
    return "last_result_" + hashlib.sha256(conversation.encode()).hexdigest()[:32]


def remember(df: DataFrame, conversation: str) -> DataFrame:
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    df.createOrReplaceTempView(_view(conversation))
    return df


def recall(spark: SparkSession, conversation: str) -> DataFrame | None:
    name = _view(conversation)
    return spark.table(name) if spark.catalog.tableExists(name) else None


def forget(spark: SparkSession, conversation: str) -> None:
    name = _view(conversation)
    if spark.catalog.tableExists(name):
        spark.table(name).unpersist()
        spark.catalog.dropTempView(name)
