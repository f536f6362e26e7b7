"""Consecutive-duplicate suppression for message/event logs.

Rule: within one conversation, in time order, drop an event whose id
equals the id of the last *non-empty* id seen before it.  Empty ids always
pass and never update the state; blank messages are skipped first.

Empty-id rows are independent of everything, so they are set aside.  For
the rest the rule is "differs from the previous row of the same
conversation", which is ``lag`` over the conversation.  A hot conversation
would put its rows into one task, so it is cut into stretches of time of
about ``STRETCH_ROWS`` rows; ``lag`` runs inside a stretch, and the first row
of a stretch gets the last id of the stretch before it.  That *carry* is one
row per stretch of a hot conversation: the table is shuffled once, never
joined with itself, and nothing of it is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.text import PY_WHITESPACE

#: Rows of one conversation that one task takes, about; a larger conversation is cut into stretches of time.
STRETCH_ROWS = 1_000_000


def skip_blank(df: DataFrame, text_col: str) -> DataFrame:
    """Drop messages whose text is NULL or whitespace only."""
    return df.where(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), PY_WHITESPACE, "") != "")


def _scale(dtype: T.DataType, c):
    """A number that grows with an order column, to cut it evenly; None if the type has no such number."""
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.unix_micros(c.cast("timestamp")).cast("double")
    return c.cast("double") if isinstance(dtype, T.NumericType) else None


def _stretches(rows: DataFrame, key: str, first: str, stretch_rows: int) -> DataFrame:
    """``rows`` with ``__part``: the stretch of time of each row of a conversation of more than ``stretch_rows`` rows.

    Stretches are equally wide in the first order column, so equal values share
    one and a row of a later stretch is a later row.  Nulls and NaN (first and
    last in order) have stretches of their own.  Conversations that fit have no
    stretches (null).  The broadcast table has a row per conversation of more
    than ``stretch_rows`` rows: at most rows / ``stretch_rows``.
    """
    at = _scale(rows.schema[first].dataType, F.col(f"`{first}`"))
    if at is None:
        return rows.withColumn("__part", F.lit(None).cast("int"))
    real = F.when(~F.isnan(at), at)
    hot = (rows.groupBy(F.col(f"`{key}`").alias("__hot"))
           .agg(F.count(F.lit(1)).alias("__n"), F.min(real).alias("__lo"), F.max(real).alias("__hi"))
           .where(F.col("__n") > stretch_rows))
    parts = F.ceil(F.col("__n") / stretch_rows)
    width = F.greatest((F.col("__hi") - F.col("__lo")) / parts, F.lit(1e-300))
    part = (F.when(F.col("__hot").isNull(), None).when(at.isNull(), -1).when(F.isnan(at), parts + 1)
            .otherwise(F.least(F.floor((at - F.col("__lo")) / width), parts)))
    return (rows.join(F.broadcast(hot), F.col(f"`{key}`") == F.col("__hot"), "left")
            .withColumn("__part", part.cast("int")).drop("__hot", "__n", "__lo", "__hi"))


def consecutive_dedup(df: DataFrame, key: str, order: list[str], id_col: str,
                      stretch_rows: int = STRETCH_ROWS) -> DataFrame:
    """Rows kept by the last-non-empty-id rule, all input columns.

    Rows without a conversation are never compared.  Stretches follow the
    first order column where it is a number, date or time; by a text a hot
    conversation stays in one task.
    """
    k, ident = F.col(f"`{key}`"), F.col(f"`{id_col}`")
    free = F.coalesce(ident.cast("string"), F.lit("")) == ""
    passthrough = df.where(free | k.isNull())
    rows = _stretches(df.where(~free & k.isNotNull()), key, order[0], stretch_rows)
    in_order = [F.col(f"`{c}`") for c in order]

    carry = rows.where(F.col("__part").isNotNull()).groupBy(k.alias("__key"), F.col("__part").alias("__at")).agg(
        F.max_by(ident, F.struct(*in_order)).alias("__id"))
    carry = carry.select("__key", "__at", F.lag("__id").over(Window.partitionBy("__key").orderBy("__at")).alias("__carry"))

    here = Window.partitionBy(k, F.col("__part")).orderBy(*in_order)
    rows = rows.withColumn("__before", F.lag(ident).over(here))
    rows = rows.join(F.broadcast(carry), (k == F.col("__key")) & (F.col("__part") == F.col("__at")), "left")
    before = F.coalesce("__before", "__carry")
    kept = rows.where(before.isNull() | (before != ident)).select(*[F.col(f"`{c}`") for c in df.columns])
    return kept.unionByName(passthrough)
