"""Consecutive-duplicate suppression on a stream, with bounded state.

State per conversation is the last non-empty id, nothing else.  Rows of one
key inside one micro-batch are ordered by event time before the rule is
applied, so a stream fed the same rows in one trigger gives exactly the batch
result (:func:`quarry.operators.events.consecutive_dedup`).  Across triggers
the order of arrival counts: a row that arrives in a later trigger than rows
after it is compared with the last id seen, so it can be dropped where the
batch rule keeps it, or kept where that drops it.  There is no watermark and no
timeout, so every row leaves in the trigger it came in.  Where the order of
events matters more than delay, :mod:`quarry.streaming.ordered` waits for late
rows and gives the batch result.
Memory per key per trigger is bounded by the trigger size
(``maxBytesPerTrigger``).

``dropDuplicatesWithinWatermark`` is not the same rule: it drops
non-adjacent repeats too.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def consecutive_dedup_stream(stream: DataFrame, key: str, ts_col: str, tiebreak: str,
                             id_col: str) -> DataFrame:
    empty = F.coalesce(F.col(id_col), F.lit("")) == ""
    schema = stream.schema
    passthrough = stream.where(empty)

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches), ignore_index=True)
        if pdf.empty:
            return
        pdf = pdf.sort_values([ts_col, tiebreak], kind="mergesort", na_position="first")
        last = state.get[0] if state.exists else None
        ids = pdf[id_col].tolist()
        keep = [i != p for i, p in zip(ids, [last] + ids[:-1])]
        state.update((ids[-1],))
        yield pdf.loc[keep]

    kept = stream.where(~empty).groupBy(key).applyInPandasWithState(
        step, schema, "last_id string", "append", GroupStateTimeout.NoTimeout)
    return kept.unionByName(passthrough)
