"""Registered plans for the streaming twins.

Each reads the given table as a file stream, runs the stream to completion
(``availableNow``) into a checkpointed Parquet sink and returns the sink.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from quarry.plans import extract_queries as XQ
from quarry.plans import notes_queries as NQ
from quarry.plans import shape_queries as SQ
from quarry.session import scratch_path
from quarry.streaming.extract import extract_stream
from quarry.streaming.model import ModelStream
from quarry.streaming.ordered import on_time, run_to_end
from quarry.streaming.runner import read_table_stream, run_available


def stream_dedup(spark, sf_dir) -> DataFrame:
    """E2 over the whole table, in event-time order whatever the order of its files (up to a day late)."""
    stream = read_table_stream(spark, sf_dir, "events")
    return on_time(run_to_end(stream, "user_id", "ts", "event_id", "event_type", "stream_dedup", lateness="1 day"))


def stream_extract(spark, sf_dir) -> DataFrame:
    s = read_table_stream(spark, sf_dir, "part").selectExpr(
        "p_partkey as id", f"{XQ.COMMENT_CASE} as Comments")
    return run_available(extract_stream(s), "stream_extract")


def stream_model(spark, sf_dir) -> DataFrame:
    """X1/X11 on a stream: every distinct note is asked for once, the answers kept in a ledger."""
    s = read_table_stream(spark, sf_dir, "part").selectExpr("p_partkey as id", f"{NQ.NOTE_CASE} as Comments")
    m = ModelStream(spark, scratch_path(spark, "model-stream"), NQ.answers, group=256)
    m.run(s, scratch_path(spark, "model-stream-ckpt"))
    return m.results()


QUERIES = {"stream_dedup": stream_dedup, "stream_extract": stream_extract, "stream_model": stream_model}
ORACLE = {"stream_dedup": SQ.ORACLE["consecutive_dedup"], "stream_extract": XQ.ORACLE["extract_flat"],
          "stream_model": NQ.ORACLE["model_extract"]}
