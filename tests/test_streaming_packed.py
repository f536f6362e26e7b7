"""The ordered stream keeps rows packed: state does not grow by an entry per row, and every value comes back as it was."""

import random

from pyspark.sql import functions as F

from quarry.operators.events import consecutive_dedup
from quarry.streaming.ordered import BUCKETS, on_time, ordered_dedup_stream, run_to_end
from quarry.streaming.runner import read_table_stream


def _write(spark, folder, rows, schema):
    (spark.createDataFrame(rows, schema).withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1)
     .write.mode("append").parquet(f"{folder}/events.parquet"))


def test_conversations_that_wait_share_their_state_entries(spark, scratch):
    _write(spark, scratch, [(f"c{n % 4000}", f"2024-01-01 00:{n // 60 % 60:02d}:{n % 60:02d}", n, "AB"[n // 4000])
                            for n in range(8000)], "conv string, ts string, n int, id string")
    stream = ordered_dedup_stream(read_table_stream(spark, scratch, "events"), "conv", "ts", "n", "id", "1 day")
    q = (stream.writeStream.format("noop").option("checkpointLocation", f"{scratch}/ck").outputMode("append")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    state = q.lastProgress["stateOperators"][0]
    assert 0 < state["numRowsTotal"] <= 3 * BUCKETS                       # before: one per conversation, 4000


def test_every_type_and_null_comes_back_as_it_was(spark, scratch):
    """Large whole numbers beside nulls, doubles, decimals, arrays and structs over three files equal the batch rule."""
    rng = random.Random(3)
    schema = "conv string, ts string, n long, id string, big long, d double, m decimal(20,3), a array<long>, s struct<x:int,t:string>"
    for f in range(3):
        rows = [(rng.choice(["a", "b", "", None]), None if k % 29 == 0 else f"2024-01-01 {f:02d}:{k // 2:02d}:00",
                 None if k % 31 == 5 else (1 << 60) + 100 * f + k, rng.choice(["A", "B", "", None]),
                 None if k % 3 else (1 << 60) + k, rng.choice([None, 0.1, float("inf")]), None, [k, None],
                 None if k % 5 == 0 else (k, None)) for k in range(100)]
        _write(spark, scratch, rows, schema)
    out = run_to_end(read_table_stream(spark, scratch, "events"), "conv", "ts", "n", "id", "t_types", lateness="1 day")
    table = spark.read.parquet(f"{scratch}/events.parquet")
    assert out.where("late").count() == 0
    got, exp = on_time(out), consecutive_dedup(table, "conv", ["ts", "n"], "id")
    assert got.schema == table.schema
    assert sorted(map(repr, got.collect())) == sorted(map(repr, exp.collect()))
