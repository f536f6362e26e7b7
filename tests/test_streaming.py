import random

import pytest
from pyspark.sql import functions as F

from quarry.operators.events import consecutive_dedup
from quarry.plans import stream_queries
from quarry.streaming.dedup import consecutive_dedup_stream
from quarry.streaming.ordered import late_counts, on_time, ordered_dedup_stream, run_to_end
from quarry.streaming.runner import read_table_stream, run_available
from tests.conftest import SF001


def test_stream_dedup_equals_batch(spark):
    got = stream_queries.stream_dedup(spark, SF001)
    ev = spark.read.parquet(f"{SF001}/events.parquet")
    exp = consecutive_dedup(ev, "user_id", ["ts", "event_id"], "event_type")
    assert sorted(r.event_id for r in got.collect()) == sorted(r.event_id for r in exp.collect())


def test_stream_state_carries_across_triggers(spark, scratch):
    rows1 = [("c", "2024-01-01 00:00:01", 1, "a"), ("c", "2024-01-01 00:00:02", 2, "a")]
    rows2 = [("c", "2024-01-01 00:00:03", 3, "a"), ("c", "2024-01-01 00:00:04", 4, "b"),
             ("c", "2024-01-01 00:00:05", 5, "")]
    schema = "conv string, ts string, n int, id string"
    spark.createDataFrame(rows1, schema).selectExpr("conv", "cast(ts as timestamp) ts", "n", "id").coalesce(1) \
        .write.parquet(f"{scratch}/in/b1")
    spark.createDataFrame(rows2, schema).selectExpr("conv", "cast(ts as timestamp) ts", "n", "id").coalesce(1) \
        .write.parquet(f"{scratch}/in/b2")
    sch = spark.read.parquet(f"{scratch}/in/b1").schema
    s = spark.readStream.schema(sch).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true") \
        .parquet(f"{scratch}/in")
    out = run_available(consecutive_dedup_stream(s, "conv", "ts", "n", "id"), "t_state",
                        sink=f"{scratch}/out", checkpoint=f"{scratch}/ck")
    assert sorted(r.n for r in out.collect()) == [1, 4, 5]


def test_stream_extract_matches_batch(spark):
    from quarry.plans import extract_queries as XQ
    got = stream_queries.stream_extract(spark, SF001)
    exp = XQ.extract_flat(spark, SF001)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, exp.collect()))


def _write(spark, folder, files, schema="conv string, ts string, n int, id string"):
    """One file per list of rows, in that order of arrival."""
    for rows in files:
        spark.createDataFrame(rows, schema).withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1) \
            .write.mode("append").parquet(f"{folder}/events.parquet")


def test_late_files_over_several_triggers_equal_batch(spark, scratch):
    """Files hold late rows: A@1, A@3 come before B@2, and the batch rule keeps all three."""
    _write(spark, scratch, [
        [("c", "2024-01-01 00:00:01", 1, "A"), ("c", "2024-01-01 00:00:03", 3, "A")],
        [("c", "2024-01-01 00:00:02", 2, "B"), ("d", "2024-01-01 00:00:02", 4, "B")],
        [("d", "2024-01-01 00:00:01", 5, "B"), ("c", None, 6, "A"), ("d", "2024-01-01 00:00:09", 7, ""),
         (None, "2024-01-01 00:00:01", 8, "A"), (None, "2024-01-01 00:00:02", 9, "A")]])
    out = run_to_end(read_table_stream(spark, scratch, "events", max_files=1), "conv", "ts", "n", "id", "t_order")
    exp = consecutive_dedup(spark.read.parquet(f"{scratch}/events.parquet"), "conv", ["ts", "n"], "id")
    assert sorted(r.n for r in on_time(out).collect()) == sorted(r.n for r in exp.collect()) == [2, 3, 5, 6, 7, 8, 9]
    assert out.where("late").count() == 0
    assert on_time(out).schema == spark.read.parquet(f"{scratch}/events.parquet").schema


def test_shuffled_arrival_within_the_bound_equals_batch(spark, scratch):
    """Every row comes up to 50 minutes late over six triggers; the state empties at the end."""
    rng = random.Random(1)
    rows = [(rng.choice("ab"), f"2024-01-01 {n // 60:02d}:{n % 60:02d}:00", n, rng.choice(["A", "A", "B", "", None]))
            for n in range(300)]
    arrival = sorted(rows, key=lambda r: r[2] + rng.random() * 50)
    _write(spark, scratch, [arrival[k:k + 50] for k in range(0, 300, 50)])
    out = run_to_end(read_table_stream(spark, scratch, "events", max_files=1), "conv", "ts", "n", "id", "t_shuffled",
                     lateness="1 hour", checkpoint=f"{scratch}/ck")
    exp = consecutive_dedup(spark.read.parquet(f"{scratch}/events.parquet"), "conv", ["ts", "n"], "id")
    assert sorted(map(repr, on_time(out).collect())) == sorted(map(repr, exp.collect()))
    assert out.where("late").count() == 0


def test_rows_beyond_the_bound_are_set_aside_and_counted(spark, scratch):
    """With a bound of one minute, a row an hour late goes to the side output; what has left stays right."""
    _write(spark, scratch, [
        [("c", "2024-01-01 10:00:00", 1, "A"), ("c", "2024-01-01 12:00:00", 2, "A")],
        [("c", "2024-01-01 13:00:00", 3, "B")],
        [("c", "2024-01-01 11:00:00", 4, "B"), ("c", "2024-01-01 09:00:00", 5, "A"), ("d", "2024-01-01 01:00:00", 6, "A")],
        [("c", "2024-01-01 14:00:00", 7, "B")]])
    out = run_to_end(read_table_stream(spark, scratch, "events", max_files=1), "conv", "ts", "n", "id", "t_beyond",
                     lateness="1 minute")
    late = sorted(r.n for r in out.where("late").collect())
    # 4 is behind the watermark but after all that has left of c, 6 is old but first of d: both can still be placed
    assert late == [5]
    on = spark.read.parquet(f"{scratch}/events.parquet").where(~F.col("n").isin(late))
    exp = consecutive_dedup(on, "conv", ["ts", "n"], "id")
    assert sorted(r.n for r in on_time(out).collect()) == sorted(r.n for r in exp.collect()) == [1, 2, 3, 4, 6]
    assert [tuple(r) for r in late_counts(out, "conv").collect()] == [("c", 1)]


def test_only_rows_within_the_bound_stay_in_state(spark, scratch):
    """A first run releases everything the watermark has passed and holds the rest."""
    _write(spark, scratch, [[("c", f"2024-01-01 {h:02d}:00:00", h, str(h))] for h in range(6)])
    stream = read_table_stream(spark, scratch, "events", max_files=1)
    held = run_available(ordered_dedup_stream(stream, "conv", "ts", "n", "id", "90 minutes"), "t_held")
    assert sorted(r.n for r in held.collect()) == [0, 1, 2, 3]         # 4 and 5 lie within 90 minutes of 05:00
    with pytest.raises(ValueError):
        ordered_dedup_stream(stream.withColumn("late", F.lit(1)), "conv", "ts", "n", "id")
