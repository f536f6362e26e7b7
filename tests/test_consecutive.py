"""Consecutive-duplicate removal against a plain loop, with hot conversations cut into stretches."""
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quarry.operators.events import consecutive_dedup

T0 = datetime(2024, 1, 1)


def plain(rows):
    """rows: (key, at, n, id); the rule, row by row."""
    kept, last = [], {}
    for key, at, n, ident in sorted(rows, key=lambda r: (r[1] is not None, r[1] or T0, r[2])):
        if not ident or key is None:
            kept.append(n)
        else:
            if last.get(key) != ident:
                kept.append(n)
            last[key] = ident
    return sorted(kept)


def log(seed, hot_share=.6, n=900):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        key = "hot" if rng.random() < hot_share else rng.choice(["a", "b", "c", None])
        # bursts: most of the time passes within a few rows, many rows share a second
        at = None if rng.random() < .03 else T0 + timedelta(seconds=rng.choice([k // 7, k // 7, 40_000 + k]))
        rows.append((key, at, k, rng.choice(["x", "x", "y", "", None])))
    return rows


@pytest.mark.parametrize("stretch", [1_000_000, 50, 7, 1])
def test_equals_the_plain_rule_whatever_the_stretch(spark, stretch):
    rows = log(stretch)
    df = spark.createDataFrame(rows, "key string, at timestamp, n int, id string").repartition(5)
    got = consecutive_dedup(df, "key", ["at", "n"], "id", stretch_rows=stretch)
    assert got.columns == df.columns
    assert sorted(r.n for r in got.collect()) == plain(rows)


def test_number_text_and_date_order_columns(spark):
    rows = log(3, n=300)
    df = spark.createDataFrame(rows, "key string, at timestamp, n int, id string")
    by_number = df.withColumn("at", F.unix_micros("at") / 7.0)
    by_text = df.withColumn("at", F.date_format("at", "yyyy-MM-dd HH:mm:ss"))
    for frame in (by_number, by_text):
        got = consecutive_dedup(frame, "key", ["at", "n"], "id", stretch_rows=20)
        assert sorted(r.n for r in got.collect()) == plain(rows)


def test_one_instant_odd_names_and_empty_table(spark):
    rows = [("hot", T0, k, "xxy"[k % 3]) for k in range(90)]
    df = spark.createDataFrame(rows, "`key.a` string, `at b` timestamp, n int, `id.c` string")
    got = consecutive_dedup(df, "key.a", ["at b", "n"], "id.c", stretch_rows=10)
    assert sorted(r.n for r in got.collect()) == plain(rows)
    assert consecutive_dedup(df.limit(0), "key.a", ["at b", "n"], "id.c").count() == 0


def test_plan_has_no_self_join(spark):
    df = spark.createDataFrame(log(1), "key string, at timestamp, n int, id string")
    plan = consecutive_dedup(df, "key", ["at", "n"], "id")._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert joins and all("rightHint=(strategy=broadcast)" in line for line in joins)
