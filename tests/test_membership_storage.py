"""Membership without moving what cannot match, pages of stored results, exports of the last result."""
import os

import pytest
from pyspark.sql import functions as F

from quarry.operators import membership as M
from quarry.operators import session_results as P5
from quarry.operators.stored_result import store
from quarry.operators.tables import Tables
from quarry.sinks.writers import blank_filled, export, export_last


@pytest.mark.parametrize("bits", [1 << 27, 1 << 15])
def test_known_keys_of_two_columns(spark, monkeypatch, bits):
    monkeypatch.setattr(M, "MAX_BITS", bits)                    # the small bitmap is nearly full: same result
    monkeypatch.setattr(M, "MIN_BITS", 1 << 15)
    keys = spark.range(30_000).select(F.concat(F.lit("K"), (F.col("id") * 2).cast("string")).alias("pn")).unionAll(
        spark.createDataFrame([(None,), ("K0",)], "pn string"))
    key = lambda c: F.when(F.col("id") % c == 0, None).otherwise(F.concat(F.lit("K"), (F.col("id") * c % 70_000).cast("string")))
    rows = spark.range(4_000).select("id", key(3).alias("a.b"), key(7).alias("b"))
    got = M.known_keys(rows, {"a.b": "a_known", "b": "b_known"}, M.Universe(keys, "pn"))
    assert got.columns == ["id", "a.b", "b", "a_known", "b_known"]
    truth = {f"K{2 * k}" for k in range(30_000)}
    out = got.collect()
    assert sorted(r.id for r in out) == list(range(4_000))
    for r in out:
        assert r.a_known == (None if r["a.b"] is None else r["a.b"] in truth)
        assert r.b_known == (None if r.b is None else r.b in truth)


def test_rows_that_cannot_match_are_not_shuffled(spark):
    universe = M.Universe(spark.createDataFrame([("A",)], "pn string"), "pn")
    rows = spark.range(1_000).select("id", F.when(F.col("id") % 2 == 0, F.concat(F.lit("x"), F.col("id").cast("string"))).alias("k"))
    marked = universe.perhaps(rows, "k", "m")
    assert "Exchange hashpartitioning" not in marked._jdf.queryExecution().executedPlan().toString()
    assert marked.where("m").count() <= 5 and marked.where("k IS NULL AND m").count() == 0
    empty = M.Universe(spark.createDataFrame([], "pn string"), "pn")
    assert M.known_keys(rows, {"k": "known"}, empty).where("known").count() == 0


def test_pages_of_a_stored_result(spark, scratch):
    df = spark.range(1000).select((999 - F.col("id")).alias("rn"), (F.col("id") % 10).alias("k.x"), F.lit("t").alias("t"))
    stored = store(df, ["k.x", "rn"], f"{scratch}/result", partitions=7)
    assert stored.total == 1000 and stored.pages(60) == 17
    want = sorted((r["k.x"], r.rn) for r in df.collect())
    seen = []
    for number in range(17):
        page = stored.page(number, 60)
        assert page.columns == ["rn", "rn_data", "k.x", "t"] and len(page.inputFiles()) <= 2
        rows = page.collect()
        assert [r.rn for r in rows] == list(range(number * 60 + 1, min(number * 60 + 61, 1001)))
        seen += [(r["k.x"], r.rn_data) for r in rows]
    assert seen == want
    assert stored.page(17, 60).count() == 0
    stored.remove()
    assert not os.path.exists(f"{scratch}/result")
    empty = store(df.limit(0), ["rn"], f"{scratch}/none", partitions=2)
    assert empty.total == 0 and empty.pages() == 0


def test_export_of_the_last_result_goes_first_and_clears_it(spark, scratch):
    t = Tables(spark)
    t.register("my parts", spark.createDataFrame([("P1", "Open"), ("P2", "Shut")], "pn string, state string"))
    assert export_last(spark, "c1", scratch) == (None, 0, "There is no result to export; name a table.")
    P5.remember(spark.createDataFrame([(1,), (2,), (3,)], "a int"), "c1")
    path, rows, said = export_last(spark, "c1", scratch, t, "my parts")
    assert rows == 3 and said == "3 rows exported." and os.path.basename(path).startswith("result_")
    assert P5.recall(spark, "c1") is None
    path, rows, _ = export_last(spark, "c1", scratch, t, "parts", "state", "open")
    assert rows == 1 and os.path.basename(path).startswith("my_parts")
    P5.remember(spark.createDataFrame([], "a int"), "c1")
    assert export_last(spark, "c1", scratch) == (None, 0, "No rows matched.")
    assert len([d for d in os.listdir(scratch) if d.startswith("result_")]) == 1


def test_exported_numbers_read_as_numbers(spark, scratch):
    df = spark.createDataFrame([(123456789.0, 0.1, None, True), (float("nan"), 1e-5, 2, None)],
                               "big double, small double, n int, `b.c` boolean")
    assert [tuple(r) for r in blank_filled(df).collect()] == [("123456789.0", "0.1", "", "True"), ("", "1e-05", "2", "")]
    assert export(df.where("n > 5"), scratch, "none") == (None, 0) and not os.listdir(scratch)
