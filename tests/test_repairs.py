"""Cases that an earlier review found wrong: late rows, folder datasets, hot or odd names, exact cutoffs."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import extract as X
from quarry.operators import session_results as P5
from quarry.operators.resolve import bulk_resolve
from quarry.operators.results import markdown_chunks, page
from quarry.operators.tables import Tables, view_name
from quarry.streaming.dedup import consecutive_dedup_stream
from quarry.streaming.runner import read_table_stream, run_available

COMMENT = "Phasing out P10X in favor of N20Y now"


def test_stream_keeps_late_rows_over_many_triggers(spark, scratch):
    rows = [("2024-01-05 00:00:01", 1, "a"), ("2024-01-05 09:00:02", 2, "b"), ("2024-01-01 00:00:03", 3, "c"),
            ("2024-01-01 00:00:04", 4, "d"), ("2023-12-01 00:00:05", 5, ""), ("2024-01-06 00:00:06", 6, "d")]
    for k, row in enumerate(rows):
        spark.createDataFrame([("c", *row)], "conv string, ts string, n int, id string") \
            .withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1) \
            .write.mode("append").parquet(f"{scratch}/in/events.parquet")
        del k
    s = read_table_stream(spark, f"{scratch}/in", "events", max_files=1)
    out = run_available(consecutive_dedup_stream(s, "conv", "ts", "n", "id"), "t_late")
    got = sorted(r.n for r in out.collect())
    assert set(got) >= {1, 2, 3, 5} and len(got) >= 5      # only the adjacent repeat of d may go


def test_folder_dataset_streams_all_rows(spark, scratch):
    spark.range(40).selectExpr("id", "'x' as t").repartition(4).write.parquet(f"{scratch}/in/part.parquet")
    assert run_available(read_table_stream(spark, f"{scratch}/in", "part"), "t_folder").count() == 40


def test_incremental_sets_blank_rows_aside_and_ignores_repeated_results(spark):
    df = spark.createDataFrame([(1, "<br>"), (2, ""), (3, None), (4, COMMENT), (5, COMMENT)], "id long, Comments string")
    prior = X.extract_rules(df.where("id = 4")).withColumn("text_key", X.text_key("Comments"))
    got = {r.id: r for r in X.incremental(df, prior.unionByName(prior), X.extract_rules).collect()}
    assert len(got) == 5 and got[2].replacement_intent is None and got[3].replacement_intent is None
    assert got[1].replacement_intent == 0 and got[4].old_part == got[5].old_part and got[5].reused


def test_resumable_twice(spark, scratch):
    df = spark.createDataFrame([(1, "<br>"), (2, " "), (4, COMMENT), (5, COMMENT)], "id long, Comments string")
    path = f"{scratch}/results"
    first = X.resumable(df, path, X.extract_rules, buckets=3)
    assert sorted(r.id for r in first.collect()) == [1, 2, 4, 5]
    spark.read.parquet(path).coalesce(1).write.mode("append").parquet(f"{scratch}/copy")
    spark.read.parquet(f"{scratch}/copy").write.mode("append").parquet(path)       # doubled results
    again = X.resumable(df, path, X.extract_rules, buckets=3)
    assert sorted(r.id for r in again.collect()) == [1, 2, 4, 5]
    assert again.where("id = 2").first().replacement_intent is None


def test_scores_count_missing_predictions_and_survive_no_hits(spark):
    gold = spark.createDataFrame([(1, 1, "A", "B"), (2, 1, "C", "D")], "id long, gold_intent int, gold_old string, gold_new string")
    pred = spark.createDataFrame([(1, 1, "A", "Z")], "id long, replacement_intent int, old_part string, new_part string")
    got = {r.field: r for r in X.scores(pred, gold, "id").collect()}
    assert got["replacement_intent"].recall == 0.5 and got["old_part"].fn == 1
    assert got["new_part"].tp == 0 and got["new_part"].f1 is None and got["new_part"].precision == 0


def test_bulk_resolve_keeps_exact_cutoff(spark):
    random.seed(2)
    words = ["".join(random.choice("abc") for _ in range(random.randint(2, 8))) for _ in range(60)]
    needles = ["abc", *words[:25]]
    values = sorted({"abcwxyz", *words[25:]})
    got = {r.needle: r for r in bulk_resolve(
        spark.createDataFrame([(n,) for n in needles], "n string"), "n",
        spark.createDataFrame([(v,) for v in values] * 3, "v string"), "v").collect()}
    for n in set(needles):
        best = max((difflib.SequenceMatcher(None, v, n).ratio() for v in values), default=0)
        if n in values:
            assert got[n].match_kind == "exact"
        else:
            assert (got[n].match_kind == "fuzzy") == (best >= 0.6), n
    assert got["abc"].resolved is not None


def test_paging_of_columns_with_reserved_names(spark):
    df = spark.createDataFrame([(k, 100 + k, "x") for k in range(3)], "rn long, total long, body string")
    rows = sorted(page(df, ["rn"], 2).collect(), key=lambda r: r.rn)
    assert [(r.rn, r.rn_data, r.total, r.total_data) for r in rows] == [(1, 0, 3, 100), (2, 1, 3, 101), (3, 2, 3, 102)]
    body = markdown_chunks(df, ["rn"], 60).first().body
    assert "| 0 | 100 | x |" in body and "| 2 | 102 | x |" in body


def test_conversations_never_share_a_view(spark):
    P5.remember(spark.range(3), "19:a")
    P5.remember(spark.range(5), "19_a")
    assert P5.recall(spark, "19:a").count() == 3 and P5.recall(spark, "19_a").count() == 5
    for c in ("19:a", "19_a"):
        P5.forget(spark, c)


def test_tables_with_odd_names_empty_values_floats_and_predicates(spark):
    t = Tables(spark)
    df = spark.createDataFrame([("Select", 0.1), ("b", 0.5)], "Status string, f double").withColumn("f", F.col("f").cast("float"))
    for name in ("sales-2024", "my table"):
        t.register(name, df)
        assert spark.table(view_name(name)).count() == 2
    assert t.count_rows("my table", "Status", "").first().row_count == 2
    assert t.count_rows("my table", "f", "0.1").first().row_count == 1
    assert t.query("my table", "Status == 'Select'").count() == 1
    for bad in ("exists(select 1)", "f > (select 1)", "Status in (select 'b')", "reflect('java.lang.Math', 'abs', 1) = 1"):
        with pytest.raises(ValueError):
            t.query("my table", bad)
