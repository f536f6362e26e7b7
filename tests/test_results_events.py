import pytest
from pyspark.sql import functions as F

from quarry.operators import events as E
from quarry.operators import results as P
from quarry.operators.session_results import forget, recall, remember


@pytest.mark.parametrize("n,expected", [
    (0, []), (60, [(1, 60)]), (61, [(1, 60), (61, 61)]),
    (125, [(1, 60), (61, 120), (121, 125)]),
])
def test_paging(spark, n, expected):
    df = spark.range(n).withColumn("v", F.col("id") * 2)
    p = P.page(df, ["id"])
    got = sorted({(r.row_from, r.row_to) for r in p.collect()})
    assert got == expected
    rns = sorted(r.rn for r in p.collect())
    assert rns == list(range(1, n + 1))
    assert all(r.rn == r.id + 1 for r in p.collect())


def test_ordinal_is_global_across_partitions(spark):
    df = spark.range(1000).repartition(7).withColumn("k", (F.col("id") * 7919) % 1000)
    p = P.page(df, ["k"])
    assert sorted((r.k, r.rn) for r in p.collect()) == [(i, i + 1) for i in range(1000)]


def test_markdown_chunks(spark):
    df = spark.createDataFrame([(i, None if i == 2 else f"n{i}") for i in range(1, 62)], "k int, name string")
    ch = P.markdown_chunks(df, ["k"]).orderBy("chunk_id").collect()
    assert len(ch) == 2
    assert ch[0].body.startswith("**Rows 1–60 of 61**\n\n| k | name |\n| --- | --- |\n| 1 | n1 |\n| 2 |  |")
    assert ch[1].body.endswith("| 61 | n61 |")


def test_drop_repeats_keeps_first(spark):
    df = spark.createDataFrame([(1, 0, "x"), (0, 5, "x"), (0, 1, "y"), (2, 0, "x")],
                               "conv_id int, turn int, text string")
    got = sorted(tuple(r) for r in P.drop_repeats(df, "text", ["conv_id", "turn"]).collect())
    assert got == [(0, 1, "y"), (0, 5, "x")]


@pytest.mark.parametrize("details,expected", [
    ("  spare  ", "Part P1 has a status of “No stock”. Additional details: spare"),
    ("  ", "Part P1 has a status of “No stock”."),
    ("NaN", "Part P1 has a status of “No stock”."),
    (None, "Part P1 has a status of “No stock”."),
])
def test_sentences(spark, details, expected):
    df = spark.createDataFrame([("P1", "No stock", details)], "p string, s string, d string")
    assert df.select(P.status_sentence("p", "s", "d")).first()[0] == expected


def test_answer_many_rows(spark):
    df = spark.createDataFrame([("a", "s1"), ("a", "s2"), ("b", "s3")], "k string, sentence string")
    got = {r.k: r.answer for r in P.answer(df, ["k"], "sentence").collect()}
    assert got == {"a": "2 records match your request. The full results are shown below.", "b": "s3"}


def test_inline_or_export(spark):
    assert P.inline_or_export(spark.range(200)) == "inline"
    assert P.inline_or_export(spark.range(201)) == "export"
    assert P.inline_or_export(spark.range(5000), None) == "inline"


def test_last_result_per_conversation(spark):
    remember(spark.range(3), "conv-1")
    remember(spark.range(5), "conv-2")
    assert recall(spark, "conv-1").count() == 3 and recall(spark, "conv-2").count() == 5
    forget(spark, "conv-1")
    assert recall(spark, "conv-1") is None


def test_consecutive_dedup_rule(spark):
    ids = ["a", "a", "", "a", "b", "a"]
    df = spark.createDataFrame([("c", i, x) for i, x in enumerate(ids, 1)] +
                               [("d", 1, "a"), ("d", 2, None), ("d", 3, "a")],
                               "conv string, ts int, id string")
    got = sorted((r.conv, r.ts) for r in E.consecutive_dedup(df, "conv", ["ts"], "id").collect())
    assert got == [("c", 1), ("c", 3), ("c", 5), ("c", 6), ("d", 1), ("d", 2)]


def test_hot_conversation_is_split(spark):
    # one conversation holds most rows; result must equal the lag rule
    rows = [("hot", i, "ab"[(i // 3) % 2]) for i in range(3000)] + [("cold", i, "x") for i in range(10)]
    df = spark.createDataFrame(rows, "conv string, ts int, id string")
    got = E.consecutive_dedup(df, "conv", ["ts"], "id").count()
    assert got == 1000 + 1


def test_skip_blank(spark):
    df = spark.createDataFrame([(" ",), (None,), ("hi",), ("　",)], "text string")
    assert [r.text for r in E.skip_blank(df, "text").collect()] == ["hi"]
