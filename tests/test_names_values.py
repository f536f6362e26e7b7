"""Odd headers, floats, dates, NaN and every outcome of an answer."""
from datetime import datetime

from pyspark.sql import functions as F

from quarry.functions.values import all_midnight
from quarry.operators import quality as Q
from quarry.operators import results as P
from quarry.operators.tables import Tables


def test_float_column_prints_its_own_shortest_form(spark):
    t = Tables(spark)
    df = spark.createDataFrame([(0.1,), (2.5,), (1e10,), (1e-7,), (None,)], "f double").withColumn("f", F.col("f").cast("float"))
    t.register("x", df)
    assert [r.f for r in t.distinct_values("x", "f").collect()] == ["0.1", "10000000000.0", "1e-07", "2.5"]


def test_midnight_columns_show_dates(spark):
    t = Tables(spark)
    rows = [(datetime(2026, 3, 12), datetime(2026, 3, 12)), (datetime(2026, 1, 2), datetime(2026, 1, 2, 10, 30)), (None, None)]
    t.register("x", spark.createDataFrame(rows, "d timestamp, ts timestamp"))
    assert [r.d for r in t.distinct_values("x", "d").collect()] == ["2026-01-02", "2026-03-12"]
    assert [r.ts for r in t.distinct_values("x", "ts").collect()] == ["2026-01-02 10:30:00", "2026-03-12 00:00:00"]
    assert t.count_rows("x", "d", "2026-03-12").first().row_count == 1
    assert t.count_rows("x", "ts", "2026-03-12 00:00:00").first().row_count == 1
    assert not all_midnight(t.table("x").limit(0), "d")


def test_profile_counts_nan_as_missing(spark):
    t = Tables(spark)
    t.register("x", spark.createDataFrame([(1.0, "a"), (float("nan"), None), (None, "a"), (2.0, "b")], "`v.1` double, s string"))
    got = {r.column_name: (r.row_count, r.null_count, r.approx_distinct) for r in t.profile().collect()}
    assert got == {"v.1": (4, 2, 2), "s": (4, 1, 2)}


def test_dotted_names_in_quality_checks_and_repeats(spark):
    df = spark.createDataFrame([("a", 2), ("a", 1), ("b", 3), (None, 4)], "`s.t` string, `n.o` int")
    assert {tuple(r) for r in Q.enum_violations(df, "s.t", ["a"]).collect()} == {("b", 1), (None, 1)}
    assert {tuple(r) for r in Q.enum_counts(df, "s.t", ["a", "z"]).collect()} == {("a", 2), ("z", 0)}
    assert [tuple(r) for r in Q.duplicate_keys(df, ["s.t"]).collect()] == [("a", 2)]
    got = P.drop_repeats(df, "s.t", ["n.o"])
    assert got.columns == ["n.o", "s.t"] and {tuple(r) for r in got.collect()} == {(1, "a"), (3, "b"), (4, None)}


def test_answers_of_every_outcome(spark):
    rows = spark.createDataFrame([("a", "one a."), ("b", "x"), ("b", "y"), ("c", "p"), ("c", "q"), ("c", "r"), (None, "z")],
                                 "`k.k` string, said string")
    asked = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "nowhere"), (5, None), (6, "a")], "id int, `k.k` string")
    got = {r.id: (r.answer, r.n_rows) for r in P.answer_requests(asked, rows, ["k.k"], "said", 2).collect()}
    assert got == {1: ("one a.", 1), 2: ("2 records match your request. The full results are shown below.", 2),
                   3: ("The requested file has been generated.", 3), 4: ("No data was returned.", 0),
                   5: ("No data was returned.", 0), 6: ("one a.", 1)}
    unlimited = {r.id: r.answer for r in P.answer_requests(asked, rows, ["k.k"], "said").collect()}
    assert unlimited[3] == "3 records match your request. The full results are shown below."


def test_summary_and_publish(spark, scratch):
    df = spark.createDataFrame([(1, "x"), (2, "y")], "a int, b string")
    assert tuple(P.summary(df, "t").first()) == ("t", 2, "a, b")
    from quarry.sinks.writers import publish
    publish(df, f"{scratch}/out", ["b"])
    publish(df.where("a = 2"), f"{scratch}/out", ["b"])
    assert sorted((r.a, r.b) for r in spark.read.parquet(f"{scratch}/out").collect()) == [(1, "x"), (2, "y"), (2, "y")]
