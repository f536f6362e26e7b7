"""Dictionaries that read new files only."""
import pytest
from pyspark.sql import functions as F

from quarry.functions.similarity import NotFound
from quarry.operators import file_summary as FS
from quarry.operators import value_dictionary as VD
from quarry.operators.profile_store import ProfileStore
from quarry.operators.tables import Tables


def add(spark, path, states, name="s"):
    spark.createDataFrame([(s, 1) for s in states], f"`{name}` string, n int").coalesce(1).write.mode("append").parquet(path)


def dictionary(spark, scratch, path, reads, column="s"):
    return VD.ValueDictionary(spark, f"{scratch}/dict", "t", column, lambda: spark.read.parquet(path).inputFiles(),
                              lambda files: reads.append(len(files)) or spark.read.parquet(*files))


def test_refresh_reads_new_files_only(spark, scratch):
    path, reads = f"{scratch}/my table", []
    add(spark, path, ["Open", "open", None, "Shut"])
    d = dictionary(spark, scratch, path, reads)
    assert d.refresh() == 1 and d.refresh() == 0
    add(spark, path, ["Shut", "New one"])
    add(spark, path, [])
    assert d.refresh() >= 1 and d.refresh() == 0
    want = {"Open": 1, "open": 1, "Shut": 2, "New one": 1}
    assert {r.v: r.n for r in d.values().collect()} == want
    assert sum(reads) == len(spark.read.parquet(path).inputFiles())
    again = dictionary(spark, scratch, path, reads)             # another session of the same dictionary
    assert again.refresh() == 0 and {r.v: r.n for r in again.values().collect()} == want


def test_a_file_that_goes_away_starts_anew(spark, scratch):
    path, reads = f"{scratch}/t", []
    add(spark, path, ["a"])
    d = dictionary(spark, scratch, path, reads)
    d.refresh()
    spark.createDataFrame([("b", 1)], "s string, n int").coalesce(1).write.mode("overwrite").parquet(path)
    assert d.refresh() == 1 and [tuple(r) for r in d.values().collect()] == [("b", 1)]


def test_many_batches_become_one(spark, scratch, monkeypatch):
    monkeypatch.setattr(FS, "MAX_BATCHES", 2)
    path, reads = f"{scratch}/t", []
    d = dictionary(spark, scratch, path, reads)
    spark.createDataFrame([], "s string, n int").write.parquet(path)
    for k in range(5):
        add(spark, path, ["x", f"v{k}"])
        d.refresh()
    assert {r.v: r.n for r in d.values().collect()} == {"x": 5, **{f"v{k}": 1 for k in range(5)}}
    known = d._known(d._current())
    assert len({b for _, _, b in known.values()}) <= 3 and d.refresh() == 0


def test_a_refresh_that_dies_leaves_nothing_behind(spark, scratch):
    path, reads = f"{scratch}/t", []
    add(spark, path, ["a", "a"])
    d = dictionary(spark, scratch, path, reads)
    d.refresh()
    add(spark, path, ["b"])
    spark.createDataFrame([("b", 7, "half")], "v string, n long, batch string").write.mode("append").parquet(
        f"{d._current()}/values")                               # values without their list of files
    assert {r.v: r.n for r in d.values().collect()} == {"a": 2}
    d.refresh()
    assert {r.v: r.n for r in d.values().collect()} == {"a": 2, "b": 1}


def test_tables_resolve_from_the_dictionary(spark, scratch):
    path = f"{scratch}/parts"
    add(spark, path, ["Open WorkOrder", "open workorder", "No stock", None], "the.state")
    t = Tables(spark, dictionaries=f"{scratch}/dict")
    t.register_files("parts", path)
    assert t.count_rows("parts", "the.state", "open WORKORDER").first().row_count == 2
    assert t.count_rows("parts", "the.state", "no stok").first().row_count == 1
    assert [r[0] for r in t.distinct_values("parts", "the.state").collect()] == ["No stock", "Open WorkOrder", "open workorder"]
    with pytest.raises(NotFound):
        t.count_rows("parts", "the.state", "###")
    add(spark, path, ["Sold"], "the.state")
    t.register_files("parts", path)
    assert t.count_rows("parts", "the.state", "sold").first().row_count == 1
    spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "s string, n int, p string").write.partitionBy("p").parquet(f"{scratch}/split")
    t.register_files("split", f"{scratch}/split")
    assert [r[0] for r in t.distinct_values("split", "p").collect()] == ["x", "y"]
    assert t.get_rows("split", "p", "X").select(F.col("s")).first().s == "a"
    assert t.values_of("parts", "n") is None


def test_stored_profile_grows_with_the_table(spark, scratch):
    path, reads = f"{scratch}/t", []

    def grow(low, high):
        spark.range(low, high).select("id", (F.col("id") % 50).cast("double").alias("a.b"), F.lit(None).cast("string").alias("none"),
                                      F.when(F.col("id") % 4 == 0, float("nan")).otherwise(F.col("id") * 1.0).alias("f"),
                                      F.array("id").alias("nested")).coalesce(1).write.mode("append").parquet(path)
    grow(0, 2000)
    store = ProfileStore(spark, f"{scratch}/p", "t", lambda: spark.read.parquet(path).inputFiles(),
                         lambda files: reads.append(len(files)) or spark.read.parquet(*files))
    assert store.refresh() == 1
    grow(1000, 5000)
    assert store.refresh() == 1 and store.refresh() == 0 and sum(reads) == 2
    got = {r.column_name: r for r in store.profile().collect()}
    assert {c: (r.ordinal, r.row_count, r.null_count) for c, r in got.items()} == {
        "id": (1, 6000, 0), "a.b": (2, 6000, 0), "none": (3, 6000, 6000), "f": (4, 6000, 1500), "nested": (5, 6000, 0)}
    assert abs(got["id"].approx_distinct - 5000) <= 100 and got["a.b"].approx_distinct == 50
    assert got["none"].approx_distinct == 0 and got["nested"].approx_distinct is None
    assert abs(got["id"].approx_median - 2000) < 250 and got["none"].approx_median is None
    t = Tables(spark, dictionaries=f"{scratch}/d")
    t.register_files("grown", path)
    assert t.stored_profile("grown").count() == 5
    with pytest.raises(ValueError):
        Tables(spark).stored_profile("grown")
