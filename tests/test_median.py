"""Exact medians by selection, against the plain definition."""
import random
import statistics

import pytest
from pyspark.sql import functions as F

from quarry.operators import aggregate as A
from quarry.operators.median import exact_median


def rows_of(seed, n=800):
    rng = random.Random(seed)
    pick = [lambda: rng.random() * 100, lambda: float(rng.randrange(4)), lambda: None, lambda: float("nan"), lambda: -1e300]
    return [("hot" if rng.random() < .5 else rng.choice(["a", "b", "c", None]), rng.choice("xy"),
             rng.choices(pick, [6, 6, 1, 1, .2])[0]()) for _ in range(n)]


def expected(rows, key):
    groups = {}
    for r in rows:
        if key(r) is not None and None not in (key(r) if isinstance(key(r), tuple) else (key(r),)):
            groups.setdefault(key(r), []).append(r[2])
    real = {k: [v for v in vs if v is not None and v == v] for k, vs in groups.items()}
    return {k: statistics.median(vs) if vs else None for k, vs in real.items()}


@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_selection_equals_the_definition(spark, ranges):
    rows = rows_of(ranges)
    df = spark.createDataFrame(rows, "g string, h string, v double").repartition(4)
    value = F.when(~F.isnan("v"), F.col("v"))
    got = {r.k0: r.median for r in exact_median(df, [F.col("g")], value, ranges).collect() if r.k0 is not None}
    assert got == expected(rows, lambda r: r[0])
    two = {(r.k0, r.k1): r.median for r in exact_median(df, [F.col("g"), F.col("h")], value, ranges).collect()
           if r.k0 is not None}
    assert two == expected(rows, lambda r: (r[0], r[1]))
    nulls = [r[2] for r in rows if r[0] is None and r[2] is not None and r[2] == r[2]]
    assert [r.median for r in exact_median(df, [F.col("g")], value, ranges).where("k0 IS NULL").collect()] == \
        [statistics.median(nulls)]


def test_group_by_mixes_medians_with_other_aggregates(spark):
    rows = [("a", 1, True), ("a", 4, False), ("a", None, None), ("b", None, None), (None, 9, True)]
    df = spark.createDataFrame(rows, "`g.x` string, `v.1` int, flag boolean")
    got = A.group_by(df, ["g.x"], [("median", "v.1"), ("size", "v.1"), ("median", "flag"), ("sum", "v.1")])
    assert got.columns == ["g.x", "median_v.1", "size_v.1", "median_flag", "sum_v.1"]
    assert [tuple(r) for r in got.collect()] == [("a", 2.5, 3, 0.5, 5), ("b", None, 1, None, 0)]
    with pytest.raises(TypeError):
        A.group_by(df, ["g.x"], [("median", "g.x")])
    assert A.group_by(df.limit(0), ["g.x"], [("median", "v.1")]).count() == 0


def test_no_group_buffer_in_the_plan(spark):
    df = spark.createDataFrame(rows_of(5), "g string, h string, v double")
    plan = A.group_by(df, ["g"], [("median", "v")])._jdf.queryExecution().toString()
    assert "percentile" not in plan.lower() and "median(" not in plan.lower()


def test_dotted_headers_in_tables(spark):
    from quarry.operators.tables import Tables

    t = Tables(spark)
    t.register("parts", spark.createDataFrame([("P-1", "open", 2.0), ("P-2", "Open", 4.0), (None, "shut", 1.0)],
                                              "`Part.No` string, `the.state` string, `a.b` double"))
    assert t.count_rows("parts", "Part.No", "p-1").first().row_count == 1
    assert t.count_rows("parts", "the.state", "OPEN").first().row_count == 2
    assert [tuple(r) for r in t.group_by("parts", "the.state").collect()] == [("Open", 1), ("open", 1), ("shut", 1)]
    assert [tuple(r) for r in t.group_by("parts", "the.state", "a.b", "mean").collect()] == \
        [("Open", 4.0), ("open", 2.0), ("shut", 1.0)]
    assert [r[0] for r in t.distinct_values("parts", "Part.No").collect()] == ["P-1", "P-2"]
    assert t.contains("parts", "Part.No", "1").count() == 1
