import math

import pytest

from quarry.operators.tables import Tables, load_tables
from tests.conftest import SF001


@pytest.fixture(scope="module")
def groups(spark):
    t = Tables(spark)
    df = spark.createDataFrame([("b", 1.0), ("a", None), (None, 3.0), ("b", None), ("B", 5.0)],
                               "g string, v double")
    t.register("g", df)
    return t


GOLDEN = {
    "count": {"B": 1, "a": 0, "b": 1},
    "sum": {"B": 5.0, "a": 0.0, "b": 1.0},
    "mean": {"B": 5.0, "a": None, "b": 1.0},
    "min": {"B": 5.0, "a": None, "b": 1.0},
    "max": {"B": 5.0, "a": None, "b": 1.0},
    "median": {"B": 5.0, "a": None, "b": 1.0},
    "nunique": {"B": 1, "a": 0, "b": 1},
    "size": {"B": 1, "a": 1, "b": 2},
    "std": {"B": None, "a": None, "b": None},
    "var": {"B": None, "a": None, "b": None},
    "prod": {"B": 5.0, "a": 1.0, "b": 1.0},
}


@pytest.mark.parametrize("func", sorted(GOLDEN))
def test_group_by_pandas_null_rules(groups, func):
    rows = groups.group_by("g", "g", "v", func).collect()
    assert [r[0] for r in rows] == ["B", "a", "b"]          # null key dropped, sorted
    assert {r[0]: r[1] for r in rows} == GOLDEN[func]
    assert rows[0].__fields__[1] == f"{func}_v"


def test_group_count_without_column(groups):
    assert [tuple(r) for r in groups.group_by("g", "g").collect()] == [("B", 1), ("a", 1), ("b", 2)]


def test_first_last_need_order(spark, groups):
    with pytest.raises(ValueError):
        groups.group_by("g", "g", "v", "first")
    t = Tables(spark)
    t.register("o", spark.createDataFrame(
        [(1, "x", None), (2, "x", 2.0), (3, "x", 3.0), (4, "x", None)], "k int, g string, v double"))
    assert t.group_by("o", "g", "v", "first", order_by="k").first()[1] == 2.0
    assert t.group_by("o", "g", "v", "last", order_by="k").first()[1] == 3.0


def test_mean_on_text_is_rejected(spark):
    t = load_tables(spark, SF001, ["part"])
    with pytest.raises(TypeError):
        t.group_by("part", "p_type", "p_name", "mean")


def test_distinct_sorted_as_strings(spark):
    t = Tables(spark)
    t.register("d", spark.createDataFrame([(10.0,), (9.0,), (2.5,), (None,), (9.0,)], "x double"))
    assert [r[0] for r in t.distinct_values("d", "x").collect()] == ["10.0", "2.5", "9.0"]


def test_nan_is_missing_and_headers_are_stripped(spark):
    t = Tables(spark)
    df = t.register("n", spark.createDataFrame([(float("nan"), 1), (2.0, 1), (float("nan"), 2)],
                                               "` a ` double, b int"))
    assert df.columns == ["a", "b"]
    assert [tuple(r) for r in t.group_by("n", "b", "a", "sum").collect()] == [(1, 2.0), (2, 0.0)]
    assert [tuple(r) for r in t.group_by("n", "b", "a", "count").collect()] == [(1, 1), (2, 0)]
    assert [r[0] for r in t.distinct_values("n", "a").collect()] == ["2.0"]
    assert t.group_by("n", "a").count() == 1
    strict = t.register("m", df, nan_as_null=True)
    assert strict.where("a is null").count() == 2


def test_case_duplicate_columns_refused(spark):
    with pytest.raises(ValueError):
        Tables(spark).register("x", spark.createDataFrame([(1, 2)], "a int, A int"))


def test_count_rows_rules(spark):
    t = load_tables(spark, SF001, ["lineitem", "region", "orders"])
    r = t.count_rows("lineitem", "quantity", "17.0").first()
    assert r.filter_column == "l_quantity"
    assert r.row_count == spark.read.parquet(f"{SF001}/lineitem.parquet").where("l_quantity = 17").count()
    assert t.count_rows("region", "r_name", "asia").first().row_count == 1
    r = t.count_rows("orders", "orderpriority", "urgent").first()
    assert r.filter_value == "1-URGENT"
    assert t.count_rows("orders").first().row_count == spark.read.parquet(f"{SF001}/orders.parquet").count()


def test_boolean_counts_as_numeric(spark):
    t = Tables(spark)
    t.register("b", spark.createDataFrame([(True,), (False,), (True,)], "flag boolean"))
    assert t.count_rows("b", "flag", "1").first().row_count == 2


def test_get_rows_without_value_returns_all(spark):
    t = load_tables(spark, SF001, ["nation"])
    assert t.get_rows("nation", "n_name", "").count() == 25
    assert t.get_rows("nation", "n_name", "nation_3").count() == 1


def test_text_filter_pushes_down_as_in(spark):
    t = load_tables(spark, SF001, ["orders"])
    f = t.equality_filter(t.table("orders"), "o_orderpriority", "1-urgent")
    plan = t.table("orders").where(f.predicate)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "In(o_orderpriority" in plan or "EqualTo(o_orderpriority" in plan


def test_query_dialect_and_guard(spark):
    t = load_tables(spark, SF001, ["orders"])
    n = t.query("orders", 'o_totalprice > 400000 and o_orderpriority == "1-URGENT"').count()
    assert n == spark.read.parquet(f"{SF001}/orders.parquet").where(
        "o_totalprice > 400000 and o_orderpriority = '1-URGENT'").count()
    with pytest.raises(ValueError, match="Invalid query expression"):
        t.query("orders", "java_method('java.lang.System', 'exit', 0) = 1")
    with pytest.raises(ValueError, match="Invalid query expression"):
        t.query("orders", "no_such_column > 1")


def test_profile(spark):
    t = load_tables(spark, SF001, ["region", "embeddings"])
    rows = {(r.table_name, r.column_name): r for r in t.profile().collect()}
    assert rows[("region", "r_name")].row_count == 5
    assert rows[("region", "r_name")].null_count == 0
    assert rows[("region", "r_name")].approx_distinct == 5
    assert rows[("embeddings", "embedding")].approx_distinct is None


def test_share_and_schema_and_roles(spark):
    t = load_tables(spark, SF001, ["orders"])
    t.register("20260312154848_output", t.table("orders"))
    r = t.share("orders", "o_orderstatus = 'F'").first()
    assert r.total == t.table("orders").count() and 0 < r.matched < r.total
    assert t.roles()["20260312154848_output"] == "primary"
    assert t.roles()["orders"] == "supplemental"
    assert [r.column_name for r in t.schema("order").collect()][0] == "o_orderkey"
    assert not math.isnan(t.table("orders").count())
